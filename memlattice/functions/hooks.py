"""Where models are plugged in. A model is a function from columns to a column (a Pandas UDF that calls one, say), so that
Spark batches and spreads the calls; those below are deterministic stand-ins that need no model.

embed(text) -> array<float>; generate(prompt) -> text, null or blank for no answer; classify(premise, hypothesis) ->
struct<contradiction, entailment, neutral: double>.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.functions.scoring import rounded
from memlattice.functions.text import jaccard, keywords, text_of, tokenize

Embed = Callable[[Column], Column]
Generate = Callable[[Column], Column]
Classify = Callable[[Column, Column], Column]
NEGATIONS = ("not", "no", "never", "none", "cannot", "without")


def hashed_embedding(text: Column, dim: int = 128) -> Column:
    """A stand-in: each token adds or takes away one at a place, both by its MD5; the unit vector, or zeros for no token."""

    @F.pandas_udf("array<float>")
    def embed(tokens: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}
        out = []
        for row in tokens:
            v = np.zeros(dim)
            for t in row:
                if t not in known:
                    h = hashlib.md5(t.encode()).hexdigest()
                    known[t] = int(h[:8], 16) % dim, 1.0 if int(h[8:16], 16) % 2 == 0 else -1.0
                at, by = known[t]
                v[at] += by
            out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32))
        return pd.Series(out)

    return embed(tokenize(text))


def no_answer(prompt: Column) -> Column:
    """A stand-in for a language model that never answers."""
    return F.nullif(prompt, prompt)


def joined_evidence(definition: Column, evidence: Column) -> Column:
    """A stand-in for a rewritten definition: the old one, then what is new."""
    return F.concat_ws(" ", definition, evidence)


def lexical_inference(premise: Column, hypothesis: Column) -> Column:
    """A stand-in: texts that share their keywords contradict if only one has a negation, else one follows from the other."""
    shared = jaccard(keywords(premise, 500), keywords(hypothesis, 500))
    denies = lambda c: F.exists(tokenize(c), lambda t: t.isin(*NEGATIONS))
    differ = denies(premise) != denies(hypothesis)
    against, follows = F.when(differ, shared).otherwise(0.0), F.when(differ, 0.0).otherwise(shared)
    return F.struct(against.alias("contradiction"), follows.alias("entailment"), (1 - against - follows).alias("neutral"))


def expanded_query(text: Column, generate: Generate, embed: Embed) -> Column:
    """The embedding of a passage that would answer the question; of the question itself if there is no answer."""
    return embed(F.coalesce(F.nullif(F.btrim(generate(text)), F.lit("")), text))


def embedded(rows: DataFrame, text: Column, embed: Embed = hashed_embedding, least: int = 10) -> DataFrame:
    """rows with their embedding made anew from the text; texts of less than `least` characters keep theirs."""
    return rows.withColumn("embedding", F.when(F.length(F.btrim(text_of(text))) >= least, embed(text)).otherwise(F.col("embedding")))


def adjudicated(pairs: DataFrame, classify: Classify = lexical_inference) -> DataFrame:
    """pairs (claim, target, ...) with verdict and confidence: classified both ways, the more contradicting way counts."""
    both = pairs.withColumn("_f", classify(F.col("target"), F.col("claim"))).withColumn("_r", classify(F.col("claim"), F.col("target")))
    both = both.withColumn("_s", F.when(F.col("_f.contradiction") >= F.col("_r.contradiction"), F.col("_f")).otherwise(F.col("_r")))
    c, e, n = F.col("_s.contradiction"), F.col("_s.entailment"), F.col("_s.neutral")
    top = F.greatest(c, e, n)
    is_c, is_e = (c >= e) & (c >= n), (e > c) & (e >= n)
    verdict = F.when(is_c & (c > 0.8), "genuine").when(is_e & (e > 0.7), "complementary").when(top < 0.5, "unrelated").otherwise("tension")
    return both.withColumns({"verdict": verdict, "confidence": top}).drop("_f", "_r", "_s")


def penalty(confidence: Column, most: float = 0.15) -> Column:
    """What a genuine contradiction takes from a memory's confidence."""
    return rounded(confidence * most, 3)
