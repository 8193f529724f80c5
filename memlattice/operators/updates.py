"""Changes of memories as DataFrame transformations: each takes the rows and a table of what happened to which ids, and
returns all rows with the changes. Many happenings of one id are pre-aggregated. Rows without an id stay as they are."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlattice.functions.hooks import Embed, hashed_embedding, penalty
from memlattice.functions.scoring import AS_OF, clamp, days_since, now, schedule
from memlattice.functions.text import derive_name, infer_category, keywords
from memlattice.operators.retrieval import top_k
from memlattice.tables import materialize


def changed(rows: DataFrame, happened: DataFrame, flag: str, **columns: Column) -> DataFrame:
    """rows with the columns set where `happened` (unique ids, its own columns) has the id."""
    both = rows.join(happened.withColumn(flag, F.lit(True)), "id", "left")
    hit = F.coalesce(F.col(flag), F.lit(False))
    return both.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in columns.items()}).select(*rows.columns)


def touch(rows: DataFrame, accesses: DataFrame, as_of: dt.datetime = AS_OF) -> DataFrame:
    """accesses: id. Each adds one to access_count; last_accessed and updated_at become now."""
    n = accesses.groupBy("id").agg(F.count("*").alias("n_touched"))
    return changed(rows, n, "_hit", access_count=(F.coalesce("access_count", F.lit(0)) + F.col("n_touched")).cast("int"), last_accessed=now(as_of), updated_at=now(as_of))


def prepended(array: Column, element: Column, most: int = 100) -> Column:
    """The element before the array's own, the first `most` of them."""
    return F.slice(F.concat(F.array(element), array), 1, most)


def appended(array: Column, element: Column) -> Column:
    """The array with the element at its end, if it is neither null nor there already; a null array counts as empty."""
    held = F.coalesce(array, F.array().cast("array<string>"))
    return F.when(element.isNull() | F.coalesce(F.array_contains(held, element), F.lit(False)), held).otherwise(F.concat(held, F.array(element)))


#: A vote's effect, and the bounds of confidence.
HELPFUL, UNHELPFUL, FLOOR, CEILING = 0.05, -0.10, 0.05, 1.0


def folded(votes: DataFrame, chunk_rows: int = 1000) -> DataFrame:
    """id, by, low, high, n_votes, n_helpful: what all votes of an id, one after another, make of a confidence x, which is
    x + by kept within low and high. votes: id, helpful and, if their order is known, `at`.

    As x + a within bounds, then + b within bounds, is again of that form, an id's votes are folded in chunks, each a row
    that goes on: no task holds more than a chunk of them at once."""
    v = votes.withColumn("at", F.lit(None).cast("timestamp")) if "at" not in votes.columns else votes
    v = v.select("id", "at", F.to_date("at").alias("day"), F.coalesce("helpful", F.lit(False)).alias("helpful"))
    v = v.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("id", "day").orderBy("at", "helpful")) - 1) / chunk_rows))
    start = F.struct(F.lit(0.0).alias("by"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))

    def then(f: Column, by: Column, low: Column, high: Column) -> Column:
        kept = lambda x: F.least(F.greatest(x + by, low), high)
        return F.struct((f["by"] + by).alias("by"), kept(f["low"]).alias("low"), kept(f["high"]).alias("high"))

    one = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "helpful"))), start, lambda f, x: then(f, F.when(x["helpful"], HELPFUL).otherwise(UNHELPFUL), F.lit(FLOOR), F.lit(CEILING)))
    chunks = v.groupBy("id", "day", "chunk").agg(one.alias("f"), F.count("*").alias("n"), F.count_if("helpful").alias("h"))
    all_ = F.aggregate(F.array_sort(F.collect_list(F.struct("day", "chunk", "f"))), start, lambda f, x: then(f, x["f"]["by"], x["f"]["low"], x["f"]["high"]))
    return chunks.groupBy("id").agg(all_.alias("f"), F.sum("n").alias("n_votes"), F.sum("h").alias("n_helpful")).select("id", "f.*", "n_votes", "n_helpful")


def feedback(rows: DataFrame, votes: DataFrame, as_of: dt.datetime = AS_OF) -> DataFrame:
    """votes: id, helpful, and `at` if their order is known. Confidence rises by 0.05 for each helpful vote and falls by
    0.10 for each other, within 0.05 and 1 after each of them. A helpful vote is also an access."""
    f = folded(votes)
    helped = F.col("n_helpful") > 0
    return changed(
        rows, f, "_hit", confidence=clamp(F.coalesce("confidence", F.lit(0.5)) + F.col("by"), F.col("low"), F.col("high")),
        access_count=(F.coalesce("access_count", F.lit(0)) + F.col("n_helpful")).cast("int"), last_accessed=F.when(helped, now(as_of)).otherwise(F.col("last_accessed")), updated_at=now(as_of),
    )


def feedback_log(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """id, n_votes, n_helpful, confidence_before, confidence_after of each memory that was voted on."""
    f = folded(votes).join(rows.select("id", F.coalesce("confidence", F.lit(0.5)).alias("confidence_before")), "id")
    return f.select("id", "n_votes", "n_helpful", "confidence_before", clamp(F.col("confidence_before") + F.col("by"), F.col("low"), F.col("high")).alias("confidence_after"))


def reviewed(rating: int, as_of: dt.datetime, lapse: bool, state: str | None = None) -> Column:
    """The scheduling struct after a review."""
    f = F.col("fsrs")
    s = schedule(f["state"], f["stability"], f["difficulty"], F.lit(rating), days_since(f["last_review"], as_of))
    return F.struct(
        s["stability"].alias("stability"), s["difficulty"].alias("difficulty"), (f["reps"] + 1).alias("reps"),
        (f["lapses"] + int(lapse)).alias("lapses"), (F.lit(state) if state else s["state"]).alias("state"), now(as_of).alias("last_review"),
    )


def forget(rows: DataFrame, ids: DataFrame, as_of: dt.datetime = AS_OF) -> DataFrame:
    """Salience falls to 0.6 of itself (at least 0.1), the memory fades and is relearned."""
    return changed(rows, ids.select("id").distinct(), "_hit", salience=F.greatest(F.lit(0.1), F.col("salience") * 0.6), faded=F.lit(True), fsrs=reviewed(1, as_of, True, "relearning"))


def validate(rows: DataFrame, outcomes: DataFrame, as_of: dt.datetime = AS_OF) -> DataFrame:
    """outcomes: id, outcome. A right prediction is a good review, a wrong one a failed review; of several outcomes of
    an id a wrong one counts."""
    right = outcomes.groupBy("id").agg(F.min("outcome").alias("right"))
    return changed(rows, right, "_hit", fsrs=F.when(F.col("right"), reviewed(3, as_of, False)).otherwise(reviewed(1, as_of, True)))


def merged_into(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, into: where each memory goes that is lost. Of each pair the more salient (then the smaller id) is kept; a
    memory goes to the most similar one that is kept over it, and on to where that goes, until one that is not lost."""
    s = rows.select("id", F.coalesce("salience", F.lit(0.0)).alias("s"))
    p = pairs.join(s.toDF("id_a", "s_a"), "id_a").join(s.toDF("id_b", "s_b"), "id_b")
    a_kept = (F.col("s_a") > F.col("s_b")) | ((F.col("s_a") == F.col("s_b")) & (F.col("id_a") < F.col("id_b")))
    lost = p.select(F.when(a_kept, F.col("id_b")).otherwise(F.col("id_a")).alias("id"), F.when(a_kept, F.col("id_a")).otherwise(F.col("id_b")).alias("into"), "similarity")
    lost = materialize(top_k(lost, 1, ["id"], F.desc("similarity"), "into").select("id", "into"), "lost")
    while True:  # the way grows twofold a round
        on = lost.select(F.col("id").alias("into"), F.col("into").alias("further"))
        if lost.join(on, "into", "left_semi").isEmpty():
            return lost
        lost = materialize(lost.join(on, "into", "left").select("id", F.coalesce("further", "into").alias("into")), "lost")


def merge_duplicates(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: id_a, id_b, similarity. The memory that others go to, over any number of steps, takes their source files
    and the highest access count and salience; the others fade with salience 0."""
    lost = merged_into(rows, pairs)
    gained = lost.join(rows.select("id", "source_files", "access_count", "salience"), "id").groupBy(F.col("into").alias("id")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("source_files", F.array().cast("array<string>")))))).alias("more_files"),
        F.max("access_count").alias("more_access"), F.max("salience").alias("more_salience"),
    )
    kept = changed(rows, gained, "_hit", source_files=F.array_union(F.coalesce("source_files", F.array().cast("array<string>")), "more_files"), access_count=F.greatest("access_count", "more_access"), salience=F.greatest("salience", "more_salience"))
    return changed(kept, lost.select("id"), "_hit", faded=F.lit(True), salience=F.lit(0.0))


def believe(rows: DataFrame, revisions: DataFrame, embed: Embed = hashed_embedding, as_of: dt.datetime = AS_OF) -> tuple[DataFrame, DataFrame]:
    """revisions: id, new_definition, reason, valid_from, at. The rows with the latest definition and its embedding, and
    the belief log: concept_id, old_definition, new_definition, reason, changed_at, valid_from, one row a revision, each
    from the definition before it. Revisions of unknown ids change nothing."""
    known = revisions.join(rows.select("id", "definition"), "id")
    earlier = F.lag("new_definition").over(Window.partitionBy("id").orderBy("at", "new_definition"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("at", "new_definition"))
    log = known.withColumn("old_definition", F.when(nth == 1, F.col("definition")).otherwise(earlier))
    log = log.select(F.col("id").alias("concept_id"), "old_definition", "new_definition", "reason", F.coalesce("at", now(as_of)).alias("changed_at"), "valid_from")
    last = known.groupBy("id").agg(F.max_by("new_definition", F.struct("at", "new_definition")).alias("new_definition"))
    return changed(rows, last, "_hit", definition=F.col("new_definition"), embedding=embed(F.col("new_definition")), updated_at=now(as_of)), log


def linked(edges: DataFrame, proposals: DataFrame, memories: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """proposals (source_id, target_id, relation, weight) with `error`: why each is no new edge, null if it is one.
    A null relation is `related`, a null weight 0.7; weights are kept within 0.1 and 1. Repeats of a proposal are one."""
    p = proposals.select("source_id", "target_id", F.coalesce("relation", F.lit("related")).alias("relation"), clamp(F.coalesce("weight", F.lit(0.7)), 0.1, 1.0).alias("weight"))
    p = p.groupBy("source_id", "target_id", "relation").agg(F.max("weight").alias("weight"))
    ids = memories.select(F.col("id").alias("_id")).distinct()
    for end in ("source_id", "target_id"):
        p = p.join(ids.select(F.col("_id").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    there = edges.select("source_id", "target_id", "relation", F.lit(True).alias("there")).distinct()
    p = p.join(there, ["source_id", "target_id", "relation"], "left")
    error = (
        F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), "no ids").when(~F.col("relation").isin(*relations), "no such relation")
        .when(F.col("has_source_id").isNull(), "no such source").when(F.col("has_target_id").isNull(), "no such target").when(F.col("there"), "there already")
    )
    return p.select("source_id", "target_id", "relation", "weight", error.alias("error"))


def contradicted(rows: DataFrame, verdicts: DataFrame, as_of: dt.datetime = AS_OF) -> DataFrame:
    """verdicts: id, verdict, confidence. Each genuine contradiction takes 0.15 times its confidence (half of that if
    it is null, for one that was forced) from the memory's confidence, down to 0.1."""
    taken = verdicts.where("verdict = 'genuine'").groupBy("id").agg(F.sum(penalty(F.coalesce("confidence", F.lit(0.5)))).alias("taken")).where("taken > 0")
    return changed(rows, taken, "_hit", confidence=F.greatest(F.lit(0.1), F.coalesce("confidence", F.lit(0.5)) - F.col("taken")), updated_at=now(as_of))


def reconsidered(rows: DataFrame, reviews: DataFrame, as_of: dt.datetime = AS_OF) -> tuple[DataFrame, DataFrame]:
    """reviews: id (unique), concern, penalty, revised_definition, of entrenched memories. The rows with confidence lower
    by the penalty (within 0 and 0.25, if above 0.05; down to 0.1) and the revised definition, if it differs; and the
    signals: concept_id, type TENSION, priority, of each concern."""
    p = F.least(F.lit(0.25), F.greatest(F.lit(0.0), F.coalesce("penalty", F.lit(0.0))))
    new = F.nullif(F.btrim("revised_definition"), F.lit(""))
    r = reviews.select("id", "concern", p.alias("taken"), new.alias("revised"))
    differs = F.col("revised").isNotNull() & (F.col("revised") != F.btrim(F.coalesce("definition", F.lit(""))))
    lower = F.col("taken") > 0.05
    out = changed(
        rows, r, "_hit", confidence=F.when(lower, F.greatest(F.lit(0.1), F.col("confidence") - F.col("taken"))).otherwise(F.col("confidence")),
        definition=F.when(differs, F.col("revised")).otherwise(F.col("definition")), updated_at=F.when(lower | differs, now(as_of)).otherwise(F.col("updated_at")),
    )
    signals = r.where("concern is not null").select(F.col("id").alias("concept_id"), F.lit("TENSION").alias("type"), F.least(F.lit(0.8), F.col("taken") * 4 + 0.3).alias("priority"))
    return out, signals


def noted(texts: DataFrame, kind: str) -> DataFrame:
    """Observation rows of wondered (`interrogative`), guessed (`speculative`) or noticed (`raw`) texts: id, content,
    content_type, salience, processed. Blank texts give none; a noticed one has a salience of 0.3, others of 0.5."""
    content = F.btrim("content")
    return texts.where(F.length(content) > 0).select("id", content.alias("content"), F.when(F.lit(kind) != "raw", F.lit(kind)).alias("content_type"), F.lit(0.3 if kind == "raw" else 0.5).alias("salience"), F.lit(False).alias("processed"))


def created_memories(observations: DataFrame, effects: DataFrame) -> DataFrame:
    """The memories that observations (id, content, salience, embedding) become at once by observed(): a derived name,
    the content as definition, its category, five keywords as tags."""
    made = observations.join(effects.where("effect = 'create'").select("id"), "id", "left_semi")
    return made.select(
        "id", derive_name("content").alias("name"), F.col("content").alias("definition"), infer_category("content").alias("category"), "salience",
        F.lit(0.7).alias("confidence"), F.lit(1).alias("access_count"), "embedding", keywords("content", 5).alias("tags"), F.lit("organic").alias("memory_origin"),
    )


def observed(observations: DataFrame, gates: DataFrame, sure: float = 0.7) -> DataFrame:
    """What the gate makes of new observations: id, effect, memory_id, prediction_error, surprising.

    observations: id, salience. gates: query_id, decision, max_similarity, nearest_id; an observation that has none is
    novel. A merge touches the nearest memory, a link leaves the observation to consolidation, a novel one that is
    salient becomes a memory at once. The error is null where nothing is alike."""
    g = observations.join(gates.withColumnRenamed("query_id", "id"), "id", "left")
    decision, best = F.coalesce("decision", F.lit("novel")), F.coalesce("max_similarity", F.lit(0.0))
    error = F.when(best > 0, F.floor((1 - best) * 1000 + 0.5) / 1000)
    effect = F.when(decision == "merge", "touch").when((decision == "novel") & (F.col("salience") >= sure), "create").otherwise("keep")
    return g.select("id", effect.alias("effect"), "nearest_id", error.alias("prediction_error"), F.coalesce(error >= 0.5, F.lit(False)).alias("surprising")).withColumnRenamed("nearest_id", "memory_id")
