"""Scores as columns: vector likeness, spaced-repetition scheduling, ratings."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All clocks stand here unless a query is given another time.
AS_OF = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
# Weights of the public FSRS-5 scheduler as used here, and its target retention.
W = (0.4072, 1.1829, 3.1262, 15.4722, 7.2102, 0.5316, 1.0651, 0.0589, 1.506, 0.14, 1.0036, 1.9395, 0.11, 0.2918, 0.5, 1.0, 2.0)
RETENTION = 0.9
FACTOR = 0.9**-2 - 1


def now(as_of: dt.datetime = AS_OF) -> Column:
    return F.lit(as_of).cast("timestamp")


def days_since(t: Column | str, as_of: dt.datetime = AS_OF) -> Column:
    """Days as a fraction; 0 for null."""
    return F.coalesce((F.unix_micros(now(as_of)) - F.unix_micros(t)) / 86_400_000_000, F.lit(0.0))


def rounded(c: Column, places: int) -> Column:
    """Half up, as floor(x * 10^places + 0.5)."""
    return F.floor(c * 10**places + 0.5) / 10**places


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    bound = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(c, bound(low)), bound(high))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if a norm is 0; null if the lengths differ or an element is null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))


def retrievability(stability: Column, days: Column) -> Column:
    """Probability of recall: a power law that is 1 at 0 days and the retention at `stability` days."""
    return F.pow(1 + FACTOR * days / stability, F.lit(-0.5))


def exponential_retrievability(stability: Column, days: Column, reviewed: Column) -> Column:
    """The exponential curve of the concept listing; 0 for what was never reviewed."""
    return F.when(reviewed, F.pow(F.lit(0.9), days / stability)).otherwise(0.0)


def next_difficulty(d: Column, rating: Column) -> Column:
    return clamp(d - W[6] * (rating - 3) + W[7] * (W[4] - d), 1.0, 10.0)


def schedule(state: Column, stability: Column, difficulty: Column, rating: Column, days: Column) -> Column:
    """struct(stability, difficulty, interval_days, state) after a review rated 1 (again) to 4 (easy)."""
    fresh = state == "new"
    r = retrievability(stability, days)
    d = F.when(fresh, W[4] - W[5] * (rating - 3)).otherwise(next_difficulty(difficulty, rating))
    initial = F.greatest(F.element_at(F.array(*[F.lit(w) for w in W[:4]]), rating.cast("int")), F.lit(0.1))
    bonus = F.when(rating == 2, W[15]).when(rating == 4, W[16]).otherwise(1.0)
    recalled = stability * (math.exp(W[8]) * (11 - d) * F.pow(stability, F.lit(-W[9])) * (F.exp((1 - r) * W[10]) - 1) * bonus) + stability
    forgotten = W[11] * F.pow(d, F.lit(-W[12])) * (F.pow(stability + 1, F.lit(W[13])) - 1) * F.exp((1 - r) * W[14])
    s = F.when(fresh, initial).when(rating == 1, forgotten).otherwise(recalled)
    then = F.when(rating == 1, "relearning").when(fresh, "learning").otherwise("review")
    return F.struct(s.alias("stability"), d.alias("difficulty"), F.greatest(F.lit(1), F.floor(s + 0.5)).cast("bigint").alias("interval_days"), then.alias("state"))


def consolidation_rating(accessed_days: Column, state: Column, score: Column, hops: Column, contradicted: Column) -> Column:
    """1 to 4: 3 if lately accessed, else 2; up for a close direct hit, down for a far or indirect one, down if
    contradicted. Each step is kept within 1 to 4."""
    base = F.when(accessed_days <= F.when(state == "relearning", 1).otherwise(3), 3).otherwise(2)
    up = F.when((score > 0.92) & (F.coalesce(hops, F.lit(0)) == 0), 1).otherwise(0)
    down = F.when(F.coalesce(score < 0.75, F.lit(False)) | F.coalesce(hops > 0, F.lit(False)), 1).otherwise(0)
    return clamp(clamp(clamp(base + up, 1, 4) - down, 1, 4) - F.when(contradicted, 1).otherwise(0), 1, 4).cast("int")


def due(state: Column, stability: Column, last_review: Column, as_of: dt.datetime = AS_OF) -> Column:
    least = F.when(state.isin("learning", "relearning"), 0.5).otherwise(1.0)
    return state.isin("review", "learning", "relearning") & (last_review.isNull() | (days_since(last_review, as_of) >= F.greatest(least, 0.8 * stability)))


def average_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    gamma = 0.5772156649
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(n - 1) + gamma) - 2 * (n - 1) / n)


def epistemic(access_count: Column, confidence: Column, category: Column, accessed_days: Column) -> Column:
    """How much a memory invites a visit (without the random part)."""
    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    return yes(access_count < 3, 0.3) + yes(confidence < 0.5, 0.2) + yes(category == "goal", 0.4) + yes(accessed_days > 14, 0.2)
