"""Predicates, upserts and comparisons of whole tables."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERED = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def rule(field: str, op: str, value: Any) -> Column:
    """One of == != < <= > >= in array-contains. == null finds nulls, != keeps them unless it is != null; comparisons
    are typed."""
    c = F.col(field)
    if op == "==":
        return c.isNull() if value is None else F.coalesce(c == value, F.lit(False))
    if op == "!=":
        return c.isNotNull() if value is None else F.coalesce(c != value, F.lit(True))
    if op in ORDERED:
        return getattr(c, ORDERED[op])(value)
    if op == "in":
        return c.isin(*value)
    if op == "array-contains":
        return F.array_contains(c, value)
    raise ValueError(f"no such operator: {op}")


def generic_query(df: DataFrame, rules: list[tuple[str, str, Any]], order: str | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Rows that satisfy all rules; ordered by a column (nulls last either way, then id) and limited if asked."""
    for r in rules:
        df = df.where(rule(*r))
    if order:
        df = df.orderBy(F.desc_nulls_last(order) if descending else F.asc_nulls_last(order), "id")
    return df.limit(limit) if limit is not None else df


def ops_filter(kind: str | None = None, status: str | None = None, not_status: str | None = None, project: str | None = None, keyword: str | None = None, since: Column | None = None, exclude_expired: Column | None = None) -> Column:
    """All given conditions; keyword: in the content or in a keyword, whatever the case."""
    all_ = [F.lit(True)]
    if kind:
        all_.append(F.col("type") == kind)
    if status:
        all_.append(F.col("status") == status)
    if not_status:
        all_.append(F.col("status") != not_status)
    if project:
        all_.append(F.col("project") == project)
    if keyword:
        k = keyword.lower()
        all_.append(F.lower("content").contains(k) | F.coalesce(F.exists("keywords", lambda x: F.lower(x).contains(k)), F.lit(False)))
    if since is not None:
        all_.append(F.col("created_at") >= since)
    if exclude_expired is not None:
        all_.append(F.col("expires_at").isNull() | (F.col("expires_at") > exclude_expired))
    return reduce(lambda a, b: a & b, all_)


def condition(text: str, fields: list[str]) -> Column:
    """`field op literal` as a column: op one of == != >= <= > <, literal true, false, a number, or quoted or bare text.
    A field that isn't among `fields` gives false; order comparisons are for numbers."""
    found = re.fullmatch(r"\s*(\w+)\s*(==|!=|>=|<=|>|<)\s*(.+?)\s*", text)
    if not found or found[1] not in fields:
        return F.lit(False)
    field, op, literal = found.groups()
    if literal in ("true", "false"):
        value: Any = literal == "true"
    elif re.fullmatch(r"-?\d+(\.\d+)?", literal):
        value = float(literal)
    else:
        value = literal[1:-1] if len(literal) > 1 and literal[0] == literal[-1] and literal[0] in "'\"" else literal
    if op in ORDERED and not isinstance(value, float):
        return F.lit(False)
    return F.coalesce(rule(field, op, value), F.lit(False))


def template(text: str, fields: list[str]) -> Column:
    """{{field}} replaced by its value; of unknown fields and nulls the braces stay."""
    out = F.lit(text)
    for f in fields:
        out = F.replace(out, F.lit(f"{{{{{f}}}}}"), F.coalesce(F.col(f).cast("string"), F.lit(f"{{{{{f}}}}}")))
    return out


def upsert(rows: DataFrame, changes: DataFrame, id_column: str) -> DataFrame:
    """rows, with those of changes in place of, or beside, rows of the same id."""
    return rows.join(changes.select(id_column), id_column, "left_anti").unionByName(changes)


def diff(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """kind, n_left, n_right, only_left, only_right: rows counted with repeats, compared by a 128-bit hash of all
    columns, in one shuffle."""
    hashed = lambda df, l, r: df.select(F.xxhash64(*df.columns).alias("a"), F.xxhash64(F.lit(1), *df.columns).alias("b"), F.lit(l).alias("l"), F.lit(r).alias("r"))  # noqa: E731,E741
    both = hashed(left, 1, 0).unionByName(hashed(right.select(*left.columns), 0, 1)).groupBy("a", "b").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return both.agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum(F.greatest(F.lit(0), F.col("l") - F.col("r"))).alias("only_left"), F.sum(F.greatest(F.lit(0), F.col("r") - F.col("l"))).alias("only_right")).select(F.lit(kind).alias("kind"), "*")
