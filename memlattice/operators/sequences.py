"""Rows in the order of time within a key, without bringing a hot key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def previous(rows: DataFrame, by: list[str], chunk: str, order: list[str], column: str, name: str) -> DataFrame:
    """rows with `name`: the column's value in the row before, within `by`, in the order of `chunk` and then of `order`;
    null for the first row. The chunks (a day, say, in the order of time) of a key are tasks of their own; of each only
    its last value goes on to the next."""
    inside = Window.partitionBy(*by, chunk).orderBy(*order)
    last = rows.groupBy(*by, chunk).agg(F.max_by(column, F.struct(*order)).alias("_last"))
    carried = last.select(*by, chunk, F.lag("_last").over(Window.partitionBy(*by).orderBy(chunk)).alias("_carried"))  # one row a chunk
    numbered = rows.withColumns({"_n": F.row_number().over(inside), name: F.lag(column).over(inside)})
    joined = numbered.join(carried, [*by, chunk])
    return joined.withColumn(name, F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col(name))).drop("_n", "_carried")
