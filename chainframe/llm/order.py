"""Positions of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.llm.text import written

#: fixed: the width of the row counter inside Spark's monotonically increasing ids
_ROW_BITS = 33
#: runs (one row a task and tree, under 60 bytes) up to this number may be broadcast: 6 MB
_MOST_RUNS = 100_000


def numbered_rows(df: DataFrame, name: str, column: str = "row") -> DataFrame:
    """``df`` written once with a number per row, the same in every later reading. It tells
    repeated rows and rows without an id apart."""
    return written(df.withColumn(column, F.monotonically_increasing_id()), name)


def ranked(rows: DataFrame, tree: str, order: list[Column], name: str, per_task: int = 250_000) -> DataFrame:
    """``rows`` (a stored table) with ``pos``, a row's place from 0 among the rows of one
    ``tree`` (a column without nulls), and ``n``, their number. ``order`` must be total: end it
    with a row number.

    Rows are range-partitioned by (tree, order), so a tree of any size lies in many tasks of at
    most about ``per_task`` rows; places inside a task are shifted by the counts of the earlier
    ones, of which there is one row a task and tree."""
    spark = rows.sparkSession
    total = rows.count()
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 1000)
    ranged = rows.repartitionByRange(max(1, few, -(-total // per_task)), F.col(tree), *order)
    placed = written(ranged.sortWithinPartitions(F.col(tree), *order).withColumn("_m", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_task", F.shiftright("_m", _ROW_BITS))
    runs = placed.groupBy(tree, "_task").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(tree)
    earlier = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.select(tree, "_task", "_first", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
                               F.sum("_c").over(whole).alias("n")), f"{name}-runs")
    if runs.count() <= _MOST_RUNS:
        runs = F.broadcast(runs)
    out = placed.join(runs, [tree, "_task"])
    return out.withColumn("pos", F.col("_m") - F.col("_first") + F.col("_before")).drop("_m", "_task", "_first", "_before")
