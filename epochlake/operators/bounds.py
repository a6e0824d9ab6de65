"""Checks of size before anything is broadcast, and running values over ordered rows without one task for a whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a narrow table that may be broadcast.
BROADCAST_ROWS = 100_000
#: Span of the order column whose rows one task orders.
SPAN = 1 << 26


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df for a broadcast if it has at most `most` rows, which are fetched now, so that nothing computes them again; else df, for
    a shuffled join."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def with_previous(rows: DataFrame, group: str, order: str, value: Column, out: str, span: int = SPAN, last_known: bool = False) -> DataFrame:
    """rows with a column `out`: the value of the row before in the same group, by `order`, a long.

    last_known: the last value up to and including the row that isn't null. A group is cut into spans of `order`, so that no
    task orders a whole group; each span starts from what the spans before it end with, one row each.
    """
    if out in rows.columns:
        raise ValueError(f"there is a column {out} already")
    cut = F.floor(F.col(order) / span)
    rows = rows.withColumn("_value", value).withColumn("_span", cut)
    known = F.col("_value").isNotNull() if last_known else F.lit(True)
    ends = rows.filter(known).groupBy(group, "_span").agg(F.max_by(F.struct("_value"), F.struct(order)).alias("_end"))
    spans = rows.select(group, "_span").distinct().join(ends, [group, "_span"], "left")
    before = Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(F.col(group).alias("_group"), F.col("_span").alias("_at"), F.last("_end", ignorenulls=True).over(before)["_value"].alias("_carried"))
    inside = Window.partitionBy(group, "_span").orderBy(order)
    if last_known:
        own = F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        local = rows.withColumn("_own", own)
        joined = local.join(carried, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_span") == F.col("_at")), "left")
        return joined.withColumn(out, F.coalesce("_own", "_carried")).drop("_own", "_value", "_span", "_group", "_at", "_carried")
    local = rows.withColumn("_own", F.lag("_value").over(inside)).withColumn("_nth", F.row_number().over(inside))
    joined = local.join(carried, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_span") == F.col("_at")), "left")
    return joined.withColumn(out, F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_own"))).drop("_own", "_nth", "_value", "_span", "_group", "_at", "_carried")
