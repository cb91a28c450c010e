"""Scans over a media item's segments in their order, for items of any length.

A window by media item puts each item into one task, which is right for many short ones. With ``chunk`` an item is cut into chunks
of so many positions, which are dealt out by themselves: the scan runs within chunks, each chunk reduces to one border row (its
first and last segment, its total), a window over those carries on from chunk to chunk, and a join brings it back. Results
are the same. An item of n segments then is n / chunk tasks' work and n / chunk border rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.schema import by_position
from cuewise.sources.tables import dealt

CHUNK = "__chunk"


def _chunked(df: DataFrame, chunk: int) -> tuple[DataFrame, Window]:
    if CHUNK not in df.columns:
        df = dealt(df.withColumn(CHUNK, F.floor(F.col("seg_idx") / chunk)), "media_id", CHUNK)
    return df, Window.partitionBy("media_id", CHUNK).orderBy("seg_idx")


def _carried(rows: DataFrame, borders: DataFrame, carry: str) -> DataFrame:
    """``rows`` with the column ``carry`` of their chunk's border."""
    keys = borders.select(F.col("media_id").alias("__m"), F.col(CHUNK).alias("__c"), carry)
    return rows.join(keys, F.col("media_id").eqNullSafe(F.col("__m")) & (F.col(CHUNK) == F.col("__c")), "left").drop("__m", "__c")


def with_before(df: DataFrame, columns: list[str], name: str = "before", chunk: int | None = None) -> DataFrame:
    """``df`` with a struct of ``columns`` of the segment before each; null for the first of a media item."""
    row = F.struct(*columns)
    if chunk is None:
        return df.withColumn(name, F.lag(row).over(by_position()))
    rows, within = _chunked(df, chunk)
    over = Window.partitionBy("media_id").orderBy(CHUNK)
    borders = rows.groupBy("media_id", CHUNK).agg(F.max_by(row, "seg_idx").alias("__last")).withColumn("__carry", F.lag("__last").over(over))
    return _carried(rows.withColumn(name, F.lag(row).over(within)), borders, "__carry").withColumn(name, F.coalesce(name, "__carry")).drop("__carry")


def running_sum(df: DataFrame, value: Column, name: str, chunk: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the segments up to each."""
    if chunk is None:
        return df.withColumn("__value", value).withColumn(name, F.sum("__value").over(by_position())).drop("__value")
    rows, within = _chunked(df.withColumn("__value", value), chunk)
    ahead = Window.partitionBy("media_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    borders = rows.groupBy("media_id", CHUNK).agg(F.sum("__value").alias("__total")).withColumn("__carry", F.coalesce(F.sum("__total").over(ahead), F.lit(0)))
    own = F.sum("__value").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return _carried(rows.withColumn(name, own), borders, "__carry").withColumn(name, F.col(name) + F.col("__carry")).drop("__carry", "__value")


def numbered(df: DataFrame, name: str, chunk: int | None = None) -> DataFrame:
    """``df`` with each segment's place in its media item, from 1."""
    if chunk is None:
        return df.withColumn(name, F.row_number().over(by_position()))
    return running_sum(df, F.lit(1), name, chunk)
