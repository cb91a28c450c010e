"""WebVTT cues: which segments are written, their numbers and their times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.text import format_timestamp, strip
from cuewise.operators.scan import numbered, with_before


def vtt_cues(df: DataFrame, chunk: int | None = None) -> DataFrame:
    """media_id, cue, start, end, text, timing: a row for each segment with text, numbered from 1.

    A cue without words starts where the one before it ends, be it gap or overlap. ``chunk``: see ``scan``.
    """
    shown = df.withColumn("text", strip(F.col("text"))).where("text != ''")
    shown = numbered(with_before(shown, ["end"], "__before", chunk), "cue", chunk)
    start = F.when(F.size("words") == 0, F.coalesce(F.col("__before.end"), F.col("start"))).otherwise(F.col("start"))
    rows = shown.select("media_id", F.col("cue").cast("int").alias("cue"), start.alias("start"), "end", "text")
    return rows.withColumn("timing", F.concat(format_timestamp(F.col("start")), F.lit(" --> "), format_timestamp(F.col("end"))))


def vtt_files(cues: DataFrame) -> DataFrame:
    """media_id, content: the text of each media item's file."""
    block = F.concat(F.col("cue").cast("string"), F.lit("\n"), F.col("timing"), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("cue", block.alias("block"))))
    made = cues.groupBy("media_id").agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "").alias("body"))
    return made.select("media_id", F.concat(F.lit("WEBVTT\n\n"), F.col("body")).alias("content"))


def batches(df: DataFrame, size: int) -> DataFrame:
    """``df`` with ``batch_id`` and ``pos``: chunks of ``size`` segments of a media item by position."""
    at = F.row_number().over(Window.partitionBy("media_id").orderBy("seg_idx")) - 1
    size = max(1, size)
    return df.withColumn("__at", at).withColumn("batch_id", F.floor(F.col("__at") / size).cast("int")).withColumn("pos", (F.col("__at") % size).cast("int")).drop("__at")
