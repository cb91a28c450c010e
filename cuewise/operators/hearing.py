"""What is heard around each segment: a range join of segments with the words of a table, in buckets of time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.sources.tables import dealt

BUCKET = 30.0
HEARD = "array<struct<start:double,end:double,word:string>>"


def with_heard(df: DataFrame, words: DataFrame, low: Column, high: Column, bucket: float = BUCKET) -> DataFrame:
    """``df`` with ``heard``: the words (media_id, word, start, end) that overlap (low, high), by start, end and word.

    Words are listed by bucket of time, segments go to each bucket that their window touches (with their columns to the
    first alone) and come together again by (media_id, seg_idx): nothing is gathered by media item, and both
    tables are read once. Without words, or where ``low`` or ``high`` is null, ``heard`` is empty.
    """
    slot = lambda t: F.floor(t / bucket)
    timed = words.where("start is not null and end is not null")
    touched = F.sequence(slot(F.least("start", "end")), slot(F.greatest("start", "end")))
    word = F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("word"))
    listed = timed.select("media_id", F.explode(touched).alias("__b"), word.alias("w")).groupBy("media_id", "__b").agg(F.collect_list("w").alias("__words"))

    window = df.withColumns({"__low": low, "__high": high})
    buckets = F.when(F.col("__low") < F.col("__high"), F.sequence(slot(F.col("__low")), slot(F.col("__high"))))
    copies = window.withColumn("__first", slot(F.col("__low"))).select("*", F.explode_outer(buckets).alias("__b"))
    row = F.when(F.col("__b").isNull() | (F.col("__b") == F.col("__first")), F.struct(*df.columns))
    copies = copies.select("media_id", "seg_idx", "__low", "__high", "__first", "__b", row.alias("__row"))
    met = copies.join(listed, ["media_id", "__b"], "left")
    # A word that touches several buckets of the window counts in the first of them.
    own = lambda w: (w["start"] < F.col("__high")) & (w["end"] > F.col("__low")) & (F.greatest(slot(F.least(w["start"], w["end"])), F.col("__first")) == F.col("__b"))
    part = F.coalesce(F.filter("__words", own), F.array().cast(HEARD))
    found = dealt(met.select("media_id", "seg_idx", "__row", part.alias("__part")), "media_id", "seg_idx").groupBy("media_id", "seg_idx")
    whole = found.agg(F.first("__row", ignorenulls=True).alias("__row"), F.array_sort(F.flatten(F.collect_list("__part"))).alias("heard"))
    return whole.select("__row.*", "heard")


SLICE = 256  # rows whose words a task holds as Python objects at once


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows: a batch's words are small as Arrow arrays and many times as large as Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def heard_lists(batch: pa.RecordBatch) -> list[list[tuple[float, float, str]]]:
    """The column ``heard`` of a batch as lists of (start, end, word)."""
    column = batch.column("heard")
    flat, at = column.flatten(), column.offsets.to_pylist()
    words = list(zip(*[flat.field(c).to_pylist() for c in ("start", "end", "word")], strict=True))
    return [words[a - at[0] : b - at[0]] for a, b in zip(at, at[1:], strict=False)]
