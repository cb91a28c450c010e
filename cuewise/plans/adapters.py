"""Segments from other tables: lines of documents, turns of conversations, events of users."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cuewise.functions.text import code_points, offsets
from cuewise.schema import COLUMNS, WORDS, no_words
from cuewise.sources.tables import dealt

#: Characters a second of the synthetic clock.
CLOCK = 15.0


def _timed(rows: DataFrame) -> DataFrame:
    """Rows (media_id, seg_idx, text) with times in proportion to their lengths."""
    before = Window.partitionBy("media_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    rows = rows.withColumn("start", ahead / CLOCK).withColumn("end", (ahead + F.length("text")) / CLOCK)
    return rows.withColumn("words", no_words()).select(*COLUMNS)


def seg_lines(documents: DataFrame) -> DataFrame:
    """One segment a line; an explode, so the clock is taken from the line lengths before it."""
    lines = documents.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    placed = lines.withColumn("lengths", F.transform("lines", F.length)).withColumn("at", offsets(F.col("lengths")))
    rows = placed.select(F.col("doc_id").cast("string").alias("media_id"), F.posexplode(F.arrays_zip(F.col("lines").alias("line"), "at")).alias("seg_idx", "row"))
    start, text = F.col("row.at") / CLOCK, F.col("row.line")
    return rows.select("media_id", "seg_idx", start.alias("start"), ((F.col("row.at") + F.length(text)) / CLOCK).alias("end"), text.alias("text"), no_words().alias("words"))


def seg_turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("string").alias("media_id"), F.col("turn").cast("int").alias("seg_idx"), F.coalesce("text", F.lit("")).alias("text"))
    return _timed(dealt(rows, "media_id"))


def seg_events(events: DataFrame) -> DataFrame:
    """One segment an event of a user, from its time for ``value`` seconds."""
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)) / 1e6
    rows = events.select(F.col("user_id").cast("string").alias("media_id"), (F.row_number().over(at) - 1).cast("int").alias("seg_idx"), start.alias("start"), F.col("event_type").alias("text"), "value")
    return rows.select("media_id", "seg_idx", "start", (F.col("start") + F.col("value")).alias("end"), "text", no_words().alias("words"))


def piece_times(texts: pa.Array, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Of each text the times at which its pieces up to a space begin, and its end, in proportion to characters; in arrays, without objects a word."""
    points, edges = code_points(texts.cast(pa.binary()).to_pylist())
    lengths = np.diff(edges)
    after = np.flatnonzero(points == ord(" ")) + 1
    row = np.searchsorted(edges[1:], after - 1, side="right")
    inner = after < edges[1:][row]
    after, row = after[inner], row[inner]
    within = np.bincount(row, minlength=len(lengths))
    offsets = np.concatenate([[0], np.cumsum(1 + within + (lengths > 0))])
    places = np.zeros(offsets[-1])
    places[offsets[row] + 1 + np.arange(len(row)) - np.repeat(np.cumsum(within) - within, within)] = after - edges[row]
    places[(offsets[1:] - 1)[lengths > 0]] = lengths[lengths > 0]
    each = np.repeat(np.arange(len(lengths)), np.diff(offsets))
    found = starts[each] + (ends - starts)[each] * (places / np.maximum(1, lengths)[each])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found))


def with_words(df: DataFrame) -> DataFrame:
    """Segments with a word for each piece up to a space, timed by characters; ``text`` is never null.

    The text is cut in one pass and the times come from a UDF: a lambda that mentions the text, or a time made
    from its length, would read it again for each word.
    """

    @F.arrow_udf(ArrayType(DoubleType()))
    def times(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return piece_times(texts, *[x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (starts, ends)])

    pieces = F.filter(F.split("text", "(?<= )"), lambda p: p != "")
    at = F.col("__times")
    word = lambda p, i: F.struct(p.alias("word"), F.element_at(at, i + 1).alias("start"), F.element_at(at, i + 2).alias("end"))
    return df.withColumn("__times", times("text", "start", "end")).withColumn("words", F.transform(pieces, word).cast(WORDS)).select(*COLUMNS)


def dealt_with_words(df: DataFrame) -> DataFrame:
    """``with_words``, made behind the shuffle by media item, so that the texts alone go through it and not their words.

    Spark takes what a UDF returns for rows in no known places and would shuffle them again, so the times are an
    expression here. Rows are sorted before they get their words, too.
    """
    rows = dealt(df, "media_id").sortWithinPartitions("media_id", "seg_idx")
    pieces = F.filter(F.split("text", "(?<= )"), lambda p: p != "")
    rows = rows.withColumn("__pieces", pieces).withColumn("__lengths", F.transform("__pieces", F.length)).withColumn("__at", offsets(F.col("__lengths")))
    # A list of one, so that the text's length is taken once and not for each word.
    whole = F.array(F.struct("start", (F.col("end") - F.col("start")).alias("span"), F.length("text").alias("n"), F.greatest(F.length("text"), F.lit(1)).cast("double").alias("by")))
    timed = F.transform(whole, lambda s: F.transform(F.concat("__at", F.array(s["n"])), lambda k: s["start"] + s["span"] * (k / s["by"])))
    rows = rows.withColumn("__times", timed[0])
    word = lambda p, i: F.struct(p.alias("word"), F.element_at("__times", i + 1).alias("start"), F.element_at("__times", i + 2).alias("end"))
    return rows.withColumn("words", F.transform("__pieces", word).cast(WORDS)).select(*COLUMNS)


def word_table(df: DataFrame) -> DataFrame:
    """(media_id, word, start, end): the words of segments, for a recogniser that reads a table."""
    return df.select("media_id", F.explode("words").alias("w")).select("media_id", "w.word", "w.start", "w.end")
