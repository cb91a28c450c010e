"""Merging neighbours: gaps and islands over a media item's segments.

``chunk`` cuts media items into chunks of so many segments (see ``scan``), for items too long for one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.functions.text import strip
from cuewise.operators.scan import CHUNK, running_sum, with_before
from cuewise.schema import COLUMNS, by_position, no_words, reindex

#: Endings of a segment whose sentence goes on.
INCOMPLETE = ("て", "で", "と", "が", "けど", "ども", "たり")


def islands(df: DataFrame, columns: list[str], continues: Callable[[Column], Column], name: str = "island", chunk: int | None = None) -> DataFrame:
    """Numbers from 1 the runs of rows in which each but the first ``continues`` the one before it, of which it gets ``columns``."""
    rows = with_before(df, columns, "__before", chunk)
    fresh = F.when(F.coalesce(continues(F.col("__before")), F.lit(False)), 0).otherwise(1)
    return running_sum(rows, fresh, name, chunk).drop("__before", CHUNK)


def _runs(df: DataFrame) -> DataFrame:
    """One row an island: its rows in order, as ``run``."""
    row = F.struct("seg_idx", "start", "end", "text", "words")
    return df.groupBy("media_id", "island").agg(F.array_sort(F.collect_list(row)).alias("run"))


def _emit(runs: DataFrame, text: Column, words: Column) -> DataFrame:
    first, last = F.col("run")[0], F.element_at("run", -1)
    # Islands are numbered as segments are, but from 1.
    number = (F.col("island") - 1).cast("int")
    return runs.select("media_id", number.alias("seg_idx"), first["start"].alias("start"), last["end"].alias("end"), text.alias("text"), words.alias("words"))


def merge_incomplete_segments(df: DataFrame, markers: tuple[str, ...] = INCOMPLETE, max_gap: float = 0.5, max_length: int = 30, chunk: int | None = None) -> DataFrame:
    """Joins a segment to the one before it if that ends with a marker, is near, and both are short enough.

    The length is that of the two neighbours, so a chain may get longer. A merged segment has words only if all of
    its parts have; a segment that merges with none stays as it is.
    """

    def goes_on(before: Column) -> Column:
        text = strip(before["text"])
        open_ended = reduce(lambda a, b: a | b, [text.endswith(m) for m in markers], F.lit(False))
        near = F.col("start") - before["end"] < max_gap
        return open_ended & near & (F.length(text) + F.length(strip(F.col("text"))) <= max_length)

    runs = _runs(islands(df, ["text", "end"], goes_on, chunk=chunk))
    single = F.size("run") == 1
    joined = F.array_join(F.transform("run", lambda s: strip(s["text"])), "")
    words = F.flatten(F.transform("run", lambda s: s["words"]))
    full = F.forall("run", lambda s: F.coalesce(F.size(s["words"]) > 0, F.lit(False)))
    return _emit(runs, F.when(single, F.col("run")[0]["text"]).otherwise(joined), F.when(single, F.col("run")[0]["words"]).when(full, words).otherwise(no_words()))


def remove_consecutive_duplicates(df: DataFrame, only: Column | None = None, chunk: int | None = None) -> DataFrame:
    """Each run of equal trimmed texts becomes one segment: first start, last end, the first one's words.

    Where ``only`` is false, rows stay apart and untouched. Needs no list of the run's rows.
    """
    rows = df.withColumn("__text", strip(F.col("text")))
    same = lambda before: F.col("__text") == before["__text"]
    rows = islands(rows, ["__text"], same if only is None else lambda before: same(before) & only, chunk=chunk)
    text = F.col("__text") if only is None else F.when(only, F.col("__text")).otherwise(F.col("text"))
    first = lambda c: F.min_by(c, "seg_idx")
    out = rows.withColumn("text", text).groupBy("media_id", "island").agg(first("start").alias("start"), F.max_by("end", "seg_idx").alias("end"), first("text").alias("text"), first("words").alias("words"))
    return out.withColumn("seg_idx", (F.col("island") - 1).cast("int")).select(*COLUMNS)


def merge_single_char_segments(df: DataFrame, compat: bool = False, chunk: int | None = None) -> DataFrame:
    """Runs of the same one-character text are joined with 、 and their words put together; all texts are trimmed.

    ``compat`` also takes in the words of the row that ends the run, as the original does.
    """
    rows = islands(df.withColumn("text", strip(F.col("text"))), ["text"], lambda before: (F.length("text") == 1) & (F.col("text") == before["text"]), chunk=chunk)
    if compat:
        rows = rows.withColumn("__after", F.lead("words").over(by_position()))
    row = F.struct("seg_idx", "start", "end", "text", "words", *(["__after"] if compat else []))
    runs = rows.groupBy("media_id", "island").agg(F.array_sort(F.collect_list(row)).alias("run"))
    words = F.flatten(F.transform("run", lambda s: s["words"]))
    if compat:
        words = F.concat(words, F.coalesce(F.element_at("run", -1)["__after"], no_words()))
    single = F.size("run") == 1
    joined = F.array_join(F.transform("run", lambda s: s["text"]), "、")
    return _emit(runs, F.when(single, F.col("run")[0]["text"]).otherwise(joined), F.when(single, F.col("run")[0]["words"]).otherwise(words))


def merge_segments(conversation: DataFrame, sound: DataFrame, bucket: float = 60.0) -> DataFrame:
    """All of ``conversation`` and those of ``sound`` that overlap none of it, by start.

    The overlap is an interval anti-join on (media_id, time bucket): both sides list the buckets that they
    touch, so a long media item spreads over many tasks. Equal starts: conversation first.
    """

    def touched(df: DataFrame) -> Column:
        low, high = F.floor(F.least("start", "end") / bucket), F.floor(F.greatest("start", "end") / bucket)
        return F.explode(F.sequence(low, high)).alias("b")

    left = sound.select("media_id", "seg_idx", "start", "end", touched(sound))
    right = conversation.select("media_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"), touched(conversation))
    meets = (F.col("end") > F.col("c_start")) & (F.col("start") < F.col("c_end"))
    struck = left.join(right, ["media_id", "b"]).where(meets).select("media_id", "seg_idx").distinct()
    rest = sound.join(struck, ["media_id", "seg_idx"], "left_anti")
    both = conversation.withColumn("__side", F.lit(0)).unionByName(rest.withColumn("__side", F.lit(1)))
    return reindex(both, "start", "__side", "seg_idx")


def neighbour_overlaps(df: DataFrame, min_gap: float = 0.1) -> DataFrame:
    """media_id, seg_idx, overlaps_prev, overlaps_next: whether a segment comes within ``min_gap`` of a neighbour."""
    at = by_position()
    before = F.coalesce(F.col("start") < F.lag("end").over(at) + min_gap, F.lit(False))
    after = F.coalesce(F.col("end") > F.lead("start").over(at) - min_gap, F.lit(False))
    return df.select("media_id", "seg_idx", before.alias("overlaps_prev"), after.alias("overlaps_next"))
