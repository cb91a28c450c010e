"""Filters of invented text: phrases and implausible speaking rates, with optional second recognition."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cuewise.functions.similarity import text_similarity
from cuewise.functions.text import normalize_text
from cuewise.operators.hearing import heard_lists, slices, with_heard
from cuewise.operators.merge import merge_single_char_segments, remove_consecutive_duplicates
from cuewise.operators.models import STRICT, Recogniser, RecogniserFactory
from cuewise.schema import COLUMNS, SEGMENT, WORDS, reindex

LOUDEST_SECONDS = 0.1
SAME = 0.75
HEARD_WORDS = pa.list_(pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64())]))
_NORMALIZE = re.compile(r"[\s、。！？…\.,!?]+")


def phrase_patterns(config: dict) -> list[str]:
    """``patterns``, or if there are none the older ``phrases`` (whole normalised texts) and ``regex_patterns``.

    Patterns that don't compile are left out.
    """
    found = list(config.get("patterns") or [])
    if not found:
        exact = [_NORMALIZE.sub("", p).strip() for p in config.get("phrases", [])]
        found = [f"^{re.escape(p)}$" for p in exact if p] + list(config.get("regex_patterns", []))
    out = []
    for pattern in found:
        try:
            re.compile(pattern)
            out.append(pattern)
        except re.error:
            continue
    return out


def matches_phrase(text: Column, patterns: list[str]) -> Column:
    """Whether a pattern is found in the normalised text; never in a null one."""
    # A list of one, so that the text is normalised once and not for each pattern.
    found = F.exists(F.array(normalize_text(text)), lambda clean: reduce(lambda a, b: a | b, [clean.rlike(p) for p in patterns], F.lit(False)))
    return F.coalesce(found, F.lit(False))


def remove_phrases(df: DataFrame, patterns: list[str], recogniser: RecogniserFactory | None = None, truth: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Drops the segments that match a pattern.

    With a recogniser, a match is recognised again: without speech, with much the same text or with a text that
    still matches it goes; else the new text stays (and with ``compat`` the old one too).
    """
    if not patterns:
        return df
    struck = matches_phrase(F.col("text"), patterns)
    if recogniser is None:
        return reindex(df.where(~struck))
    rows = revalidate(df, recogniser, truth, struck)
    clean = lambda c: F.when(F.col("again"), normalize_text(F.col(c)))
    differs = F.col("new_text").isNotNull() & _similarity_below(clean("text"), clean("new_text")) & ~matches_phrase(F.col("new_text"), patterns)
    old = F.struct(F.col("text"), F.col("words"), F.lit(1).alias("n"))
    new = F.struct(F.col("new_text").alias("text"), F.col("new_words").alias("words"), F.lit(0).alias("n"))
    out = F.when(~F.col("again"), F.array(old)).when(differs, F.array(new, old) if compat else F.array(new))
    made = rows.select("media_id", "seg_idx", "start", "end", F.explode(out).alias("r")).select("media_id", "seg_idx", "start", "end", "r.*")
    return reindex(made, "seg_idx", "n")


@F.arrow_udf(BooleanType())
def _similarity_below(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([text_similarity(x, y) < SAME for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())


def is_suspicious(max_rate: float = 20.0) -> Column:
    """Too many characters a second, or under one a second in a text of more than five; a null text is not."""
    rate = F.try_divide(F.length("text"), F.col("end") - F.col("start"))
    return F.coalesce((rate > max_rate) | ((rate < 1.0) & (F.length("text") > 5)), F.lit(False))


def validate_timing(df: DataFrame, max_rate: float = 20.0, recogniser: RecogniserFactory | None = None, truth: DataFrame | None = None) -> DataFrame:
    """Drops segments without duration, and suspicious ones unless a recogniser hears speech there, whose text they get."""
    timed = df.where("end > start")
    if recogniser is None:
        return reindex(timed.where(~is_suspicious(max_rate)))
    return _renewed(revalidate(timed, recogniser, truth, is_suspicious(max_rate)))


def needs_second_look(max_rate: float = 20.0) -> Column:
    """Too fast, very short for its text, or a longer text without words."""
    seconds = F.col("end") - F.col("start")
    n = F.length("text")
    return (F.try_divide(n, seconds) > max_rate) | ((seconds < 0.3) & (n > 5)) | ((F.size("words") == 0) & (n > 10))


def revalidate_segments(df: DataFrame, recogniser: RecogniserFactory, truth: DataFrame | None = None, max_rate: float = 20.0) -> DataFrame:
    """Segments that need a second look get what is heard in their time; those without speech go."""
    return _renewed(revalidate(df, recogniser, truth, needs_second_look(max_rate)))


def revalidate(df: DataFrame, recogniser: RecogniserFactory, truth: DataFrame | None = None, only: Column | None = None) -> DataFrame:
    """``df`` with again, new_text and new_words: what strict recognition hears in the time of the segments for which ``only`` holds.

    Null text: no speech. A slice under 0.1 s, or an error, keeps the text and loses the words. Others have neither.
    ``truth``, if given, holds rows (media_id, word, start, end), of which ``recogniser`` gets those in a segment's time;
    else it gets None, once a task.
    """
    again = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    rows = df.select(*COLUMNS, again.alias("again"))
    table = truth is not None
    if table:
        rows = with_heard(rows, truth, F.when(F.col("again"), F.col("start")), F.col("end"))

    def hear(own: Recogniser, media: str, start: float, end: float, text: str) -> tuple[str | None, list]:
        try:
            if end - start < LOUDEST_SECONDS:
                raise ValueError("too short to recognise")
            heard = own.transcribe(media, start, end, True, STRICT)
            new = "".join(s["text"].strip() for s in heard["segments"])
            words = [{**w, "start": w["start"] + start, "end": w["end"] + start} for s in heard["segments"] for w in s["words"]]
            return (new, words) if new else (None, [])
        except Exception:  # the segment stays as it was, whatever the recogniser raised
            return text, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = None if table else recogniser(None)
        for batch in slices(batches):
            heard = heard_lists(batch) if table else [None] * batch.num_rows
            flagged = [batch.column(c).to_pylist() for c in ("again", "media_id", "start", "end", "text")]
            new = [hear(shared or recogniser(w), *row) if yes else (None, None) for (yes, *row), w in zip(zip(*flagged, strict=True), heard, strict=True)]
            own = [*COLUMNS, "again"]
            made = [pa.array([n[0] for n in new], pa.string()), pa.array([n[1] for n in new], HEARD_WORDS)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *made], [*own, "new_text", "new_words"])

    return rows.mapInArrow(run, f"{SEGMENT}, again boolean, new_text string, new_words {WORDS}")


def _renewed(rows: DataFrame) -> DataFrame:
    """Of rows that were looked at again those with speech stay, with what was heard; others as they are."""
    renewed = rows.where("not again or new_text is not null")
    pick = lambda new, old: F.when(F.col("again"), F.col(new)).otherwise(F.col(old)).alias(old)
    return reindex(renewed.select("media_id", "seg_idx", "start", "end", pick("new_text", "text"), pick("new_words", "words")))


def filter_invented(df: DataFrame, config: dict, recogniser: RecogniserFactory | None = None, truth: DataFrame | None = None, watch: Callable[[str, DataFrame], DataFrame] = lambda step, df: df) -> DataFrame:
    """The filters in their order: phrases, duplicates, single characters, timing, then phrases and duplicates again.

    They run again only for media items that lost rows to the timing filter, or for all if it recognises again. ``watch``
    gets each step's name and rows, and gives them back.
    """
    phrases, repeats, timing = config["phrase_filter"], config["consecutive_duplicates"], config["timing_validation"]
    patterns = phrase_patterns(phrases) if phrases.get("enable") else []
    out = df
    if patterns:
        out = watch("phrases", remove_phrases(out, patterns, recogniser if phrases.get("enable_revalidate") else None, truth))
    if repeats.get("enable"):
        out = watch("duplicates", remove_consecutive_duplicates(out))
    out = watch("single characters", merge_single_char_segments(out))
    if not timing.get("enable"):
        return out
    max_rate, again = timing.get("max_chars_per_second", 20), bool(timing.get("enable_revalidate"))
    if again and recogniser is not None:
        return watch("again", _again(watch("timing", validate_timing(out, max_rate, recogniser, truth)), patterns, repeats, F.lit(True)))
    from pyspark.sql import Window

    dropped = ~F.coalesce((F.col("end") > F.col("start")) & ~is_suspicious(max_rate), F.lit(False))
    lost = F.max(dropped).over(Window.partitionBy("media_id"))
    marked = out.withColumn("__lost", lost | F.lit(again)).withColumn("__dropped", dropped).where(~F.col("__dropped")).drop("__dropped")
    return watch("again", _again(watch("timing", marked), patterns, repeats, F.col("__lost")))


def _again(df: DataFrame, patterns: list[str], repeats: dict, only: Column) -> DataFrame:
    """Phrases and duplicates once more, where ``only`` holds."""
    out = df
    if patterns:
        out = out.where(~(only & matches_phrase(F.col("text"), patterns)))
    if repeats.get("enable"):
        return remove_consecutive_duplicates(out, only)
    return reindex(out)


