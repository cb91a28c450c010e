"""Splitting long segments: one row to many, without a shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from cuewise.functions import text as T
from cuewise.schema import WORDS, no_words, reindex, worded

#: Breaks of segments with word timings.
PRIMARY = ("。", "？", "！", "?", "!")
SECONDARY = ("、", "わ", "ね", "よ")
AHEAD = 10

PIECES = f"array<struct<start:double,end:double,text:string,words:{WORDS}>>"


def word_edges(words: list[str], most: int, primary: tuple[str, ...], secondary: tuple[str, ...]) -> list[int]:
    """Where the pieces of a list of words begin and end: 0, the cuts, the number of words.

    A piece ends after a word with a primary break; once it has ``most`` characters and no primary break
    is among the next AHEAD words, also after a word with a secondary break. It is never cut elsewhere.
    """
    ends = [any(b in w for b in primary) for w in words]
    edges, length = [0], 0
    for i, w in enumerate(words, 1):
        length += len(w)
        soft = length >= most and not any(ends[i : i + AHEAD]) and any(b in w for b in secondary)
        if ends[i - 1] or soft:
            edges.append(i)
            length = 0
    return edges if edges[-1] == len(words) else [*edges, len(words)]


def _edges(long: Column, worded: Column, most: int, primary: tuple[str, ...], secondary: tuple[str, ...], char_primary: tuple[str, ...], char_secondary: tuple[str, ...]) -> Column:
    """Positions where long segments are cut, in words or in characters; null for others, of which no text travels to the UDF."""
    hard, soft = frozenset(char_primary), frozenset(char_secondary)

    @F.pandas_udf(ArrayType(IntegerType()))
    def edges(words: pd.Series, texts: pd.Series) -> pd.Series:
        cut = lambda w, t: word_edges(list(w), most, primary, secondary) if w is not None else None if t is None else T.piece_edges(t, most, hard, soft)
        return pd.Series(list(map(cut, words, texts)), dtype=object)

    own = F.transform("words", lambda w: F.coalesce(w["word"], F.lit("")))
    return edges(F.when(long & worded, own), F.when(long & ~worded, F.col("text")))


def _by_words(edges: Column) -> Column:
    def piece(a: Column, b: Column) -> Column:
        own = F.slice("words", a + 1, b - a)
        text = F.array_join(F.transform(own, lambda w: w["word"]), "")
        return F.struct(own[0]["start"].alias("start"), F.element_at(own, -1)["end"].alias("end"), text.alias("text"), own.alias("words"))

    return T.between(edges, piece).cast(PIECES)


def _by_characters(edges: Column, text: Column) -> Column:
    """Pieces with times in proportion to their characters."""
    start, end, n = F.col("start"), F.col("end"), F.element_at(edges, -1)  # the last edge is the text's length
    at = lambda k: start + (end - start) * (k / n)
    row = lambda a, b: F.struct(at(a).alias("start"), F.least(at(b), end).alias("end"), F.substring(text, a + 1, b - a).alias("text"), no_words().alias("words"))
    return T.between(edges, row).cast(PIECES)


def split_segments(
    df: DataFrame,
    max_length: int = 30,
    primary: tuple[str, ...] = PRIMARY,
    secondary: tuple[str, ...] = SECONDARY,
    char_primary: tuple[str, ...] = T.PRIMARY_BREAKS,
    char_secondary: tuple[str, ...] = T.SECONDARY_BREAKS,
    keep_words: bool = True,
) -> DataFrame:
    """Segments of more than ``max_length`` trimmed characters, split by their words, or by characters if they have none.

    One projection: what comes before stands in the plan once, and only the renumbering shuffles. A null text stays as
    it is; null words count as none. Without ``keep_words`` a segment's words are cut down to whether it has some,
    before they are shuffled.
    """
    rows = df.withColumn("text", T.strip(F.col("text")))
    long = F.coalesce(F.length("text") > max_length, F.lit(False))
    timed = F.coalesce(F.size("words") > 0, F.lit(False))
    cut = rows.withColumn("edges", _edges(long, timed, max_length, primary, secondary, char_primary, char_secondary))
    whole = F.array(F.struct("start", "end", "text", "words")).cast(PIECES)
    pieces = F.when(~long, whole).when(timed, _by_words(F.col("edges"))).otherwise(_by_characters(F.col("edges"), F.col("text")))
    # Outer: else the optimizer repeats the whole expression in a filter on its size.
    made = cut.select("media_id", "seg_idx", F.posexplode_outer(pieces).alias("sub_idx", "piece"))
    out = made.select("media_id", "seg_idx", "sub_idx", "piece.*")
    return reindex(out if keep_words else out.withColumn("words", worded(F.col("words"))), "seg_idx", "sub_idx")


def bypass_split(df: DataFrame) -> DataFrame:
    """The projection that stands in for a disabled splitter: trimmed text, words never null."""
    return df.withColumns({"text": T.strip(F.col("text")), "words": F.coalesce(F.col("words"), no_words())})
