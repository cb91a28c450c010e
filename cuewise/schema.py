"""The segment relation: ordered, timed pieces of text of a media item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "struct<word:string,start:double,end:double>"
WORDS = f"array<{WORD}>"
SEGMENT = f"media_id string, seg_idx int, start double, end double, text string, words {WORDS}"
COLUMNS = ["media_id", "seg_idx", "start", "end", "text", "words"]


def no_words() -> Column:
    return F.array().cast(WORDS)


def worded(words: Column) -> Column:
    """One null for ``words`` if there are some: all that those need who only ask whether there are, and next to nothing to shuffle."""
    return F.transform(F.slice(words, 1, 1), lambda w: F.lit(None).cast(WORD))


def by_position() -> Window:
    """Segments of a media item in their order, which is seg_idx and not start."""
    return Window.partitionBy("media_id").orderBy("seg_idx")


def as_segments(df: DataFrame) -> DataFrame:
    """``df`` with exactly the segment columns; missing words become an empty list."""
    words = no_words()
    kind = dict(df.dtypes).get("words", "")
    if kind == WORDS:
        words = F.coalesce("words", words)
    elif kind.startswith("array<struct"):
        # By name: a cast would go by position, and readers order fields as they like.
        by_name = F.transform("words", lambda w: F.struct(*[w[f].cast(k).alias(f) for f, k in (("word", "string"), ("start", "double"), ("end", "double"))]))
        words = F.coalesce(by_name, words)
    kinds = {"media_id": "string", "seg_idx": "int", "start": "double", "end": "double", "text": "string"}
    return df.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], words.alias("words"))


def reindex(df: DataFrame, *order: str) -> DataFrame:
    """Renumbers seg_idx from 0 within each media item, by ``order`` (seg_idx by itself if none is given)."""
    at = Window.partitionBy("media_id").orderBy(*(order or ("seg_idx",)))
    return df.withColumn("seg_idx", (F.row_number().over(at) - 1).cast("int")).select(*COLUMNS)
