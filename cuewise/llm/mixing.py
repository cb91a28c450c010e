"""Mixing sources to target weights: Efraimidis-Spirakis sampling, complete epochs first. [native]

A source's target is a number of words. The whole epochs that fit are taken from every document; what
is left is a budget for one fractional pass, in which documents come in ascending order of their
exponential key -ln(u) / w (u from a hash of doc_id, w the document's quality) until the running size
meets the budget. Of the document at the boundary, ``taken`` counts the words that are still missing;
``copies``, for those who mix whole documents, counts it if that brings the sum nearer to the budget.

The order within a source is (key, doc_id, size, hash of the text). It is found without putting a source into one task:
a range partitioning of all rows by source and that order gives bins of about ROWS_PER_BIN rows whatever the keys'
distribution, sums of the bins give each bin's offset, and a window runs within (source, bin). Quality is the share of
letters in the text, between 0.05 and 1.

Whole documents are mixed without moving texts: each source has one boundary row, and a document's own order
against it says whether it is in the fractional pass.

Defined cases: null or blank text has size 0 and is never taken; a null source is a source of its own,
ranked last; a null doc_id hashes as the empty text; very long texts count whole; repeated rows have equal keys and each
counts, in any order (``mixed_documents`` takes all of those that tie with the boundary row); an empty table gives
an empty result; columns other than doc_id, source and text are ignored, and pass through ``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.llm.common import WORD_PATTERN, durable, order_key

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
ROWS_PER_BIN = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) with ``target``: ``share`` of all sizes split by weight, none above ``most`` times its size.

    Resharing the excess by weight until none is above has a closed form: with sources in order of
    cap / weight, the first k are at their caps and the others share the rest by weight; k is the least
    for which the next source is not above its cap. One row a source, so the windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    every = Window.partitionBy()
    caps = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.lit(most) * F.col("source_size"))
    caps = caps.withColumn("goal", F.lit(share) * F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    caps = caps.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    caps = caps.withColumn("water", level.over(every)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return caps.select("source", "source_size", "weight", F.round(target, 6).alias("target"))


def _measured(docs: DataFrame) -> list[Column]:
    """size, text_hash and key of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    quality = F.greatest(F.lit(0.05), letters / F.greatest(F.length(text), F.lit(1)))
    uniform = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    return [F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"), (-F.log(uniform) / quality).alias("key")]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), copies (of the whole document), text_hash."""
    return _mixed(docs, weights, share, most).select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "text_hash")


def _mixed(docs: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """What ``mix_sources`` returns, with key, epochs and more (1 for the documents of the fractional pass)."""
    rows = durable(docs.select("doc_id", "source", *_measured(docs), order_key("doc_id").alias("at"), F.monotonically_increasing_id().alias("row")))
    order = ["key", "at", "size", "text_hash"]
    bins = max(1, math.ceil(rows.count() / ROWS_PER_BIN))
    rows = durable(rows.repartitionByRange(bins, "source", *order, "row").withColumn("bin", F.spark_partition_id()))

    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("s"))
    off = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, most)
    plan = sums.select(F.col("source").alias("__s"), F.col("bin").alias("__b"), off.alias("off"))
    plan = plan.join(targets.withColumnRenamed("source", "__t"), F.col("__s").eqNullSafe(F.col("__t"))).drop("__t", "weight")

    running = F.sum("size").over(Window.partitionBy("source", "bin").orderBy(*order, "row").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__run", running).join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bin") == F.col("__b")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    ahead = F.col("off") + F.col("__run") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.round(F.col("budget")).cast("long") - ahead))
    rows = rows.withColumn("more", (2 * ahead + F.col("size") <= 2 * F.col("budget")).cast("long"))
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.col("more")).otherwise(F.lit(0)).cast("long")
    return rows.withColumn("taken", F.col("size") * F.col("epochs") + part).withColumn("copies", copies)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with all its columns: each document as many times as the mix has copies of it.

    The boundaries, a row a source, are joined without a hint: Spark broadcasts them where their size allows for it.
    """
    mix = _mixed(docs.select("doc_id", "source", "text"), weights, share, most)
    last = F.max(F.when((F.col("more") == 1) & (F.col("size") > 0), F.struct("key", "at", "size", "text_hash")))
    ends = durable(mix.groupBy("source").agg(F.max("epochs").alias("epochs"), last.alias("last")))
    ends = ends.select(F.struct("source", "epochs", "last").alias("__mix_end"))
    size, text_hash, key = _measured(docs)
    own = F.struct(key, order_key("doc_id").alias("at"), size, text_hash)
    placed = docs.withColumn("__mix_own", own).join(ends, F.col("source").eqNullSafe(F.col("__mix_end.source")))
    more = F.coalesce(F.col("__mix_own") <= F.col("__mix_end.last"), F.lit(False)).cast("int")
    copies = F.when(F.col("__mix_own.size") > 0, F.col("__mix_end.epochs").cast("int") + more).otherwise(0)
    return placed.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), copies)).alias("__mix_copy")).select(*docs.columns)
