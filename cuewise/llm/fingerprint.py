"""Canonical exact digests of documents. [native]

A text is canonical after Unicode normalisation (NFKC, by the ICU library that Spark ships, called
as a SQL function), lower-casing and folding of white space. Its digest is 128 bits wide: two XXH64
with different seeds. Documents fall into buckets by digest; in buckets of several documents the canonical
bytes are compared, and texts that differ there get a longer fingerprint, so that a fingerprint stands
for one canonical text.

Which documents share a bucket is known from the digests alone. Only their texts, found by a blocked
Bloom filter of bounded size over the shared digests, travel for the comparison, and a bucket reduces to its
smallest and largest bytes on the map side, so a hot bucket is no burden.

Defined cases: null text is the empty text; a null doc_id ranks lowest; of rows with equal doc_id the
larger XXH64 of the text comes first, and equal rows are in any order; very long texts count whole; with one row, it follows itself; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.llm.common import durable, even, join_groups, order_key, range_bins
from cuewise.llm.url_filter import bloom_filter, maybe_in

ROWS_PER_BIN = 4_000
BLOOM_BLOCKS = 1 << 16


def canonical(text: Column) -> Column:
    """NFKC, lower case, each run of white space one space, none at the ends."""
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.trim(F.regexp_replace(F.lower(composed), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """32 hex digits: XXH64 of the text after each of two different seeds."""
    halves = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0") for seed in (1, 2)]
    return F.concat(*halves)


def with_next(docs: DataFrame, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """doc_id, text, next: each document's text and that of the next one by descending doc_id, in a ring.

    Bins are ranges of doc_id and, where many rows share one, of a hash of the text. The top row of each bin is copied as a guest to the end of the bin above
    it (that of the topmost to the lowest), so one shuffle by bin does it and no task holds more than a bin.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", order_key("doc_id").alias("at"), text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = range_bins(rows, "at", rows_per_bin, even(F.col("tie")))
    tops = {r["bin"]: tuple(r["top"]) for r in rows.groupBy("bin").agg(F.max(F.struct("at", "tie")).alias("top")).collect()}
    order = sorted(tops)
    above = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    pairs = [(*tops[b], above[b]) for b in order]
    if not pairs:
        return rows.select("doc_id", "text", F.col("text").alias("next"))
    # One row a bin: at most 2 * MAX_BINS rows of 20 bytes.
    guests = docs.sparkSession.createDataFrame(pairs, "at long, tie long, bin int")
    guest = rows.drop("bin").join(F.broadcast(guests), ["at", "tie"]).select("doc_id", "at", "tie", "text", "bin", F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guest)
    order_by = Window.partitionBy("bin").orderBy("guest", F.col("at").desc(), F.col("tie").desc())
    return both.withColumn("next", F.lead("text").over(order_by)).where("not guest").select("doc_id", "text", "next")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id, copies.

    The edited text has its last floor(n/2) code points replaced by as many of the next document's
    first ones (or all). Likeness of exact digests is 1 where the canonical bytes are equal, else 0.
    ``group_id`` is the smallest doc_id of the documents with the same fingerprint, ``copies`` their number.
    """
    ring = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    ring = ring.select("doc_id", "text", "next", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half)).alias("edited"))
    rows = ring.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "next", canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("canon_edited"))
    next_canon = canonical(F.col("next"))
    rows = rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("canon")).alias("wide"),
        digest(F.col("canon_edited")).alias("edited_wide"),
        (F.col("canon") == F.col("canon_edited")).cast("double").alias("near_edited"),
        # Equal raw texts need no second normalisation.
        F.when(F.col("text") == F.col("next"), 1.0).otherwise((F.col("canon") == next_canon).cast("double")).alias("near_next"),
        F.sha2("canon", 256).alias("longer"),
        F.sha2("canon_edited", 256).alias("edited_longer"),
    )
    rows = durable(rows)

    # Hardly ever a row: different texts would have to share 128 bits.
    differ = durable(colliding(docs, rows))
    if differ.take(1):
        rows = rows.join(differ.select("wide", F.lit(True).alias("__c")), "wide", "left")
    else:
        rows = rows.withColumn("__c", F.lit(None).cast("boolean"))
    rows = rows.withColumn("fingerprint", F.when(F.col("__c"), F.concat("wide", "longer")).otherwise(F.col("wide")))
    # An edited text whose digest is its own document's but whose bytes differ is told apart too.
    odd = (F.col("edited_wide") == F.col("wide")) & (F.col("near_edited") == 0)
    edited = F.when(odd | ((F.col("edited_wide") == F.col("wide")) & F.col("__c").isNotNull()), F.concat("edited_wide", "edited_longer")).otherwise(F.col("edited_wide"))
    rows = rows.withColumn("edited_fingerprint", edited)
    rows = durable(rows)
    groups = durable(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies")))
    return join_groups(rows, groups, "fingerprint", "copies", rows.count()).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "copies"
    )


def colliding(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """The digests (``wide``) whose bucket holds different canonical bytes: none, but for a collision.

    ``digests`` has a row with ``wide`` for each document.
    """
    shared = digests.groupBy("wide").agg(F.count("*").alias("n")).where("n > 1").select("wide")
    texts = docs.select(canonical(F.coalesce("text", F.lit(""))).alias("canon")).withColumn("wide", digest(F.col("canon")))
    likely = maybe_in(texts, "wide", bloom_filter(shared, "wide", BLOOM_BLOCKS), blocks=BLOOM_BLOCKS).where("maybe")
    ends = likely.groupBy("wide").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    return ends.where("low != high").select("wide")
