"""Scans in chunks give what windows by media item give."""

import random

import pytest
from pyspark.sql import functions as F

from cuewise.operators import cues, merge, scan
from cuewise.schema import SEGMENT


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    out = []
    for media, n in (("long", 400), ("short", 3), (None, 30)):
        at = 0.0
        for i in range(n):
            if rng.random() < 0.9:  # positions have gaps, some as long as chunks
                words = [("w", at, at + 1)] if rng.random() < 0.5 else []
                out.append((media, i + (40 if i > 200 else 0), at, at + rng.choice([0.4, 1.0]), rng.choice(["あ", "あ", "い", "行って", "来た", " あ ", "", None]), words))
            at += rng.choice([0.5, 1.0, 1.2])
    return spark.createDataFrame(out, SEGMENT).repartition(5)


def listed(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_chunks_change_nothing(rows, chunk):
    for operator in (merge.remove_consecutive_duplicates, merge.merge_incomplete_segments, merge.merge_single_char_segments, cues.vtt_cues):
        assert listed(operator(rows, chunk=chunk)) == listed(operator(rows)), operator.__name__
    only = F.col("seg_idx") % 3 != 0
    assert listed(merge.remove_consecutive_duplicates(rows, only, chunk)) == listed(merge.remove_consecutive_duplicates(rows, only))
    back = lambda c: scan.with_before(rows, ["text", "end"], "b", c).select("media_id", "seg_idx", "b.*")
    assert listed(back(chunk)) == listed(back(None))
    total = lambda c: scan.running_sum(rows, F.length(F.coalesce("text", F.lit(""))), "t", c).select("media_id", "seg_idx", "t")
    assert listed(total(chunk)) == listed(total(None))


def test_one_item_is_spread_over_tasks(spark):
    df = spark.range(40_000).select(F.lit("m").alias("media_id"), F.col("id").cast("int").alias("seg_idx"), F.col("id").cast("double").alias("start"), (F.col("id") + 0.5).alias("end"), (F.col("id") % 7).cast("string").alias("text"), F.array().cast("array<struct<word:string,start:double,end:double>>").alias("words"))
    parts = scan.running_sum(df, F.lit(1), "n", 1000).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 30_000
    plan = merge.remove_consecutive_duplicates(df, chunk=1000)._jdf.queryExecution().executedPlan().toString()
    import re

    assert not [w for w in re.findall(r"Window \[.*?\], \[(media_id#\d+)\], \[seg_idx", plan)]


def test_nothing(rows):
    assert merge.remove_consecutive_duplicates(rows.limit(0), chunk=5).count() == 0 == cues.vtt_cues(rows.limit(0), chunk=5).count()
