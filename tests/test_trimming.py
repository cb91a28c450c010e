"""Trimming and short tokens look at a text's ends; both agree with the patterns that read it whole."""

import random
import re

from pyspark.sql import functions as F

from cuewise.functions import text as T
from cuewise.operators import cleanup, filters


def test_white_space_is_that_of_the_pattern(spark):
    points = [chr(i) for i in range(0x1_0000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(c,) for c in points], "c string")
    assert {r["c"] for r in rows.where(F.col("c").rlike(r"(?U)^\s")).collect()} == set(T.WHITE_SPACE)


def test_trimming_and_short_tokens_agree_with_patterns(spark):
    rng = random.Random(11)
    alphabet = "aab、 \n　 \x85é😀​"
    texts = [None, "", " \n ", "、", *["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(3_000)]]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("whole", F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    token = cleanup.only_token(F.col("text"))
    rows = rows.select("*", T.strip(F.col("text")).alias("ends"), F.when(F.length(token) <= 3, token).alias("slow"), cleanup.short_token(F.col("text"), 3).alias("fast"))
    found = rows.collect()
    assert all(r["whole"] == r["ends"] and r["slow"] == r["fast"] for r in found)
    assert sum(r["fast"] is not None for r in found) > 100


def test_the_hot_path_reads_texts_once(spark):
    rows = spark.createDataFrame([(" a ",)], "text string")
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan(T.strip(F.col("text")))
    assert len(re.findall("regexp_replace", plan(filters.matches_phrase(F.col("text"), ["a", "b", "c"])))) == 1
