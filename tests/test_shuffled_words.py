"""Words are many times as large as their text: they are made behind a shuffle, and don't go through one that nobody reads them behind."""

import pytest
from pyspark.sql import functions as F

from cuewise.operators import merge, split
from cuewise.operators.cues import vtt_cues
from cuewise.plans import adapters, queries
from cuewise.plans.pipeline import Pipeline

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_made_behind_the_shuffle(spark):
    lines = queries.lines(spark, SF)
    made = adapters.dealt_with_words(lines)
    assert sorted(made.collect()) == sorted(adapters.with_words(lines).collect())
    plan = plan_of(merge.merge_incomplete_segments(made))
    assert plan.count("hashpartitioning(media_id") == 1 and "ArrowEvalPython" not in plan
    # What comes before the shuffle stands below it in the plan.
    assert "(?<= )" not in plan[plan.index("hashpartitioning(media_id") :]


def test_words_of_odd_lines(spark, segments):
    df = segments((0, 1, ""), (1, 2, " "), (2, 2, "a  b "), (3, 5, "é " * 700), (5, 4, "one"))
    assert sorted(adapters.dealt_with_words(df).collect()) == sorted(adapters.with_words(df).collect())


@pytest.mark.parametrize("enable", [True, False])
def test_cues_without_the_words_behind_the_splitter(spark, segments, enable):
    texts = ["one, two", "a. b. c " * 9, "x", "x", "the same", "the same", "", "all rights", "ha" * 30, "end"]
    df = adapters.with_words(segments(*[(i, i + 0.9, t) for i, t in enumerate(texts)]))
    df = df.unionByName(segments((0, 2, "no words, here"), (4, 6, "nor here " * 12), media="n"))
    config = {
        "segment_merging": {"incomplete_markers": [","]},
        "segment_splitting": {"enable": enable, "max_line_length": 20, "primary_breaks": ["."]},
        "hallucination_filter": {"phrase_filter": {"enable": True, "patterns": ["^all"]}, "consecutive_duplicates": {"enable": True}, "timing_validation": {"enable": True, "max_chars_per_second": 200}},
        "final_cleanup": {"global_word_filter": {"enable": True}},
    }
    plan = Pipeline(config)
    assert sorted(plan.cues(df).collect()) == sorted(vtt_cues(plan.transform(df)).collect())


def test_split_without_words(spark, segments):
    df = adapters.with_words(segments((0, 9, "a. b. c " * 9), (9, 10, "short"))).unionByName(segments((0, 1, "none"), media="n"))
    df = df.unionByName(df.where("media_id = 'n'").withColumn("words", F.lit(None).cast(df.schema["words"].dataType)).withColumn("seg_idx", F.lit(7)))
    get = lambda keep: sorted(split.split_segments(df, 20, (".",), (",",), keep_words=keep).collect())
    full, cut = get(True), get(False)
    assert [r[:5] for r in full] == [r[:5] for r in cut] and len(full) > 4
    assert [r["words"] and [None] for r in full] == [r["words"] for r in cut]
