import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuewise.operators import align, cleanup, cues, filters, merge, models, polish, split
from cuewise.schema import SEGMENT


def word(text, start, end):
    return {"word": text, "start": float(start), "end": float(end)}


def test_merge_incomplete(segments, listed):
    df = segments((0, 1, "行って"), (1.2, 2, " きた "), (2.1, 3, "終わり"), (9, 10, "それで"), (11, 12, "遠い"))
    assert listed(merge.merge_incomplete_segments(df)) == [(0, 2, "行ってきた"), (2.1, 3, "終わり"), (9, 10, "それで"), (11, 12, "遠い")]
    assert merge.merge_incomplete_segments(df, max_length=4).count() == 5


def test_merge_keeps_words_only_if_all_have_them(segments):
    w = [word("x", 0, 1)]
    full = merge.merge_incomplete_segments(segments((0, 1, "xて", w), (1, 2, "y", w)))
    part = merge.merge_incomplete_segments(segments((0, 1, "xて", w), (1, 2, "y")))
    assert len(full.first()["words"]) == 2 and part.first()["words"] == []


def test_duplicates(segments, listed):
    df = segments((0, 1, "a"), (1, 2, " a "), (2, 3, "b"), (3, 4, "a"))
    once = merge.remove_consecutive_duplicates(df)
    assert listed(once) == [(0, 2, "a"), (2, 3, "b"), (3, 4, "a")]
    assert listed(merge.remove_consecutive_duplicates(once)) == listed(once)


def test_single_chars(segments, listed):
    w = [word("あ", 0, 1)]
    df = segments((0, 1, "あ", w), (1, 2, "あ"), (2, 3, "いい", w), (3, 4, "い"))
    out = merge.merge_single_char_segments(df)
    assert listed(out) == [(0, 2, "あ、あ"), (2, 3, "いい"), (3, 4, "い")]
    assert [len(r["words"]) for r in out.orderBy("seg_idx").collect()] == [1, 1, 0]
    assert [len(r["words"]) for r in merge.merge_single_char_segments(df, compat=True).orderBy("seg_idx").collect()] == [2, 1, 0]


def test_anti_merge(segments, listed):
    talk, sound = segments((0, 10, "talk"), (100, 300, "long")), segments((5, 6, "in"), (10, 12, "touching"), (250, 251, "inside"), (50, 60, "free"))
    assert listed(merge.merge_segments(talk, sound)) == [(0, 10, "talk"), (10, 12, "touching"), (50, 60, "free"), (100, 300, "long")]


def test_split_by_characters(segments, listed):
    rows = listed(split.split_segments(segments((0, 12, "あいえお。かきくけこ。" * 2)), 5))
    assert len(rows) >= 2 and "".join(r[2] for r in rows) == "あいえお。かきくけこ。" * 2 and rows[-1][1] == pytest.approx(12)
    assert [len(r[2]) for r in listed(split.split_segments(segments((0, 5, "あ" * 50)), 20))] == [25, 25]


def test_split_is_one_projection(spark, segments, listed):
    df = segments((0, 12, "あいえお。かきくけこ。" * 2), (12, 13, "短い"))
    plan = split.split_segments(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan
    odd = df.withColumn("words", F.lit(None).cast("array<struct<word:string,start:double,end:double>>"))
    assert listed(split.split_segments(odd, 5)) == listed(split.split_segments(df, 5))
    none = df.withColumn("text", F.lit(None).cast("string"))
    assert [r[2] for r in listed(split.split_segments(none, 5))] == [None, None]


def test_split_by_words(segments, listed):
    words = [word(t, i, i + 1) for i, t in enumerate(["これは", "長い", "テキスト", "です", "。", "次", "も"])]
    rows = listed(split.split_segments(segments((0, 7, "これは長いテキストです。次も", words)), 5))
    assert rows == [(0, 5, "これは長いテキストです。"), (5, 7, "次も")]
    assert listed(split.split_segments(segments((0, 1, " 短。い ")), 30)) == [(0, 1, "短。い")]


def test_phrases(segments, listed):
    df = segments((0, 1, "ご視聴 ありがとう"), (1, 2, "…。"), (2, 3, "本文"))
    assert listed(filters.remove_phrases(df, filters.phrase_patterns({"patterns": ["ご視聴.*ありがとう", "^[…。、]*$", "("]}))) == [(2, 3, "本文")]
    assert filters.phrase_patterns({"phrases": ["…", "a.b"], "regex_patterns": ["x+"]}) == ["^ab$", "x+"]


def test_phrases_revalidated(spark, segments, listed):
    truth = spark.createDataFrame([("m", "全く違う話", 0.0, 1.0), ("m", "bad", 2.0, 3.0)], "media_id string, word string, start double, end double")
    df = segments((0, 1, "bad"), (2, 3, "bad"), (4, 5, "bad"), (6, 7, "fine"))
    got = filters.remove_phrases(df, ["bad"], models.TableRecogniser, truth)
    assert listed(got) == [(0, 1, "全く違う話"), (6, 7, "fine")]
    assert filters.remove_phrases(df, ["bad"], models.TableRecogniser, truth, compat=True).count() == 3


def test_timing(segments, listed):
    df = segments((0, 1, "ok text"), (1, 1, "none"), (2, 2.1, "far too fast"), (3, 30, "too slow"), (40, 80, "short"))
    assert listed(filters.validate_timing(df)) == [(0, 1, "ok text"), (40, 80, "short")]


def test_filters_run_again_only_where_rows_went(spark):
    config = {"phrase_filter": {"enable": True, "patterns": ["^xx$"]}, "consecutive_duplicates": {}, "timing_validation": {"enable": True}}
    rows = [("a", 0, 0.0, 1.0, "x", []), ("a", 1, 1.0, 2.0, "x", []), ("b", 0, 0.0, 1.0, "x", []), ("b", 1, 1.0, 2.0, "x", []), ("b", 2, 2.0, 2.0, "gone", [])]
    out = filters.filter_invented(spark.createDataFrame(rows, SEGMENT), config)
    assert [(r["media_id"], r["text"]) for r in out.collect()] == [("a", "x、x")]


def test_recurring_words(segments):
    same = segments(*[(i, i + 1, "僕、僕" if i % 2 else "僕") for i in range(12)])
    assert [r["token"] for r in cleanup.recurring_words(same, 12).collect()] == ["僕"]
    assert cleanup.recurring_words(same, 13).count() == 0
    six = segments(*[(i, i + 1, "あ") for i in range(6)])
    assert [r["token"] for r in cleanup.recurring_words(six, None, 5, 10).collect()] == ["あ"]
    apart = segments(*[(i * 100, i * 100 + 1, "あ") for i in range(6)])
    assert cleanup.recurring_words(apart, None, 5, 10).count() == 0
    assert cleanup.recurring_words(segments(*[(t, t + 1, "あ") for t in (0, 1, 2, 3, 60)]), None, 5, 60).count() == 1


def test_rewrite(segments, listed):
    df = segments((0, 1, "僕"), (1, 4, "僕、僕"), (4, 14, "僕"), (14, 15, "僕は"))
    words = cleanup.recurring_words(df, 3)
    assert listed(cleanup.rewrite_recurring_words(df, words)) == [(0, 1, "あ"), (1, 4, "あ、あ"), (4, 14, "あ、あ、あ"), (14, 15, "僕は")]


def test_stammer_parts(segments, listed):
    df = segments((0, 30, "はい" + "う" * 20 + "そうです"), (30, 31, "ああああああああ"), (31, 32, "普通"))
    out = listed(cleanup.filter_stammers(df, {"word_repetition": {"min_repetitions": 30}, "vocalization_replacement": {"enable": True}}))
    assert [r[2] for r in out] == ["はい", "あ、あ、あ", "そうです", "あ", "普通"]
    assert out[1][0] == pytest.approx(30 * 2 / 26) and out[2][1] == pytest.approx(30)
    assert listed(cleanup.filter_stammers(segments((0, 1, "やめて" * 6)))) == [(0, 1, "やめて、やめて、やめて...")]


def test_cues(segments):
    rows = cues.vtt_cues(segments((0, 1, "first"), (1.2, 1.3, "  "), (1.5, 2.5, "second"), (3, 4, "third", [word("third", 3, 4)]))).orderBy("cue").collect()
    assert [(r["cue"], r["timing"]) for r in rows] == [(1, "00:00:00.000 --> 00:00:01.000"), (2, "00:00:01.000 --> 00:00:02.500"), (3, "00:00:03.000 --> 00:00:04.000")]


def test_batches(segments):
    rows = cues.batches(segments(*[(i, i + 1, "t") for i in range(5)]), 2).orderBy("seg_idx").collect()
    assert [(r["batch_id"], r["pos"]) for r in rows] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


TRUTH = [(0.00, 1.88), (2.10, 3.84), (4.08, 5.78), (6.22, 7.60), (7.94, 9.72), (9.98, 11.78), (12.30, 14.04), (14.46, 16.14), (16.52, 17.72), (18.12, 19.52)]
WRONG = [(0.0, 2.2), (2.0, 3.5), (4.5, 5.8), (6.0, 7.9), (7.7, 9.5), (10.3, 11.8), (12.0, 13.8), (14.8, 16.2), (16.3, 17.9), (18.5, 20.0)]
TEXTS = ["1、", "2、", "3、", "4、", "5、", "6、", "7、", "8、", "9、", "10"]


@pytest.mark.parametrize("method", ["time_based", "text_search", "unknown"])
def test_realign(spark, segments, method):
    truth = spark.createDataFrame([("m", t, a, b) for t, (a, b) in zip(TEXTS, TRUTH, strict=True)], "media_id string, word string, start double, end double")
    df = segments(*[(a, b, t) for t, (a, b) in zip(TEXTS, WRONG, strict=True)])
    config = {"method": method, "text_search": {"adjustment_threshold": 0.2, "similarity": 0.75}, "time_based": {"expansion": 10.0, "similarity": 0.75}}
    rows = align.realign_timing(df, config, models.TableRecogniser, truth).orderBy("seg_idx").collect()
    error = lambda spans: sum(abs(a - c) + abs(b - d) for (a, b), (c, d) in zip(spans, TRUTH, strict=True))
    assert [r["text"] for r in rows] == TEXTS
    assert error([(r["start"], r["end"]) for r in rows]) <= error(WRONG) + 1e-9


def test_find_text():
    words = [word("これは", 0, 1), word("長い", 1, 2), word("話です", 2, 3)]
    assert align.find_in_words("長い話です", words, 10.0) == align.Found(11.0, 13.0, 1.0)
    assert align.find_in_words("無関係", words).start is None
    heard = {"segments": [{"start": 0, "end": 1, "text": "ああ", "words": []}, {"start": 1, "end": 3, "text": "長い話です", "words": []}]}
    assert align.find_in_transcription("長い話です。", heard) == align.Found(1, 3, 1.0)


def test_boundary_and_midpoint():
    import pandas as pd

    ear = models.TableRecogniser(pd.DataFrame({"word": ["これは前", "あれは次"], "start": [0.0, 2.0], "end": [2.0, 4.0]}))
    prev, curr = align.Segment(0, 3, "これは前"), align.Segment(1, 4, "あれは次", moved=True)
    assert align.find_boundary(prev, curr, "m", ear) == 2.0
    fixed = align.repair_overlaps([prev, curr], "m", ear, 0.1)
    assert (fixed[0].end, fixed[1].start) == (2.0, 2.1)
    deaf = models.TableRecogniser(None)
    assert align.repair_overlaps([prev, curr], "m", deaf, 0.1)[0].end == 2.0


class Failing:
    """Fails on batches, answers single lines."""

    def generate(self, prompt, max_tokens=0, temperature=0.0):
        if "\n2. " in prompt:
            raise RuntimeError("too much")
        return models.StubTextModel().generate(prompt)


class Short:
    def generate(self, prompt, max_tokens=0, temperature=0.0):
        return '{"polished": ["X", "Y"]}'


def test_polish(segments):
    df = segments((0, 1, "a"), (1, 2, "b"), (2, 3, "c"))
    texts = lambda out: [r["text"] for r in out.orderBy("seg_idx").collect()]
    assert texts(polish.polish_segments(df, models.StubTextModel, 2)) == ["A", "B", "C"]
    again = polish.polish_segments(df, Failing, 3)
    assert texts(again) == ["A", "B", "C"] and "too much" in again.first()["error"]
    assert texts(polish.polish_segments(df, Short, 3)) == ["X", "Y", "c"]
    assert texts(polish.polish_segments(df, Short, 3, compat=True)) == ["X", "Y"]


class Halves:
    def generate(self, prompt, max_tokens=0, temperature=0.0):
        return '{"segments": ["これは長い文章です。", "さらに続きます。"]}'


def test_model_split(segments, listed):
    words = [word(t, i, i + 1) for i, t in enumerate(["これは", "長い", "文章です。", "さらに", "続きます。"])]
    df = segments((0, 5, "これは長い文章です。さらに続きます。", words))
    assert listed(polish.split_with_model(df, Halves, 10)) == [(0, 3, "これは長い文章です。"), (3, 5, "さらに続きます。")]
    assert polish.split_row(Halves(), 0, 6, "これは長い文章です。さらに続きます。", [], 10, 20, {})[0][1] == pytest.approx(6 * 10 / 18)
    bare = segments((0, 6, "これは長い文章です。さらに続きます。"), (6, 7, "短い"))
    assert [r[2] for r in listed(polish.split_with_model(bare, Halves, 10))] == ["これは長い文章です。", "さらに続きます。", "短い"]

    def broken():
        raise RuntimeError("no model")

    assert listed(polish.split_with_model(bare, broken, 10)) == listed(bare)
    assert len(polish.split_row(Halves(), 0, 5, "全く違うテキストがここにある", [], 10, 20, {})) == 1
    assert not polish.valid_split("abc", [" "])


def test_recognition_params():
    assert models.recognition_params({"language": "ja", "other": 1}, "cuda", temperature=0) == {"language": "ja", "fp16": True, "temperature": 0}
    assert models.text_model({"provider": "none"}) is None


def test_neighbour_overlap(segments):
    rows = merge.neighbour_overlaps(segments((0, 1, "a"), (0.95, 2, "b"), (3, 4, "c"))).orderBy("seg_idx").collect()
    assert [(r["overlaps_prev"], r["overlaps_next"]) for r in rows] == [(False, True), (True, False), (False, False)]
    assert segments((0, 1, "a")).select(F.size("words")).first()[0] == 0


def test_recogniser_hears_what_a_full_scan_would():
    import random

    rng = random.Random(4)
    words = [(a := rng.randrange(300) / 10, a + rng.choice([0.0, 0.2, 1.0, 9.0]), f"w{i}") for i in range(200)]
    ear = models.TableRecogniser(pd.DataFrame(words, columns=["start", "end", "word"]))
    for _ in range(300):
        start = rng.randrange(-20, 320) / 10
        end = start + rng.randrange(0, 50) / 10
        want = [w for a, b, w in sorted(words) if a < end and b > start]
        assert [w["word"] for s in ear.transcribe("m", start, end)["segments"] for w in s["words"]] == want


def test_recogniser_reads_only_what_overlaps():
    class Counted(list):
        def __getitem__(self, at):
            part = super().__getitem__(at)
            seen.append(len(part))
            return part

        def __iter__(self):
            seen.append(len(self))
            return super().__iter__()

    seen = []
    ear = models.TableRecogniser(pd.DataFrame({"word": ["w"] * 5000, "start": range(5000), "end": range(1, 5001)}))
    ear.words = Counted(ear.words)
    assert len(ear.transcribe("m", 2500.0, 2510.0)["segments"][0]["words"]) == 10 and sum(seen) == 10


def test_null_texts_stay(segments):
    from cuewise.operators import filters

    df = segments((0, 1, "hello"), (1, 2, None), (2, 3, "thanks"))
    assert [r["text"] for r in filters.remove_phrases(df, ["^thanks$"]).orderBy("seg_idx").collect()] == ["hello", None]
    assert [r["text"] for r in filters.validate_timing(df).orderBy("seg_idx").collect()] == ["hello", None, "thanks"]


def test_clusters_in_slots_are_those_of_one_window(spark):
    import random

    from cuewise.schema import SEGMENT

    rng = random.Random(5)
    rows = [(m, i, t, t + 1, w, []) for m in ("a", "b") for i, (t, w) in enumerate((rng.choice([-5.0, rng.randrange(900) / 4, 60.0]), rng.choice(["x", "y", "zz"])) for _ in range(60))] + [("a", 99, None, 1.0, "x", [])]
    df = spark.createDataFrame(rows, SEGMENT)
    for window, cluster in ((60.0, 9), (10.0, 4), (0.0, 3), (7.5, 5)):
        times = {}
        for m, _, t, _, w, _ in rows:
            times.setdefault((m, w), []).append(t)
        want = {k for k, ts in times.items() if any(t is not None and sum(u is not None and t <= u <= t + window for u in ts) >= cluster for t in ts)}
        got = cleanup.recurring_words(df, None, cluster, window).collect()
        assert {(r["media_id"], r["token"]) for r in got} == want
