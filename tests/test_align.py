"""Similarity, the search over runs, the range join with words and realignment, each against brute force."""

import random
from dataclasses import replace
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cuewise.functions import similarity as S
from cuewise.functions.text import expansion_values
from cuewise.operators import align, filters, hearing, models

WORDS = "media_id string, word string, start double, end double"


def difflib_similarity(a, b):
    a, b = S.cleaned(a), S.cleaned(b)
    return SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0


def random_text(rng, letters, most):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(most)))


def test_similarity_is_difflib_s():
    rng = random.Random(1)
    for i in range(100_000):
        letters = ("ab", "abc 。", "こんにちは、世界", "abcdefghij", "a😀b")[i % 5]
        a, b = random_text(rng, letters, 12), random_text(rng, letters, 12)
        assert S.text_similarity(a, b) == difflib_similarity(a, b), (a, b)
        assert S.similarity_limit(a, b) >= S.text_similarity(a, b)


@pytest.mark.parametrize("size", [60, 400])
def test_both_ways_to_the_longest_block(monkeypatch, size):
    rng = random.Random(size)
    for letters in ("ab", "abcd", "abcdefghijklmnop"):
        for _ in range(40 if size < 100 else 4):
            a, b = random_text(rng, letters, size), random_text(rng, letters, size)
            assert S.SuffixAutomaton(b).longest_block(a)[2] == S._by_search(a, b)[2]
            if S._by_search(a, b)[2]:
                assert S.SuffixAutomaton(b).longest_block(a) == S._by_search(a, b)
            own = difflib_similarity(a, b)
            assert S.text_similarity(a, b) == own
            monkeypatch.setattr(S, "AUTOMATON", -1)
            assert S.text_similarity(a, b) == own
            monkeypatch.undo()


def test_long_texts_take_the_automaton():
    rng = random.Random(3)
    a = random_text(rng, "abcdefgh", 9000) + "middle" * 40
    b = a[4000:] + random_text(rng, "abcdefgh", 9000) + a[:4000]
    assert len(a) * len(b) > S.AUTOMATON or len(a) < 3000
    assert 0.5 < S.text_similarity(a, b) <= S.similarity_limit(a, b) <= 1.0


def test_bounds_in_sql(spark):
    rng = random.Random(6)
    pairs = [(random_text(rng, "ab😀c。 ", 15), random_text(rng, "ab😀c。 ", 15)) for _ in range(200)] + [(None, "a"), ("a", None), ("", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.multiset_bound(F.col("a"), F.col("b")).alias("m"), S.similarity_bound(F.col("a"), F.col("b")).alias("l"), S.similarity_above(F.col("a"), F.col("b"), 0.6).alias("above")).collect()
    for r in rows:
        own = S.text_similarity(r["a"], r["b"])
        assert (r["m"] or 0) == pytest.approx(S.similarity_limit(r["a"], r["b"])) and own <= (r["m"] or 0) + 1e-12 <= (r["l"] or 0) + 1e-9
        assert r["above"] == (own if (r["m"] or 0) >= 0.6 else None)


def exhaustive_run(target, texts, longest, limit, seen):
    """The run that a search with no bounds picks: positions and score. ``seen`` counts the scores."""
    best = (None, None, 0.0)
    for first in range(len(texts)):
        joined = ""
        for last in range(first, min(first + longest, len(texts))):
            joined += texts[last].strip()
            score = difflib_similarity(target, joined)
            seen[0] += 1
            if score > best[2]:
                best = first, last, score
            if score >= 0.9:
                return best
            if len(joined) > limit * 1.5:
                break
        if best[2] >= 0.85:
            break
    return best


def spoken_words(rng, n):
    return ["".join(rng.choice("aeiou" if j % 2 else "bcdfghklmnprstvw") for j in range(rng.choice([2, 3, 4, 6, 8]))) + " " for _ in range(n)]


def test_run_search_is_exhaustive_and_spares_scores(monkeypatch):
    counted, own = [0], S.text_similarity
    monkeypatch.setattr(align, "text_similarity", lambda a, b: counted.__setitem__(0, counted[0] + 1) or own(a, b))
    rng = random.Random(8)
    all_runs, made = [0], 0
    for turn in range(60):
        words = spoken_words(rng, rng.choice([3, 20, 90]))
        at = rng.randrange(len(words))
        target = "".join(words[at : at + rng.choice([1, 4, 8])])
        for _ in range(rng.choice([0, 2, len(target) // 3])):  # misheard letters
            k = rng.randrange(len(target))
            target = target[:k] + rng.choice("aeioubcd") + target[k + 1 :]
        limit = len(S.cleaned(target))
        want = exhaustive_run(target, words, 15, limit, all_runs)
        spans = [(float(i), float(i)) for i in range(len(words))]
        got = align._best_run(target, words, spans, 15, limit)
        assert (got.start, got.end, got.score) == want, (turn, target)
        counted[0] = 0
        found = align.find_in_words(target, [{"word": w, "start": float(i), "end": float(i)} for i, w in enumerate(words)], floor=align.FAIR)
        assert (found.start, found.end) == (want[:2] if want[2] >= align.FAIR else (None, None))
        made += counted[0]
    assert made * 10 <= all_runs[0]


def test_run_bounds_hold():
    rng = random.Random(9)
    for _ in range(200):
        letters = rng.choice(["ab", "abc、", "abcdef"])
        target, words = random_text(rng, letters, 12), [random_text(rng, letters, 5) for _ in range(rng.randrange(1, 9))]
        index, common = align.RunIndex(target, words, min(4, len(words))), align.Subsequence(S.cleaned(target))
        for first in range(len(words)):
            common.start()
            for last in range(first, min(first + 4, len(words))):
                common.add(S.cleaned(words[last]))
                assert common.bound() >= S.text_similarity(target, "".join(words[first : last + 1]))
                assert index.bound(first, last) >= S.text_similarity(target, "".join(words[first : last + 1]))


def test_heard_words_are_those_of_a_full_scan(spark):
    rng = random.Random(2)
    words = [(m, f"w{i}", a := rng.randrange(-40, 400) / 4, a + rng.choice([0.0, 0.3, 2.0, 40.0])) for m in "xy" for i in range(120)] + [("x", "w", None, 1.0)]
    rows = [(m, i, (a := rng.randrange(-40, 400) / 4), a + rng.choice([-1.0, 0.0, 0.5, 3.0, 70.0])) for m in "xyz" for i in range(40)]
    df = spark.createDataFrame(rows, "media_id string, seg_idx int, start double, end double").withColumn("text", F.lit("t"))
    got = hearing.with_heard(df, spark.createDataFrame(words, WORDS), F.col("start"), F.col("end"), bucket=5.0).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"media_id", "seg_idx", "start", "end", "text", "heard"}
    for r in got:
        want = sorted((a, b, w) for m, w, a, b in words if m == r["media_id"] and a is not None and a < r["end"] and b > r["start"] and r["start"] < r["end"])
        assert [tuple(h) for h in r["heard"]] == want


def one_after_the_other(rows, media, words, config):
    """Realignment of a media item by lists, with one recogniser that knows all of its words."""
    ear, gap = models.TableRecogniser(words), config.get("min_gap", 0.1)
    out = []
    for i, r in enumerate(rows):
        if config["method"] != "text_search":
            out.append(align.verify_by_time(r, media, ear, config.get("time_based", {})))
            continue
        now = align.search_by_text(r, media, ear, config.get("text_search", {}))
        if now.moved:
            start = max(now.start, out[-1].end + gap) if i else now.start
            end = min(now.end, rows[i + 1].start - gap) if i + 1 < len(rows) else now.end
            now = replace(now, start=start, end=end) if end > start else r
        out.append(now)
    pairs = []
    for i, r in enumerate(out):
        pairs += [(i - 1, i)] if r.moved and i and r.start < out[i - 1].end + gap else []
        pairs += [(i, i + 1)] if r.moved and i + 1 < len(out) and r.end > out[i + 1].start - gap else []
    for a, b in pairs:
        border = align.find_boundary(out[a], out[b], media, ear)
        if border is None:
            middle = (out[a].end + out[b].start) / 2
            out[a], out[b] = replace(out[a], end=middle), replace(out[b], start=middle + gap)
        else:
            out[a] = replace(out[a], end=border)
            if border + gap < out[b].end:
                out[b] = replace(out[b], start=border + gap)
    return out, len(pairs)


@pytest.mark.parametrize("method", ["time_based", "text_search"])
def test_realignment_is_the_sequential_one(spark, method):
    rng = random.Random(11)
    words, rows = [], []
    for m in range(12):
        at, spoken = 0.0, []
        for w in spoken_words(rng, 130):
            long = 0.05 * len(w) + 0.05
            spoken.append((at, at + long, w))
            at += long + rng.choice([0.0, 0.0, 0.1, 0.8])
        words += [(f"m{m}", w, a, b) for a, b, w in spoken]
        k = n = 0
        while k < len(spoken):
            size = rng.choice([1, 3, 5, 7])
            part = spoken[k : k + size]
            shift = rng.choice([0.0, 0.0, -1.2, 0.7, 1.5, -2.2])
            rows.append((f"m{m}", n, max(0.0, part[0][0] + shift), part[-1][1] + shift, "".join(p[2] for p in part) if rng.random() < 0.9 else "xyz xyz", None))
            k, n = k + size, n + 1
    from cuewise.schema import SEGMENT

    config = {"method": method, "time_based": {"similarity": 0.75}, "text_search": {"expansion": 3.0, "expansion_attempts": 3}}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # so that media items cross batches
    try:
        got = align.realign_timing(spark.createDataFrame(rows, SEGMENT).repartition(5), config, models.TableRecogniser, spark.createDataFrame(words, WORDS)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {(r["media_id"], r["seg_idx"]): (r["start"], r["end"], r["text"]) for r in got}
    want, pairs = {}, 0
    for m in {r[0] for r in rows}:
        own = [align.Segment(r[2], r[3], r[4]) for r in rows if r[0] == m]
        out, n = one_after_the_other(own, m, [(a, b, w) for x, w, a, b in words if x == m], config)
        want |= {(m, i): (s.start, s.end, s.text) for i, s in enumerate(out)}
        pairs += n
    assert len(got) == len(rows) and found == want and (pairs > 10 or method == "text_search")


def test_a_recogniser_without_a_table_is_made_once_a_task(spark, segments):
    class Ear:
        def transcribe(self, media, start, end, words, params):
            raise RuntimeError("deaf")

    df = segments((0, 1, "one two"), (1, 2, "three four")).coalesce(1)
    rows = align.realign_timing(df, {}, lambda words: Ear() if words is None else None).orderBy("seg_idx").collect()
    assert [(r["start"], r["end"], r["text"]) for r in rows] == [(0, 1, "one two"), (1, 2, "three four")]
    assert align.realign_timing(df.limit(0), {}, lambda words: Ear()).count() == 0


def test_plan_gathers_no_media_item(spark, segments):
    truth = spark.createDataFrame([("m", "one", 0.0, 1.0)], WORDS)
    df = segments((0, 1, "one"), (2, 2.1, "two three four five"))
    for out in (align.realign_timing(df, {}, models.TableRecogniser, truth), filters.validate_timing(df, 14.0, models.TableRecogniser, truth)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FlatMap" not in plan and "CoGroup" not in plan and "Union" not in plan and "CartesianProduct" not in plan


def test_second_look_at_flagged_segments(spark, segments, listed):
    """Too fast, very short for its text, or a longer text without words; null texts and others stay."""
    truth = spark.createDataFrame([("m", "spoken ", 0.0, 0.6), ("m", "twice", 0.6, 1.0)], WORDS)
    word = ("w", 0.0, 1.0)
    df = segments((0, 1, "a text that is far too long for one second"), (1, 1.2, "shorts", [word]), (5, 9, "eleven chars", [word]), (10, 12, "without words"), (20, 21, None), (30, 31, "ok"))
    got = filters.revalidate_segments(df, models.TableRecogniser, truth, 20.0)
    assert listed(got) == [(0, 1, "spoken twice"), (5, 9, "eleven chars"), (20, 21, None), (30, 31, "ok")]
    flags = df.select("seg_idx", F.coalesce(filters.needs_second_look(20.0), F.lit(False)).alias("f")).orderBy("seg_idx").collect()
    assert [r["f"] for r in flags] == [True, True, False, True, False, False]


def test_expansions_end_at_the_target():
    assert expansion_values(3.0, 5)[-1] == 3.0
