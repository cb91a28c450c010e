"""The pipeline's near-dedup against brute-force Jaccard over all pairs."""

import itertools
import random

import pytest

import corpus_pipeline
from cuewise.llm import near_copies


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute_force(rows):
    """The row (doc_id, text) with the smallest doc_id, nulls last, of each component."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(root(i), []).append(row)
    return {min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()}


def changed_copies(n=12):
    """Texts with near copies on both sides of 0.8, a line that most share, and a large group of variants of one text."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(words, k=12))
    out = []
    for _ in range(n):
        text = rng.choices(words, k=rng.randrange(8, 150))
        for changes in range(6):
            own = list(text)
            for at in rng.sample(range(len(own)), min(len(own), changes)):
                own[at] = rng.choice(words)
            out.append(" ".join(own) + (f" {line}" if rng.random() < 0.7 else ""))
    base = rng.choices(words, k=120)
    for i in range(40):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        out.append(" ".join(own))
    return out + ["a b c d", "A  b c d", "a b c", "", None]


@pytest.mark.parametrize("hot", [10**9, 5])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(near_copies, "HOT", hot)
    rows = list(enumerate(changed_copies()))
    got = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == kept_by_brute_force(rows)


def variants_of_one_text(n):
    """Near copies of one text of 400 words, few enough changes to be linked in every tenth; the others are below 0.8 of all."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    out = []
    for i in range(n):
        own = list(base)
        for at in range(i % 7, 400, 400 // (3 if i % 10 == 0 else rng.randrange(10, 16))):
            own[at] = f"x{i}_{at}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("sparse", [near_copies.SPARSE, 1 << 40])
def test_candidates_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch, sparse):
    monkeypatch.setattr(near_copies, "SPARSE", sparse)
    candidates, verified = [], near_copies._verified

    def counted(pairs, *more):
        candidates.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(near_copies, "_verified", counted)
    rows = list(enumerate(variants_of_one_text(150)))
    kept = near_copies.one_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == kept_by_brute_force(rows) and 100 < len(kept) < 150
    assert candidates[-1] <= len(rows)


def test_small_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    assert {(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near_copies(spark, small, "").collect()} == kept_by_brute_force(rows)


def test_repeated_and_null_ids(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "twelve thirteen fourteen fifteen sixteen")
    rows = [(1, a), (1, b), (2, b), (1, b), (None, c), (None, c.upper()), (None, a), (3, c)]
    got = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got)) == [(1, a), (1, b), (3, c)]


def test_edges(edge_docs, no_docs):
    rows = near_copies.one_of_near_copies(edge_docs)
    assert rows.columns == edge_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows.collect()) == sorted((i is None, i or 0) for i in (1, 3, 7, 8, -9, None))
    assert near_copies.one_of_near_copies(no_docs).count() == 0


def test_joins_take_over_where_a_bitmap_is_too_small(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "HOT", 5)
    monkeypatch.setattr(near_copies, "SPOTS", 64)
    rows = list(enumerate(changed_copies(8)))
    kept = near_copies.one_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == kept_by_brute_force(rows)


def test_different_texts_that_share_a_hash_are_told_apart(spark):
    marks = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 7), (3, 8)], "id long, id2 long")
    assert near_copies.clashes(marks) == {2}
    words = near_copies.words_of(b"A b\tc")
    own = near_copies.word_hash(words)
    assert own == near_copies.word_hash([b"a", b"b", b"c"]) != near_copies.word_hash(words, frozenset({own})) == near_copies.word_hash(words, near_copies.EVERY)
