"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from cuewise.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def expected(docs):
    n = counted(docs)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as word", "cast(null as string) as form", "2 as at")
    got = spelling.spelling_variants(df.repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and dict(got.dtypes)["n_near"] == "bigint"
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected(docs)
    return rows


def test_dense_words(spark):
    """Two and three letters, so that nearly all words have many neighbours of every kind, with runs of equal letters."""
    rng = random.Random(4)
    docs = []
    for i in range(60):
        words = ["".join(rng.choice("ab" if rng.random() < 0.7 else "abé") for _ in range(rng.choice([5, 5, 6, 6, 7, 8]))) for _ in range(120)]
        docs.append((i, " ".join(words)))
    rows = check(spark, docs)
    assert sum(r[4] for r in rows) > 5 * len(rows) and any(r[1] and r[2] != r[1] for r in rows)


def test_odd_rows(spark):
    long = "abcde" * 4000
    docs = [(1, None), (2, ""), (None, "Größer GRÖSSER größer Größer"), (3, "planes Planes PLANES planet planet planet planets " * 3), (3, "planes Planes PLANES planet planet planet planets " * 3)]
    docs += [(4, "ÀÉÎõü àéîõü ÀÉÎõü"), (5, f"{long} {long} {long} {long}x {long}x {long}x {long[1:]} {long[1:]} {long[1:]}"), (6, "naïve-naïve naive_naive x×y÷z ×××÷÷÷ " * 4), (7, "!!! 12345 �")]
    check(spark, docs)


def test_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "word list")], "doc_id long, text string")).count() == 0


def test_whole_small_table(spark, small):
    check(spark, [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()])


def test_light_edges_are_few(spark):
    words = ["".join(p) for p in {"".join(random.Random(i).choices("abcdefgh", k=7)) for i in range(1000)}]
    df = spark.createDataFrame([(i, w, 1) for i, w in enumerate(words)], "id long, word string, n long")
    most = spelling.light_edges(df).groupBy("id").count().agg({"count": "max"}).first()[0]
    assert most <= 11  # log2 of 1000, and the end


@pytest.mark.parametrize("doc_id", ["", "17"])
def test_noise_follows_the_checksum(doc_id):
    text = " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i % 6]}éq" for i in range(400))
    want = Counter()
    for w in text.split():
        h = zlib.crc32(f"{doc_id}:{w}".encode())
        want[w[: h % 5] + w[h % 5 + 1 :] if h % 97 == 0 else w] += 1
    got = Counter()
    for w, n in spelling.noisy_words(doc_id, text):
        got[w] += n
    assert got == want and any(len(w) == 4 for w in got)
