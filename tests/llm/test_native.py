"""URL filter, sharding, fingerprints and mixing against brute force."""

import hashlib
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cuewise.llm import common, fingerprint, mixing, sharding, url_filter


def test_url_parts(spark):
    urls = ["https://WWW.Example.org/en/1?x#y", "no scheme", None, "http://a.b", "x://h?q", "s://h/p#f", "a://b://c/d", "http://É.com/é\n/x"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))).collect()
    assert [tuple(r) for r in rows] == [("www.example.org", "/en/1"), ("", ""), ("", ""), ("a.b", ""), ("h", ""), ("h", "/p"), ("b:", "//c/d"), ("É.com", "/é\n/x")]


def test_filter_urls(spark):
    rows = [(1, "http://x.example.org/en/12"), (2, "http://example.org/es/"), (3, "http://notexample.org/es/"), (4, "https://m.net/a/"), (5, "http://www.m.net/a.html?q"), (6, None), (7, "http://a.com/de/x"), (8, "http://b.org"), (4, "https://m.net/a/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("clash"))
    listed = spark.createDataFrame([("http://m.net/a",), ("http://a.com/de/x",)], "url string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed).collect())
    assert got == [(1, "example.org/en/1", "block"), (2, "example.org/es/", "block"), (3, "org/", "allow"), (4, None, "block"), (4, None, "block"), (5, None, "block"), (6, None, "allow"), (7, "com/de/", "block"), (8, None, "allow")]
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0)).where("listed").count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(2000).selectExpr("concat('k', id) as key")
    bloom = url_filter.bloom_filter(keys, "key", 64)
    assert bloom.count() <= 64
    probes = spark.range(4000).selectExpr("concat('k', id) as key", "id < 2000 as real")
    found = url_filter.maybe_in(probes, "key", bloom, blocks=64)
    assert found.where("real and not maybe").count() == 0
    roomy = url_filter.maybe_in(probes, "key", url_filter.bloom_filter(keys, "key"))
    assert roomy.where("not real and maybe").count() < 100


def greedy(sizes, capacity):
    shards, held = 1, 0
    for s in sizes:
        if s > capacity:
            return None
        if held + s > capacity:
            shards, held = shards + 1, 0
        held += s
    return shards


def best_capacity(sizes, shards):
    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        n = greedy(sizes, mid)
        low, high = (low, mid) if n and n <= shards else (mid + 1, high)
    return low


def check_shards(rows, docs, shards):
    order, members = [], defaultdict(list)
    for doc_id, text in sorted(docs, key=lambda d: -(2**63) if d[0] is None else d[0]):
        if text not in members:
            order.append(text)
        members[text].append(doc_id)
    sizes = [len(members[t]) * (len(t.encode()) + 8) for t in order]
    by_text = defaultdict(set)
    loads, slots = Counter(), defaultdict(list)
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) <= best_capacity(sizes, shards)
    assert sorted(r["text_crc32"] for r in rows) == sorted(zlib.crc32(t.encode()) for _, t in docs)
    return loads, best_capacity(sizes, shards)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding_is_minimax(spark, small, shards):
    docs = [(r["doc_id"], r["text"] or "") for r in small.select("doc_id", "text").collect()]
    loads, best = check_shards(sharding.shard_documents(small, shards).collect(), docs, shards)
    assert max(loads.values()) == best and set(loads) <= set(range(shards))


def test_minimax_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST", 8)
    monkeypatch.setattr(sharding, "EACH", 4)
    rng = random.Random(4)
    for n, shards in ((1, 3), (40, 5), (300, 24)):
        sizes = [rng.choice([1, 2, 9, 50, 400]) for _ in range(n)]
        upto = [sum(sizes[: i + 1]) for i in range(n)]
        running = spark.createDataFrame([(u,) for u in upto], "upto long")
        cuts = sharding.minimax_cuts(running, upto[-1], shards)
        loads = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
        assert set(cuts) <= set(upto) and cuts[-1] == upto[-1] and len(cuts) <= shards
        assert max(loads) == best_capacity(sizes, shards)


def test_sharding_edges(edge_docs, no_docs):
    rows = sharding.shard_documents(edge_docs).collect()
    docs = [(r["doc_id"], r["text"] or "") for r in edge_docs.select("doc_id", "text").collect()]
    check_shards(rows, docs, 24)
    assert sharding.shard_documents(no_docs).count() == 0


def canonical(text):
    import re

    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).lower()).strip()


def test_fingerprints(spark, edge_docs, no_docs):
    extra = [(20, "Ｆull  WIDTH\ttext", "en", "a"), (21, "full width text", "en", "a"), (22, "e\u0301te", "fr", "a"), (23, "éte", "fr", "a"), (24, "ab", "en", "a")]
    docs = edge_docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(extra, edge_docs.select("doc_id", "text", "lang", "source").schema))
    rows = fingerprint.fingerprint_documents(docs.withColumn("wide", F.lit("clash"))).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert len(rows) == len(texts)
    ring = sorted(texts, key=lambda d: -(2**63) if d[0] is None else d[0], reverse=True)
    want = Counter()
    for (i, text), (_, following) in zip(ring, ring[1:] + ring[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        want[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(text) == canonical(edited)), float(canonical(text) == canonical(following))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in rows) == want
    by_id = {r["doc_id"]: r["fingerprint"] for r in rows}
    classes = defaultdict(set)
    for i, text in texts:
        classes[canonical(text)].add(by_id[i])
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)
    assert by_id[20] == by_id[21] and by_id[22] == by_id[23] and by_id[3] == by_id[4] == by_id[5]
    assert fingerprint.fingerprint_documents(no_docs).count() == 0


def test_ring_over_many_bins(small):
    few = {r["doc_id"]: r["next"] for r in fingerprint.with_next(small, 10_000).collect()}
    many = {r["doc_id"]: r["next"] for r in fingerprint.with_next(small, 7).collect()}
    assert few == many and len(few) == small.count()


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda c: F.lit("00"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    marks = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint_documents(docs).collect()}
    assert marks[1] == marks[3] != marks[2]


def naive_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, left, target = share * sum(sizes.values()), set(names), {}
    while left:
        total = sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: rest * weight[s] / total for s in left}
        for s in over:
            target[s] = most * sizes[s]
        rest -= sum(target[s] for s in over)
        left -= over
    return target


@pytest.mark.parametrize("share", [0.5, 1.5, 2.0])
def test_mixing(small, edge_docs, share):
    for docs in (small, edge_docs):
        rows = mixing.mix_sources(docs, share=share).collect()
        sizes = defaultdict(int)
        for r in docs.select("source", "text").collect():
            sizes[r["source"]] += len((r["text"] or "").encode().split())
        want = naive_targets(sizes, mixing.WEIGHTS, share, mixing.MOST)
        taken = Counter()
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-3)
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= 1 for s in want)
        again = mixing.mix_sources(docs.repartition(3), share=share).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mixing_prefers_quality(spark):
    docs = spark.createDataFrame([(i, "word " * 20 if i % 2 else "1 2 3 4 " * 5, "s") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs, share=0.5).collect()
    good, bad = (sum(r["taken"] for r in rows if r["doc_id"] % 2 == k) for k in (1, 0))
    assert good > 3 * bad


def test_mixed_documents(edge_docs, no_docs):
    copies = {(r["doc_id"], r["source"]): 0 for r in edge_docs.collect()}
    for r in mixing.mix_sources(edge_docs).collect():
        copies[r["doc_id"], r["source"]] += r["copies"]
    out = mixing.mixed_documents(edge_docs)
    assert out.columns == edge_docs.columns
    got = Counter((r["doc_id"], r["source"]) for r in out.collect())
    assert got == {k: v for k, v in copies.items() if v}
    assert mixing.mixed_documents(no_docs).count() == 0 == mixing.mix_sources(no_docs).count()


def odd_ids(spark, ids, texts):
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("ids", [[None] * 300, [7] * 300, [1, 2] + [9] * 296 + [11, 12], list(range(300))])
def test_bins_stay_small_whatever_the_ids(spark, ids):
    rows = odd_ids(spark, ids, [f"text {i}" for i in range(300)]).select(common.order_key("doc_id").alias("at"), F.xxhash64("text").alias("tie"))
    got = common.range_bins(rows, "at", 20, common.even(F.col("tie")))
    counts = [r["count"] for r in got.groupBy("bin").count().collect()]
    assert sum(counts) == 300 and max(counts) < 60
    spans = got.groupBy("bin").agg(F.min(F.struct("at", "tie")).alias("a"), F.max(F.struct("at", "tie")).alias("b")).orderBy("bin").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:], strict=False))
    assert common.range_bins(rows.limit(0), "at", 20, common.even(F.col("tie"))).count() == 0


@pytest.mark.parametrize("ids", [[None] * 90, [7] * 90, [1, 1, None] * 30])
def test_sharding_and_ring_of_shared_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(sharding, "ROWS_PER_BIN", 10)
    texts = [f"text number {i % 70} " * (i % 7 + 1) for i in range(90)]
    docs = odd_ids(spark, ids, texts)
    got = sharding.shard_documents(docs, 5).collect()
    assert len(got) == 90 and len({r["shard"] for r in got}) == 5
    for shard in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    of = {}
    for r in got:
        of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    ring = fingerprint.with_next(docs, 10).collect()
    assert len(ring) == 90 and sorted(r["next"] for r in ring) == sorted(texts) == sorted(r["text"] for r in ring)


def test_first_rows_are_those_of_an_ordered_limit(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("c"), F.concat(F.lit("w"), (F.col("id") * 7919 % 1000).cast("string")).alias("word")).repartition(9)
    for n in (0, 1, 100, 999, 5000):
        assert [(r["c"], r["word"]) for r in common.first_rows(df, n, F.col("c").desc(), "word")] == [tuple(r) for r in df.orderBy(F.col("c").desc(), "word").limit(n).collect()]


def test_groups_join_hot_and_cold(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 0.2)
    rows = spark.createDataFrame([(f"k{i % 7 if i % 2 else 0}", i) for i in range(200)], "k string, v int")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    got = common.join_groups(rows, groups, "k", "n", 200)
    assert sorted(map(tuple, got.select("k", "v", "n", "low").collect())) == sorted(map(tuple, rows.join(groups, "k").select("k", "v", "n", "low").collect()))
