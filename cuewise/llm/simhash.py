"""SimHash near-duplicates: fingerprints within 3 bits, found exactly with vantage-point trees.

Radius 3 is large against how little the distances of unrelated 64-bit fingerprints vary (32, give or take 4): a tree
over them keeps 76 % of the rows on the inner side of a cut. So there are two trees, one a half of the bits. Two
fingerprints within 3 bits differ in at most one bit of one of their halves, so in that half's Hamming distance
radius 1 does, and a cut at the median keeps 6 % more than half on average.

* The upper levels of a tree are grown from a bounded sample of the fingerprints (SAMPLE rows, 1/SHARE of them at
  most) and broadcast. Every row goes down them: a row on the outer side of a cut, but within the radius of its
  boundary, goes to both sides, all others are pruned to one by the triangle bound. The leaves are shards.
* A shard above HOT rows is cut further, likewise, from a sample of its own. Where a half can't tell rows apart, a
  tree goes on with the distance of the whole fingerprints and radius 3. A shard that no cut divides is compared in
  chunks, each pair of chunks being a shard.
* In a shard the tree is grown on, from the shard's own rows, down to LEAF rows, which are compared with each other.

Documents reduce to distinct fingerprints before any of this, and a shard returns a spanning forest of
its links instead of all pairs, so copies and near-copy groups cost no more than their members. Components
are found by alternating star contractions over distinct fingerprints.

Defined cases: text without words (null, empty, blank) has fingerprint zero and is linked like any other;
one or two words are one shingle; very long texts are hashed in pieces, whole; ties between vantage points and equal
distances fall to the inner side; a null doc_id is allowed and ranks lowest in no component: it never
names a component that has another id; repeated rows each stay; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewise.llm.common import durable, join_groups

SHINGLE = 3
SEED = 42
RADIUS = 3
WHOLE = np.uint64(2**64 - 1)
HALVES = (np.uint64(2**32 - 1), np.uint64(2**64 - 2**32))
HALF_RADIUS = RADIUS // len(HALVES)
SAMPLE, SHARE = 1 << 18, 16
HOT = 1 << 21
LEAF = 64
DIVIDED = 0.95  # a cut counts if each side holds at most this share of the rows


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        marks = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks)], ["doc_id", "fp"])


class VantageTree:
    """A vantage-point tree over uint64 fingerprints, grown from ``marks``, in which others can be looked up.

    A node is (mask, radius, vantage point, mu, inner, outer): distances are those of the bits in mask. It is an
    int, the number of a leaf, where LEAF rows or fewer are left or no metric divides them.
    """

    def __init__(self, marks: np.ndarray, half: int) -> None:
        self.size = 0
        self.root = self._grow(marks, ((HALVES[half], HALF_RADIUS), (WHOLE, RADIUS)))

    def _grow(self, marks: np.ndarray, metrics: tuple) -> tuple | int:
        while metrics and len(marks) > LEAF:
            mask, radius = metrics[0]
            vantage = marks[len(marks) // 2]
            far = np.bitwise_count((marks ^ vantage) & mask)
            mu = min(int(np.median(far)), int(far.max()) - 1)
            inner = far <= mu + radius
            outer = far > mu
            if mu >= 0 and max(inner.sum(), outer.sum()) <= DIVIDED * len(marks):
                return mask, radius, vantage, mu, self._grow(marks[far <= mu], metrics), self._grow(marks[outer], metrics)
            metrics = metrics[1:]
        self.size += 1
        return self.size - 1

    def lookup(self, marks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``marks``): two rows within the radius meet in one leaf at least."""
        waiting = [(self.root, np.arange(len(marks)))]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows
                continue
            mask, radius, vantage, mu, inner, outer = node
            far = np.bitwise_count((marks[rows] ^ vantage) & mask)
            waiting.append((inner, rows[far <= mu + radius]))
            waiting.append((outer, rows[far > mu]))


def forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """Those of the links (a, b) that join two trees of ``parent``, which they then join."""

    def root(i: int) -> int:
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = i = parent[up] if up in parent else up
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(i), root(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def tree_links(marks: np.ndarray, half: int) -> list[tuple[int, int]]:
    """A forest of links (int64) that spans the same components as the pairs of ``marks`` (uint64) that meet in ``half``'s tree."""
    parent: dict[int, int] = {}
    out = []
    signed = marks.view(np.int64)
    for _, rows in VantageTree(marks, half).lookup(marks):
        step = max(1, (1 << 21) // len(rows))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            a, b = np.nonzero(np.bitwise_count(marks[part][:, None] ^ marks[rows][None, :]) <= RADIUS)
            once = part[a] < rows[b]
            out += forest(signed[part[a[once]]], signed[rows[b[once]]], parent)
    return out


def _shard_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partitions in order of shard, to links that span each shard's components."""

    def links(keys: np.ndarray, halves: np.ndarray, marks: np.ndarray) -> pd.DataFrame:
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        out = [link for a, b in zip(edges, edges[1:], strict=False) for link in tree_links(np.unique(marks[a:b].view(np.uint64)), int(halves[a]))]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([x, batch[c].to_numpy(np.int64)]) for x, c in zip(held, ("key", "half", "fp"), strict=True)]
        cuts = np.flatnonzero(held[0][1:] != held[0][:-1])
        if len(cuts) and len(held[0]) >= 1 << 16:
            whole = cuts[-1] + 1
            yield links(*[x[:whole] for x in held])
            held = [x[whole:] for x in held]
    if len(held[0]):
        yield links(*held)


ROWS = "half int, key long, fp long"


def _look_up(shared) -> callable:
    """(half, key, fp) to the same in the leaves of each key's tree, which are numbered from the tree's first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, key, marks = (batch.column(c).to_numpy() for c in ("half", "key", "fp"))
            for own in np.unique(key).tolist():
                here = np.flatnonzero(key == own)
                tree, first = shared.value[own]
                found = list(tree.lookup(marks[here].view(np.uint64)))
                rows = here[np.concatenate([r for _, r in found])]
                leaves = np.repeat([first + leaf for leaf, _ in found], [len(r) for _, r in found])
                yield pa.RecordBatch.from_arrays([pa.array(half[rows], pa.int32()), pa.array(leaves, pa.int64()), pa.array(marks[rows], pa.int64())], ["half", "key", "fp"])

    return run


def in_chunks(rows: DataFrame, counts: DataFrame, hot: int) -> DataFrame:
    """Shards that no cut divides: each row in as many pairs of chunks as there are chunks of ``hot`` rows."""
    own = rows.join(F.broadcast(counts), "key").withColumn("k", F.ceil(F.col("n") / hot).cast("int"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    other = own.withColumn("c", chunk).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    # A negative key is no leaf's; two of them that are equal by chance only share a task.
    return other.select("half", (-F.abs(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")) / 2).cast("long") - 1).alias("key"), "fp")


def deal(marks: DataFrame, hot: int | None = None) -> DataFrame:
    """(half, key, fp): each fingerprint in the shards, numbered by key, that the trees of both halves send it to."""
    hot = hot or HOT
    spark = marks.sparkSession
    rows = marks.select(F.explode(F.array(*[F.lit(h) for h in range(len(HALVES))])).alias("half"), "fp").select("half", F.col("half").cast("long").alias("key"), "fp")
    # What reaches the driver and the executors: SAMPLE fingerprints and fewer leaves than that.
    waiting = {h: h for h in range(len(HALVES))}
    total, first, turn, calm = marks.count() * len(HALVES), len(HALVES), 0, []
    while waiting:
        share = max(SHARE, -(-total // SAMPLE))
        sample = rows.where(F.pmod(F.xxhash64("fp", F.lit(turn)), F.lit(share)) == 0).select("key", "fp").toArrow()
        keys, marks_taken = sample.column("key").to_numpy(), sample.column("fp").to_numpy()
        trees = {}
        for key, half in waiting.items():
            own = np.sort(marks_taken[keys == key])
            tree = VantageTree(np.random.default_rng(turn).permutation(own).view(np.uint64), half)
            trees[key] = tree, first
            first += tree.size
        rows = durable(rows.mapInArrow(_look_up(spark.sparkContext.broadcast(trees)), ROWS))
        counts = rows.groupBy("key", "half").agg(F.count("*").alias("n")).where(F.col("n") > hot).toPandas()
        single = {n for tree, n in trees.values() if tree.size == 1}
        waiting = {int(k): int(h) for k, h in zip(counts["key"], counts["half"], strict=True) if k not in single}
        stuck = [(int(k), int(n)) for k, n in zip(counts["key"], counts["n"], strict=True) if k in single]
        of = lambda found: F.broadcast(spark.createDataFrame(found, "key long, n long"))
        if stuck:
            calm.append(in_chunks(rows, of(stuck), hot))
        calm.append(rows.join(of([(int(k), 0) for k in counts["key"]]), "key", "left_anti").select("half", "key", "fp"))
        rows = rows.join(of([(k, 0) for k in waiting]), "key", "left_semi").select("half", "key", "fp")
        total, turn = int(counts["n"].sum()), turn + 1
    return reduce(DataFrame.unionByName, calm)


def fingerprint_links(marks: DataFrame) -> DataFrame:
    """(a, b), long: links that span the components of the distinct fingerprints ``fp``."""
    shards = deal(marks.select("fp")).repartition("key").sortWithinPartitions("key")
    return shards.select("half", "key", "fp").mapInPandas(_shard_links, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Alternates large and small stars until nothing changes, each on a durable table. A hub's neighbours are
    never gathered: its minimum comes from an aggregation and goes back by a join.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("d"))
        # A hub is a large star's: its rows stay where they are, and its minimum is broadcast.
        out = join_groups(both, least, "u", "d", 2 * n) if large else both.join(least, "u")
        if large:
            new = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            new = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return new.where("a != b").distinct()

    edges = durable(links.where("a != b").distinct())
    n, seen = edges.count(), None
    while True:
        # Each star is written by itself: as one plan the second would repeat the first three times, broadcasts included.
        edges = durable(star(edges, True), replaced=edges)
        edges = durable(star(edges, False), replaced=edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        n, seen = now[0], now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns: of each component the document with its smallest doc_id stays.

    Rows that share a doc_id are one document, of which one row stays. Rows without a doc_id have nothing
    to be kept by but their text: one of each text stays.
    """
    found = near_duplicates(docs)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()

    def one_row(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.xxhash64("text"))
        return rows.withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row")

    named = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi")
    return one_row(named, "doc_id").unionByName(one_row(docs.where("doc_id is null"), "text")).select(*docs.columns)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach)."""
    marked = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long"))
    marks = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(fingerprint_links(marks.select("fp")))
    joined = marks.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = durable(joined.select("fp", "first", "root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_mark = named.join(least, "root").select("fp", "component_id")
    return marked.join(by_mark, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
