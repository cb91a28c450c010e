"""Exact top-k search by inner product: ball-tree branch and bound in shards that share the current kth score.

Components become whole numbers floor(256 * x). Every row lies in one shard: a region, that of the nearest of at most REGIONS
centres (the leaves of a ball tree over a bounded sample), dealt out by row number to shards of about ROWS rows, so that
one vector that many rows repeat fills several shards and no shard is large. A shard's task builds a ball tree over its rows.

For a query q and a ball with centre c and radius r, no member scores above q.c + |q| r. A search goes down the tree
level by level, drops the balls that cannot reach the query's kth score, and visits the leaves left in order of their
bounds, until the next bound is below the kth score found meanwhile. There are two waves: the first searches each query
in its own shard; its kth score (with the id there, as ties go to the smaller id) then goes with the query to
all other shards of those regions whose ball can reach it. A shard's queries stream past its tree, QUERIES a block.

What is bounded: SAMPLE components of sampled vectors fit the centres and reach the driver; from it, at most REGIONS
centres and radii of a length go to the tasks. All rows are indexed and all rows are exact candidates; the sample only decides where.

Defined cases: vectors that are null, empty, or hold null or non-finite components (or such that 256 * x is not finite) take no part;
a query meets only vectors of its own length; a row without vec_id is a candidate, ranked last among ties, and no
query; rows that repeat a vec_id are rows of their own: each meets the others, and each is a query; scores beyond the range
of a long are its ends; fewer than k candidates give fewer rows; very long vectors count whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewise.llm.common import durable
from cuewise.llm.vectors import as_lists, by_length

K = 5
EVERY = 50
SCALE = 256
ROWS, LEAF = 8192, 128
REGIONS = 256
SAMPLE = 1 << 22  # components
QUERIES = 1 << 18
BLOCK = 2048  # queries that a task searches at once
LAST = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min
EXACT = 2.0**53


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products (int64) of whole numbers held as doubles; beyond a long, its ends."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    wide = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.clip(wide, LEAST, LAST).astype(np.int64)


class BallTree:
    """A complete binary tree over the rows of a matrix; each node a ball around its rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(x))
        self.spans: list[list[tuple[int, int]]] = [[(0, len(x))]]
        self.balls = [self._balls(x, self.spans[0])]
        for _ in range(max(0, math.ceil(math.log2(max(1, len(x) / leaf))))):
            below = []
            for a, b in self.spans[-1]:
                rows = self.order[a:b]
                mid = (b - a) // 2
                self.order[a:b] = rows[np.argpartition(self._along(x[rows]), mid)]
                below += [(a, a + mid), (a + mid, b)]
            self.spans.append(below)
            self.balls.append(self._balls(x, below))

    @staticmethod
    def _along(x: np.ndarray) -> np.ndarray:
        """Where rows lie along the line through two that are far apart."""
        one = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
        other = x[np.argmax(((x - one) ** 2).sum(1))]
        return x @ (other - one)

    def _balls(self, x: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        centres = np.array([x[self.order[a:b]].mean(0) for a, b in spans])
        radii = np.array([np.sqrt(((x[self.order[a:b]] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, centres, strict=True)])
        return centres, radii


def upper_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No inner product of a query with a ball's member is above; a little more than that, for rounding."""
    norms = np.sqrt((q**2).sum(1))[:, None]
    reach = q @ centres.T + norms * radii
    return reach + 1.0 + 1e-9 * (norms * (np.sqrt((centres**2).sum(1)) + radii))


class Best:
    """The k best (score, id, row) so far of each of some queries: higher scores first, then smaller ids."""

    def __init__(self, m: int, k: int, score: np.ndarray, key: np.ndarray) -> None:
        """``score``, ``key``: what an answer must beat, found elsewhere; it is no answer itself."""
        self.k, self.floor, self.floor_key = k, score, key
        self.score, self.key, self.row = (np.full((m, k), v, np.int64) for v in (LEAST, LAST, -1))

    def limits(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What an answer must beat now."""
        score, key = self.score[rows, -1], self.key[rows, -1]
        full = self.row[rows, -1] >= 0
        own = full & ((score > self.floor[rows]) | ((score == self.floor[rows]) & (key < self.floor_key[rows])))
        return np.where(own, score, self.floor[rows]), np.where(own, key, self.floor_key[rows])

    def take(self, rows: np.ndarray, scores: np.ndarray, keys: np.ndarray, at: np.ndarray, allowed: np.ndarray) -> None:
        """``scores`` (queries x candidates) of the queries ``rows``; keys and at (row numbers) of the candidates."""
        limit, limit_key = self.limits(rows)
        better = (scores > limit[:, None]) | ((scores == limit[:, None]) & (keys < limit_key[:, None]))
        q, c = np.nonzero(better & allowed)
        touched = np.unique(q)
        old = self.row[rows[touched]] >= 0
        oq, oc = np.nonzero(old)
        of = np.concatenate([q, touched[oq]])
        score = np.concatenate([scores[q, c], self.score[rows[touched]][oq, oc]])
        key = np.concatenate([keys[c], self.key[rows[touched]][oq, oc]])
        row = np.concatenate([at[c], self.row[rows[touched]][oq, oc]])
        order = np.lexsort((row, key, ~score, of))
        of, score, key, row = of[order], score[order], key[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        kept = place < self.k
        for target, values in ((self.score, score), (self.key, key), (self.row, row)):
            target[rows[of[kept]], place[kept]] = values[kept]


def search(tree: BallTree, x: np.ndarray, keys: np.ndarray, at: np.ndarray, q: np.ndarray, own: np.ndarray, best: Best) -> int:
    """Puts into ``best`` what beats it among the rows ``x`` (keys: ids to order by, at: row numbers); how many products it took."""
    alive = np.ones((len(q), 1), bool)
    every = np.arange(len(q))
    for depth, (centres, radii) in enumerate(tree.balls):
        if depth:
            alive = np.repeat(alive, 2, axis=1)
        limit = best.limits(every)[0]
        bounds = np.where(alive, upper_bounds(q, centres, radii), -np.inf)
        alive &= bounds >= limit[:, None]
    bounds = np.where(alive, bounds, -np.inf)
    order = np.argsort(-bounds, axis=1, kind="stable")
    made = 0
    for turn in range(order.shape[1]):
        leaf = order[:, turn]
        reach = bounds[every, leaf]
        active = np.flatnonzero((reach >= best.limits(every)[0]) & (reach > -np.inf))
        if not len(active):
            break
        for number in np.unique(leaf[active]).tolist():
            rows = active[leaf[active] == number]
            a, b = tree.spans[-1][number]
            members = tree.order[a:b]
            best.take(rows, products(q[rows], x[members]), keys[members], at[members], at[members] != own[rows][:, None])
            made += len(rows) * len(members)
    return made


def _placed(shared) -> Callable:
    """(vec_id, embedding) to (vec_id, dim, region, far, x): the nearest centre of the length's, and the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value if shared else {}
        for batch in batches:
            for rows, matrix in by_length(batch.column("embedding")):
                with np.errstate(over="ignore"):
                    x = np.floor(matrix * SCALE)
                fine = np.isfinite(x).all(1)
                x, rows = x[fine], rows[fine]
                if not len(x):
                    continue
                dim, near = x.shape[1], np.zeros(len(x), np.int32)
                own = centres.get(dim, np.zeros((1, dim)))
                if len(own) > 1:
                    near = np.argmin((own**2).sum(1) - 2 * (x @ own.T), axis=1).astype(np.int32)
                far = np.sqrt(((x - own[near]) ** 2).sum(1))
                ids = batch.column("vec_id").take(pa.array(rows)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(x), dim, np.int32)), pa.array(near), pa.array(far), as_lists(x)], ["vec_id", "dim", "region", "far", "x"])

    return run


def centres_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The centres of each sampled length: leaves of a ball tree over a sample of SAMPLE components."""
    counted = vectors.agg(F.count("*").alias("n"), F.sum(F.greatest(F.size("embedding"), F.lit(0))).alias("c")).first()
    share = max(1, math.ceil((counted["c"] or 0) / SAMPLE))
    # By the value: equal vectors fall in or out together, which only moves centres.
    taken = vectors.select("vec_id", "embedding").where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(share)) == 0)
    found: dict[int, list] = {}
    for r in taken.mapInArrow(_placed(None), "vec_id long, dim int, region int, far double, x array<double>").select("dim", "x").toArrow().to_batches():
        dims = r.column("dim").to_numpy()
        for rows, x in by_length(r.column("x")):
            found.setdefault(int(dims[rows[0]]), []).append(x)
    regions = min(REGIONS, max(1, counted["n"] // ROWS))
    out = {}
    for dim, parts in found.items():
        x = np.vstack(parts)
        out[dim] = BallTree(x, max(1, math.ceil(len(x) / regions))).balls[-1][0]
    return out


PLACED = "vec_id long, dim int, region int, far double, x array<double>"
ANSWER = "query long, query_id long, row long, vec_id long, score long"
SIDES = ["dim", "region", "salt", "block", "side", "row", "vec_id", "x", "score", "key"]


def _answers(k: int) -> Callable:
    """Partitions in order of shard, candidates before queries, to the answers of each query in each shard."""

    def held(batches: list[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(batches).combine_chunks()

    def matrix(column) -> np.ndarray:
        lists = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        width = len(lists[0])
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def ordered(column) -> np.ndarray:
        return column.fill_null(LAST).to_numpy()

    def answer(tree: BallTree, shard: tuple, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, keys, at = shard
        for i in range(0, rows.num_rows, BLOCK):
            part = rows.slice(i, BLOCK)
            q, own = matrix(part.column("x")), part.column("row").to_numpy()
            best = Best(len(q), k, part.column("score").to_numpy(), part.column("key").to_numpy())
            search(tree, x, keys, at, q, own, best)
            of, place = np.nonzero(best.row >= 0)
            key = best.key[of, place]
            ids = pa.array(key, pa.int64(), mask=key == LAST)
            yield pa.RecordBatch.from_arrays([pa.array(own[of]), part.column("vec_id").take(pa.array(of)), pa.array(best.row[of, place]), ids, pa.array(best.score[of, place])], ["query", "query_id", "row", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, shard, tree = None, [], None, None
        for batch in batches:
            at = np.array([batch.column(c).to_numpy() for c in ("dim", "region", "salt", "block", "side")]).T
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                key, side, part = tuple(at[a, :4].tolist()), at[a, 4], batch.slice(a, b - a)
                if key != now:
                    now, waiting, tree = key, [], None
                if side == 0:
                    waiting.append(part)
                elif waiting:
                    if tree is None:
                        table = held(waiting)
                        shard = matrix(table.column("x")), ordered(table.column("vec_id").chunk(0)), table.column("row").to_numpy()
                        tree = BallTree(shard[0])
                    yield from answer(tree, shard, part)

    return run


def _reached(shared) -> Callable:
    """Queries with their limits to (the same, region) for each region of their length whose ball can reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = shared.value
        for batch in batches:
            limit = batch.column("score").to_numpy()
            for rows, q in by_length(batch.column("x")):
                numbers, centres, radii = balls.get(q.shape[1], (np.zeros(1, np.int32), np.zeros((1, q.shape[1])), np.full(1, np.inf)))
                of, region = np.nonzero(upper_bounds(q, centres, radii) >= limit[rows][:, None])
                out = batch.select(["row", "vec_id", "dim", "x", "score", "key", "home"]).take(pa.array(rows[of]))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(numbers[region])], [*out.schema.names, "region"])

    return run


def _wave(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The answers of ``queries`` in the shards that they name."""
    shards = ["dim", "region", "salt", "block"]
    both = candidates.select(*SIDES).unionByName(queries.select(*SIDES))
    return both.repartition(*shards).sortWithinPartitions(*shards, "side").mapInArrow(_answers(k), ANSWER)


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding")
    centres = centres_of(vectors)
    placed = vectors.mapInArrow(_placed(spark.sparkContext.broadcast(centres)), PLACED)
    placed = durable(placed.withColumn("row", F.monotonically_increasing_id()))
    asked = (F.col("vec_id") % every == 0)
    sizes = durable(placed.groupBy("dim", "region").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count_if(asked).alias("asked")))
    salts = F.ceil(F.col("n") / ROWS).cast("int")
    rows = placed.join(sizes.select("dim", "region", salts.alias("salts")), ["dim", "region"])
    rows = rows.withColumn("salt", F.pmod("row", F.col("salts")).cast("int"))
    none = [F.lit(int(LEAST)).alias("score"), F.lit(int(LAST)).alias("key")]
    candidates = rows.select("dim", "region", "salt", F.lit(0).alias("side"), "row", "vec_id", "x", *none)
    queries = rows.where(asked).select("dim", "region", "salt", F.lit(1).alias("side"), "row", "vec_id", "x", *none)
    one = F.lit(0).alias("block")
    first = durable(_wave(candidates.withColumn("block", one), queries.withColumn("block", one), k))

    # The kth of the first wave, where it has k.
    kth = first.groupBy(F.col("query").alias("row")).agg(F.count("*").alias("found"), F.max(F.struct(-F.col("score"), F.coalesce("vec_id", F.lit(int(LAST))))).alias("worst"))
    kth = kth.where(F.col("found") >= k).select("row", (-F.col("worst.col1")).alias("score"), F.col("worst.col2").alias("key"))
    limited = queries.drop("score", "key").join(kth, "row", "left")
    limited = limited.select("row", "vec_id", "dim", "x", F.coalesce("score", none[0]).alias("score"), F.coalesce("key", none[1]).alias("key"), F.struct("region", "salt").alias("home"))
    known = sizes.where(F.col("dim").isin(list(centres))).select("dim", "region", "far").toPandas() if centres else None
    balls = {}
    for dim, own in known.groupby("dim") if known is not None else ():
        numbers = own["region"].to_numpy(np.int32)
        balls[int(dim)] = numbers, centres[int(dim)][numbers], own["far"].to_numpy()
    reached = limited.mapInArrow(_reached(spark.sparkContext.broadcast(balls)), "row long, vec_id long, dim int, x array<double>, score long, key long, home struct<region:int,salt:int>, region int")
    blocks = math.ceil((sizes.agg(F.sum("asked")).first()[0] or 0) / QUERIES)
    reached = reached.join(sizes.select("dim", "region", salts.alias("salts")), ["dim", "region"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    away = reached.where((F.col("region") != F.col("home.region")) | (F.col("salt") != F.col("home.salt")))
    away = away.withColumns({"side": F.lit(1), "block": F.pmod("row", F.lit(max(1, blocks))).cast("int")})
    met = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))))
    answers = first.unionByName(_wave(met, away, k))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    return answers.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
