"""One document of each group of near copies: word shingles with a Jaccard similarity of SIMILAR or more, exactly.

Operator 10 with the parameters of a corpus: shingles of five words. Texts reduce to distinct sequences of words first.

1. The SimHash fingerprints of the shingles are searched by operator 10's vantage-point trees; the links found are
   checked by the parities and the whole sets, and those that hold join their texts.
2. At a similarity of 0.8 two fingerprints may well differ in ten bits, where trees prune nothing, so step 1 alone
   loses links. An exact bound finds the rest: where all shingles stand in one global order, two sets with a
   similarity of t or more share one of the first n - ceil(t n) + 1 shingles of each, n being the set's own size. So
   only texts that share a shingle there are compared, and only with texts that nothing has joined them to. The order
   is that of the shingles' hashes; those in the prefixes of more than HOT texts come last, so that a common line makes no
   candidates of texts it is a small part of. Where that leaves a text fewer than 1 / 9 of its shingles in front, as in a large
   group of near copies, the next ones would be as frequent, so those in more than HOT of such texts come last too, wherever they
   stand: what a copy has of its own comes first, and copies with too much of it never meet. They are known by a bitmap of
   SPOTS bits or, where they are too many for one, by a join of all shingles with the table of them.

   Of a pair, the first shingle they share also bounds from its two positions how many more they can share; a pair
   that no shared shingle allows for is no candidate. That is so for texts of which a common passage is the larger part.

3. A candidate's parities and prefixes are compared before its whole sets. Of an overlap that two sets need, each has at
   most what is behind its prefix outside of it, so the prefixes themselves must share the rest, exactly: a tenth of
   the sets where they are of one size. Two long texts that share a passage fail there.

Texts that share a shingle are compared with a few leaders of theirs first, which joins large groups of near copies by
as many comparisons as they have members; then only pairs from different components are compared, and only at the first
shingle they share. A wide fingerprint (the parities of the shingles on BITS bits; folded to fewer where it travels with
every shingle) rules out pairs that differ too much, again without a miss; the others are compared by their whole sets. Components are closed over links, as in ``simhash``.

Defined cases: texts without words (null, empty, blank) are copies of each other; texts of fewer than SHINGLE words
are one shingle; very long texts have all their shingles; shingles count as equal where their 64-bit hashes are, sequences of
words where two such hashes are; of rows with equal doc_id and text any one, of others with equal doc_id the one with the smaller hash
counts as first; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.llm.common import durable
from cuewise.llm.simhash import components, fingerprint_links

SHINGLE = 5
SIMILAR = (4, 5)  # a fraction, so that bounds are exact
HOT = 20
LEADERS = 3
BITS = 512
SPOTS = 1 << 24  # bits of the bitmaps that reach the driver and the executors
SPARSE = 16  # a bitmap is only made where it has as many bits as that for each hash; joins by key take over where it has not
KNOWN = 1 << 17  # words that a worker remembers
SLICE = 256  # texts whose shingles a task holds at once


def _signed(value: int) -> int:
    return value - ((value >> 63) << 64)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_hash(words: list[bytes], clashing: frozenset[int] = frozenset()) -> int:
    """What a sequence of words goes by: a hash, or another one where different sequences share the first."""
    whole = b" ".join(words)
    own = _signed(xxhash.xxh3_64_intdigest(whole))
    return _signed(xxhash.xxh3_64_intdigest(whole, seed=1)) if own in clashing else own


class WordHashes(dict):
    """Word bytes to their hash; fills itself up to a bound."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN:
            self[word] = found
        return found


_hashes = WordHashes()


def shingles(words: list[bytes]) -> np.ndarray:
    """The hashes (int64) of the distinct shingles in rising order."""
    if not words:
        return np.zeros(0, np.int64)
    single = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        mixed = (mixed ^ single[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def simhash_of(found: np.ndarray) -> int:
    """The 64-bit SimHash of distinct shingles, int64."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):
        part = np.ascontiguousarray(found[i : i + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view(np.int64)[0])


class Spots:
    """A bitmap of SPOTS bits, by the low bits of a hash."""

    def __init__(self, at: np.ndarray, bits: np.ndarray) -> None:
        self.bits = np.zeros(SPOTS >> 6, np.int64)
        self.bits[at] = bits

    def __contains__(self, value: int) -> bool:
        at = value & (SPOTS - 1)
        return bool(int(self.bits[at >> 6]) >> (at & 63) & 1)

    def of(self, values: np.ndarray) -> np.ndarray:
        at = values & (SPOTS - 1)
        return (self.bits[at >> 6] >> (at & 63)) & 1 == 1


def spots(keys: DataFrame, key: str) -> Spots | None:
    """The bitmap of a column of hashes, where at most one bit in SPARSE would be set; SPOTS / 64 rows at most reach the driver."""
    if keys.count() * SPARSE > SPOTS:
        return None
    at = F.col(key).bitwiseAND(F.lit(SPOTS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    found = keys.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    return Spots(found.column("at").to_numpy(), found.column("bits").to_numpy())


def prefix(found: np.ndarray, hot: Spots | None) -> np.ndarray:
    """The shingles of which two similar sets share one; those on ``hot`` spots come last."""
    n = len(found)
    if hot is not None and n:
        late = hot.of(found)
        found = np.concatenate([found[~late], found[late]])
    return found[: n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1] if n else found


def parities(found: np.ndarray) -> np.ndarray:
    """BITS bits as int64: how many shingles fall on each, modulo 2. Sets that differ in d shingles differ in d bits at most."""
    bits = np.bincount(found & (BITS - 1), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _marks(shared, clashing: frozenset[int], whole: bool = False) -> callable:
    """(h1, h2, text) to (h1, h2, id, id2, n, fp, keys, b0...): id2 is a second hash, fp the SimHash, keys the prefix (all, if whole),
    b0... the parities."""

    def mark(text: bytes | None, hot: Spots | None) -> tuple:
        words = words_of(text)
        found = shingles(words)
        return word_hash(words, clashing), word_hash(words, EVERY), len(found), simhash_of(found), parities(found), found if whole else prefix(found, hot).copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value if shared else None
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                id1, id2, n, fp, bits, keys = zip(*[mark(t.as_py(), hot) for t in part.column("text").cast(pa.binary())], strict=True)
                own = [pa.array(id1, pa.int64()), pa.array(id2, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), _lists(list(keys))]
                yield pa.RecordBatch.from_arrays([part.column("h1"), part.column("h2"), *own, *[pa.array(b) for b in np.array(bits, np.int64).T]], ["h1", "h2", "id", "id2", "n", "fp", "keys", *PARITIES])

    return run


class _Every(frozenset):
    def __contains__(self, value: object) -> bool:
        return True


EVERY = _Every()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sets(shared, clashing: frozenset[int]) -> callable:
    """(text) to (id, keys): the whole sets of the texts whose ids are on the spots asked for, others by chance; of all without spots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared else EVERY
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                ids, rows = [], []
                for t in batch.column("text").slice(i, SLICE).cast(pa.binary()):
                    words = words_of(t.as_py())
                    if (own := word_hash(words, clashing)) in wanted:
                        ids.append(own)
                        rows.append(shingles(words))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(rows)], ["id", "keys"])

    return run


PARITIES = [f"b{i}" for i in range(BITS // 64)]
FOLDED = ["q0", "q1"]
MARKS = "h1 long, h2 long, id long, id2 long, n int, fp long, keys array<long>, " + ", ".join(f"{b} long" for b in PARITIES)


def _apart(names: list[str], a: str, b: str) -> Column:
    """How many bits of the columns ``names`` differ between two rows, whose columns end in ``a`` and ``b``."""
    return sum((F.bit_count(F.col(f"{x}{a}").bitwiseXOR(F.col(f"{x}{b}"))) for x in names), F.lit(0))


def _folded() -> list[Column]:
    """The parities on fewer bits: that of a bit is the parity of those folded onto it."""
    fold = lambda i: reduce(Column.bitwiseXOR, [F.col(b) for b in PARITIES[i :: len(FOLDED)]])
    return [fold(i).alias(q) for i, q in enumerate(FOLDED)]


def _allowed(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b) of those ``pairs`` that the parities allow for."""
    mark = lambda x: distinct.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), *[F.col(b).alias(f"{b}_{x}") for b in PARITIES])
    most = (F.col("n_a") + F.col("n_b")) * (SIMILAR[1] - SIMILAR[0])
    return pairs.join(mark("a"), "a").join(mark("b"), "b").where(_apart(PARITIES, "_a", "_b") * sum(SIMILAR) <= most).select("a", "b")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _close(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b) of those ``pairs`` whose prefixes share as many shingles as similar sets' must."""
    asked = durable(distinct.select("id", "n", "keys").join(_ids(pairs), "id", "left_semi"))
    of = lambda x: asked.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("keys").alias(f"keys_{x}"))
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * SIMILAR[0] / sum(SIMILAR))
    # Behind the prefix of a set of n are ceil(t n) - 1 shingles.
    behind = F.ceil(F.greatest("n_a", "n_b") * SIMILAR[0] / SIMILAR[1]) - 1
    shared = F.size(F.array_intersect("keys_a", "keys_b"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(shared >= overlap - behind).select("a", "b")


def _verified(pairs: DataFrame, distinct: DataFrame, rows: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """(a, b) of those ``pairs`` whose whole sets are similar; ``distinct`` holds their marks, ``rows`` their texts."""
    pairs = durable(_close(durable(_allowed(pairs, distinct)), distinct))
    ids = durable(_ids(pairs))
    if not ids.take(1):
        return pairs
    sets = durable(_whole(rows, ids, clashing))
    of = lambda x: sets.select(F.col("id").alias(x), F.col("keys").alias(f"keys_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("keys_a", "keys_b"))
    return durable(both.where(shared * sum(SIMILAR) >= (F.size("keys_a") + F.size("keys_b")) * SIMILAR[0]).select("a", "b"))


def _pairs(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Distinct (a, b), a < b, of rows of two tables with a key and ``names`` that sizes and positions allow for and whose components differ.

    With ``prev`` among the names, only where a shingle is the first that two texts share, which it is not if the ones
    before it are equal; with the folded parities, only where those allow for it.
    """
    other = right.select("key", *[F.col(c).alias(f"{c}2") for c in names])
    left = left.select("key", *names)
    sizes = F.least("n", "n2") * SIMILAR[1] >= F.greatest("n", "n2") * SIMILAR[0]
    # At a similarity of t, t / (1 + t) of both sizes are shared: from the first shared shingle on.
    rest = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) * sum(SIMILAR) >= (F.col("n") + F.col("n2")) * SIMILAR[0]
    # Of two that pass, one at least has its shingle among the first 1 / 9 of its own.
    a, b = SIMILAR
    early = F.col("at") * (a + b) <= F.col("n") * (b - a)
    early2 = F.col("at2") * (a + b) <= F.col("n2") * (b - a)
    both = left.where(early).join(other, "key").unionByName(left.where(~early).join(other.where(early2), "key"))
    near = both.where((F.col("root") != F.col("root2")) & sizes & rest)
    if "prev" in names:
        near = near.where(F.coalesce(F.col("prev") != F.col("prev2"), F.lit(True)))
    if FOLDED[0] in names:
        near = near.where(_apart(FOLDED, "", "2") * (a + b) <= (F.col("n") + F.col("n2")) * (b - a))
    return near.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _shared(rows: DataFrame, bits: Spots | None):
    return rows.sparkSession.sparkContext.broadcast(bits) if bits else None


def reordered(rows: DataFrame, hot: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """The marks of distinct texts, with the prefixes of an order in which the shingles of ``hot`` (key) come last.

    By a bitmap that the tasks hold, or, where ``hot`` has too many keys for one, by joining all shingles with it. A bitmap
    puts a few others last too; any order of all shingles is exact.
    """
    bits = spots(hot, "key")
    if bits:
        return rows.mapInArrow(_marks(_shared(rows, bits), clashing), MARKS).dropDuplicates(["id"])
    whole = durable(rows.mapInArrow(_marks(None, clashing, whole=True), MARKS).dropDuplicates(["id"]))
    each = whole.select("id", "n", F.explode("keys").alias("key")).join(hot.select("key", F.lit(True).alias("late")), "key", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("late", F.lit(False)), "key")))
    n = F.col("n")
    first = F.slice(order, 1, (n - F.ceil(n * SIMILAR[0] / SIMILAR[1]) + 1).cast("int"))
    kept = each.groupBy("id", "n").agg(F.transform(first, lambda k: k["key"]).alias("__keys")).drop("n")
    return whole.join(kept, "id", "left").withColumn("keys", F.coalesce("__keys", F.array().cast("array<long>"))).drop("__keys")


def _bare(shared) -> callable:
    """(id, n, keys) to the ids of the texts that ``hot`` spots leave so little of a prefix that later shingles get among the first 1 / 9 of all."""
    a, b = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            ends = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            own = np.concatenate([[0], np.cumsum(~shared.value.of(keys.flatten().to_numpy()))])[ends]
            bare = (own[1:] - own[:-1]) * (a + b) <= batch.column("n").to_numpy() * (b - a)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(bare))], ["id"])

    return run


def frequent(rows: DataFrame, distinct: DataFrame, hot: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """``hot`` (key), the shingles of too many prefixes, and those that would take their places in as many: shingles of the whole sets of texts that
    ``hot`` leaves little of a prefix."""
    bits = spots(hot, "key")
    if bits:
        ids = durable(distinct.select("id", "n", "keys").mapInArrow(_bare(_shared(rows, bits)), "id long"))
    else:
        each = distinct.select("id", "n", F.explode("keys").alias("key")).join(hot.select("key", F.lit(1).alias("late")), "key", "left")
        own = F.count("*") - F.count("late")
        ids = durable(each.groupBy("id", "n").agg(own.alias("own")).where(F.col("own") * sum(SIMILAR) <= F.col("n") * (SIMILAR[1] - SIMILAR[0])).select("id"))
    if not ids.take(1):
        return hot
    return durable(hot.unionByName(_repeated(_whole(rows, ids, clashing)).where(F.col("c") > HOT).select("key")).distinct())


def _whole(rows: DataFrame, ids: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """(id, keys): the whole sets of the texts ``ids``."""
    sets = rows.select("text").mapInArrow(_sets(_shared(rows, spots(ids, "id")), clashing), "id long, keys array<long>")
    return sets.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _repeated(distinct: DataFrame) -> DataFrame:
    return durable(distinct.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of texts that the SimHash trees link: those of one fingerprint, and of linked ones."""
    marks = durable(distinct.groupBy("fp").agg(F.min("id").alias("first")))
    same = distinct.join(marks, "fp").where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    of = lambda x: marks.select(F.col("fp").alias(f"fp_{x}"), F.col("first").alias(x))
    links = fingerprint_links(marks.select("fp")).toDF("fp_a", "fp_b").distinct()
    near = links.join(of("a"), "fp_a").join(of("b"), "fp_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.unionByName(near)


def similar_links(rows: DataFrame, distinct: DataFrame, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """(a, b): links that span the components of the ``distinct`` marks, whose texts are in ``rows``."""
    links = _verified(fingerprint_pairs(distinct), distinct, rows, clashing)
    keys = _repeated(distinct)
    hot = keys.where(F.col("c") > HOT).select("key")
    if hot.take(1):
        distinct = durable(reordered(rows, frequent(rows, distinct, hot, clashing), clashing))
        keys = _repeated(distinct)
    met = distinct.select("id", "n", F.posexplode("keys").alias("at", "key")).join(keys, "key").select("key", "id", "n", "at")
    before = F.lag("key").over(Window.partitionBy("id").orderBy("at"))
    met = durable(met.withColumn("prev", before).join(distinct.select("id", *_folded()), "id"))
    group = _rooted(met, links)
    member = ["id", "n", "at", "root"]
    # The one with the fewest shingles of its own is the nearest to the middle of a group; others are any.
    order = lambda turn: F.struct(F.lit(0) if turn else F.col("at"), F.xxhash64("id", "key", F.lit(turn)))
    found = group.groupBy("key").agg(*[F.min_by(F.struct(*member), order(turn)).alias(f"l{turn}") for turn in range(LEADERS)])
    leaders = found.select("key", F.explode(F.array_distinct(F.array(*[f"l{turn}" for turn in range(LEADERS)]))).alias("l")).select("key", "l.*")
    links = durable(links.unionByName(_verified(_pairs(group, leaders, member), distinct, rows, clashing)))
    group = _rooted(met, links)
    # What is left: keys in several components. Of two members in different ones, one at least is outside the first leader's.
    main = group.groupBy("key").agg(F.min_by("root", order(0)).alias("main"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = durable(group.join(main.where("low != high").select("key", "main"), "key"))
    return links.unionByName(_verified(_pairs(mixed.where("root != main"), mixed, [*member, "prev", *FOLDED]), distinct, rows, clashing))


def _rooted(met: DataFrame, links: DataFrame) -> DataFrame:
    """``met`` with the ``root`` of each id's component over ``links``."""
    roots = components(links).withColumnRenamed("node", "id")
    return durable(met.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))


def clashes(marks: DataFrame) -> frozenset[int]:
    """The ids that different sequences of words share, as their second hashes tell: of n texts about n^2 / 2^65, so hardly any."""
    ends = marks.groupBy("id").agg(F.min("id2").alias("low"), F.max("id2").alias("high"))
    return frozenset(r["id"] for r in ends.where("low != high").select("id").collect())


def one_of_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns: of each component one row stays, that with the smallest doc_id, nulls last.

    Rows of one doc_id with different texts are different documents.
    """
    number = F.col("doc_id").cast("long")
    keyed = docs.withColumns({"__h1": F.xxhash64(number, "text"), "__h2": F.xxhash64(F.lit(1), "text", number)})
    rows = keyed.select(F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), "text")
    marks = durable(rows.mapInArrow(_marks(None, frozenset()), MARKS))
    clashing = clashes(marks)
    if clashing:
        marks = durable(rows.mapInArrow(_marks(None, clashing), MARKS))
    roots = components(similar_links(rows, durable(marks.dropDuplicates(["id"])), clashing)).withColumnRenamed("node", "id")
    named = keyed.select(F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), number.alias("doc_id")).distinct()
    grouped = marks.select("h1", "h2", "id").distinct().join(named, ["h1", "h2"]).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("f")
    keep = durable(grouped.groupBy("root").agg(first).select(F.col("f.h1").alias("__h1"), F.col("f.h2").alias("__h2")))
    order = Window.partitionBy("__h1", "__h2").orderBy("__h1")
    kept = keyed.join(keep, ["__h1", "__h2"], "left_semi").withColumn("__row", F.row_number().over(order)).where("__row = 1")
    return kept.select(*docs.columns)
