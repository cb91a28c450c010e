"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of two neighbouring chunks of CHUNK words. Words are lower-cased, freed of ASCII
punctuation and hashed to FEATURES columns, weighted by inverse document frequency over all documents.

1. Words to features: one pass over all documents, written once, two bytes a word. Document frequencies from those.
2. Randomised SVD of the TF-IDF passages of all documents, in two passes over their features. Tasks send X'(X Omega), one
   aggregation sums it by feature and the driver takes its QR; tasks send (XQ)'(XQ), whose eigenvectors give RANK latent
   directions. Each core gets TASKS_A_CORE tasks at most, so what they send does not grow with the table.
3. Search: every passage of every document is projected and compared by cosine in the whitened
   latent space with the benchmark's items, in blocks of BLOCK items. Candidates are few. An item shorter than a
   passage can only fill a part of it, so its bound is COSINE times the square root of that part, LEAST_PART at least.
   A place with the first MIN_WORDS words of an item is a candidate too, whatever its cosine, so verbatim items are
   all found. Items of fewer than MIN_WORDS words are looked up exactly, word by word.
4. A candidate counts if the longest common subsequence with the text around the passage covers
   SURE of the item's words, or LIKELY of them and the item's answer (its last ANSWER words) shows there too.

The benchmark is a stated query set; its blocks are broadcast with a bounded number of items each. Tasks read their batches in
slices of a few rows, so that a worker's memory doesn't grow with the batch.

Defined cases: null or blank text matches nothing; a null doc_id matches and is kept or dropped like any other; very long texts
are searched whole; an empty table of documents gives an empty result; items without words match nothing; items shorter
than MIN_WORDS words need all their words in a row; repeated rows each match; an empty benchmark leaves all
documents as they are; ties don't matter, as every item above the bounds counts; other columns of
the documents pass through ``clean_documents`` and are ignored by ``find_leaks``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import durable
from cuewise.operators.hearing import slices

CHUNK = 16
FEATURES = 8192
RANK, EXTRA = 96, 8
LEAST_VALUE = 1e-4  # of the largest squared singular value
TASKS_A_CORE = 4
BLOCK = 20_000
LONG_ITEM, PIECE = 64, 48
COSINE, LEAST_PART = 0.45, 0.25
SURE, LIKELY, ANSWER, ANSWER_SURE = 0.8, 0.6, 6, 0.8
MIN_WORDS = 8
LOOKED_AT = 64  # candidates looked at at once
PART = 1 << 13  # passages sketched at once: a long text has more
STEP = 1 << 15  # words of the texts that are searched at once
PROJECTED = 1 << 7  # chunks whose words are summed at once: 0.8 MB, which a core's cache holds
TEXT_STEP, SHORT_WORD = 1 << 16, 64  # bytes cut into words at once; bytes of a word that are hashed by a table

_SPACES = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()


class Features:
    """The column of each word: crc32 of its bytes modulo FEATURES.

    Of whole texts without an object a word: but for a constant that goes with the length, the crc32 is the exclusive or of one
    value for each byte, which depends on the byte and on how many follow it in the word.
    """

    _by_byte = _by_length = None

    def __init__(self) -> None:
        if Features._by_byte is None:
            blank = [zlib.crc32(bytes(n)) for n in range(SHORT_WORD + 1)]
            Features._by_length = (np.array(blank) % FEATURES).astype(np.int32)
            Features._by_byte = (np.array([[zlib.crc32(bytes([b]) + bytes(k)) ^ blank[k + 1] for b in range(256)] for k in range(SHORT_WORD)]) % FEATURES).astype(np.uint16).ravel()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((zlib.crc32(w) % FEATURES for w in words), np.int32, len(words))

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The features of the texts' words one after the other, and how many each text has: those of ``words_of``."""
        parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        ends = np.cumsum([len(p) + 1 for p in parts])
        whole = b" ".join([*parts, b""]).translate(_SPACES)
        ids, before, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while at < len(whole):
            stop = (whole.rfind(b" ", at, at + TEXT_STEP) + 1) or (whole.find(b" ", at + TEXT_STEP) + 1)
            own, starts = self._of_bytes(whole[at:stop])
            ids.append(own)
            before.append(starts + at)
            at = stop
        found = np.searchsorted(np.concatenate(before), ends)
        return np.concatenate(ids), np.diff(found, prepend=0)

    def _of_bytes(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The features of the words of a text that ends with a space, and where they start."""
        points = np.frombuffer(text, np.uint8)
        inside = points != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        starts, stops = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.int32), starts
        sizes = (stops - starts).astype(np.int32)
        ends = np.cumsum(sizes, dtype=np.int32)
        key = np.repeat(ends, sizes)  # how many bytes of the word follow, and the byte
        key -= np.arange(1, len(key) + 1, dtype=np.int32)
        np.minimum(key, SHORT_WORD - 1, out=key)
        key <<= 8
        key |= points[inside]
        hashed = np.bitwise_xor.reduceat(self._by_byte.take(key), ends - sizes)
        ids = hashed.astype(np.int32) ^ self._by_length[np.minimum(sizes, SHORT_WORD)]
        for i in np.flatnonzero(sizes > SHORT_WORD).tolist():
            ids[i] = zlib.crc32(text[starts[i] : stops[i]]) % FEATURES
        return ids, starts


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in slices(batches):
        ids, counts = features.of_texts(batch.column("text").to_pylist())
        offsets = np.concatenate([[0], 2 * np.cumsum(counts)]).astype(np.int64)
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(np.int16))])
        yield pa.RecordBatch.from_arrays([made.cast(pa.binary())], ["ids"])


def hashed(docs: DataFrame) -> DataFrame:
    """``ids``: the features of each document's words, two bytes each."""
    return docs.select("text").mapInArrow(_hash, "ids binary")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The features of a batch's documents one after the other, and how many each has."""
    column = batch.column("ids").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) // 2
    held = column.buffers()[2]
    ids = np.frombuffer(held, np.int16, held.size // 2) if held else np.zeros(0, np.int16)
    return ids[offsets[0] : offsets[-1]], np.diff(offsets)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(FEATURES + 1, np.int64), 0
    mark = np.zeros(FEATURES, bool)
    for batch in slices(batches):
        ids, counts = _ids(batch)
        for own in np.split(ids, np.cumsum(counts)[:-1]):
            mark[:] = False
            mark[own] = True
            df[:FEATURES] += mark
            n += 1
    df[FEATURES] = n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(df)], ["i", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + df)) of each feature, over all of ``docs``."""
    return _weights(hashed(docs))


def _weights(ids: DataFrame) -> np.ndarray:
    df = np.zeros(FEATURES + 1)
    for r in ids.mapInArrow(_frequencies, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[r["i"]] = r["n"]
    return np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])).astype(np.float32)


def _chunks(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts in chunks of CHUNK, each text's last one filled up with FEATURES, and the text of each chunk."""
    chunks = -(-counts // CHUNK)
    flat = np.full(chunks.sum() * CHUNK, FEATURES, np.int32)
    ahead = np.cumsum(chunks) * CHUNK - np.cumsum(counts)  # what is filled up before the next text
    flat[np.arange(len(ids)) + np.repeat(np.concatenate([[0], ahead[:-1]]), counts)] = ids
    return flat.reshape(-1, CHUNK), np.repeat(np.arange(len(counts)), chunks)


def _projected(table: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """The sum of the table's rows over each chunk."""
    parts = [table[chunks[i : i + PROJECTED]].sum(1) for i in range(0, len(chunks), PROJECTED)]
    return np.concatenate([np.zeros((0, table.shape[1]), table.dtype), *parts])


def _passages(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks that passages begin with, and whether they have a second one; a text of one chunk is a passage too."""
    follows = np.append(row[1:] == row[:-1], False)
    first = np.flatnonzero(follows | np.append(True, row[1:] != row[:-1]))
    return first, follows[first]


def _norms(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The norms of the TF-IDF weights of passages, rows of features."""
    n, size = words.shape
    words = np.sort(words.astype(np.int16), axis=1)
    fresh = np.ones((n, size), bool)
    np.not_equal(words[:, 1:], words[:, :-1], out=fresh[:, 1:])
    starts = np.flatnonzero(fresh.ravel())
    weight = np.diff(starts, append=n * size) * weights.astype(np.float64)[words.ravel()[starts]]
    return np.sqrt(np.bincount(starts // size, weight**2, n))


def _sketch(shared) -> callable:
    """Sum of X'(X basis), or of (X basis)'(X basis) where ``inner``; a row of floats for each index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis, inner = shared.value
        weights = np.append(idf, np.float32(0))
        table = np.concatenate([idf[:, None] * basis, np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32)
        total = np.zeros((basis.shape[1], basis.shape[1] if inner else FEATURES + 1))
        for batch in slices(batches):
            for _, ids, counts in _grouped(*_ids(batch), 4 * STEP):
                every, row = _chunks(ids, counts)
                begins, pairs = _passages(row)
                for i in range(0, len(begins), PART):
                    first, two = begins[i : i + PART], pairs[i : i + PART, None]
                    chunks, first = every[first[0] : first[-1] + 2], first - first[0]
                    second = np.minimum(first + 1, len(chunks) - 1)
                    over = 1 / np.maximum(_norms(np.concatenate([chunks[first], np.where(two, chunks[second], FEATURES)], axis=1), weights), 1e-9).astype(np.float32)[:, None]
                    sums = _projected(table, chunks)
                    y = sums[second]
                    y *= two
                    y += sums[first]
                    y *= over
                    if inner:
                        total += y.T @ y
                        continue
                    held = np.zeros(sums.shape)  # what the words of each chunk get, from the passages that hold it
                    y *= over
                    held[first] = y
                    y *= two
                    held[second] += y
                    flat = chunks.ravel().astype(np.int64)
                    for k, own in enumerate(np.ascontiguousarray(held.T)):
                        total[k] += np.bincount(flat, np.repeat(own, CHUNK), FEATURES + 1)
        if not inner:
            total = total[:, :FEATURES].T * idf[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total.astype(np.float32)), pa.list_(pa.float32()))], ["i", "v"])

    return run


def _summed(docs: DataFrame, idf: np.ndarray, basis: np.ndarray, inner: bool) -> np.ndarray:
    """The tasks' matrices, summed by row in one aggregation; at most FEATURES rows reach the driver."""
    width = basis.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast((idf, basis, inner))
    parts = docs.mapInArrow(_sketch(shared), "i int, v array<float>")
    sums = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j].cast("double")) for j in range(width)]).alias("v"))
    out = np.zeros((width if inner else FEATURES, width))
    for i, v in sums.toArrow().to_pandas().itertuples(index=False):
        out[i] = v
    shared.unpersist()
    return out


def latent_directions(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """FEATURES x RANK: the idf-weighted, whitened right singular vectors of the passages of all ``docs``."""
    return _directions(hashed(docs), idf)


def _directions(ids: DataFrame, idf: np.ndarray) -> np.ndarray:
    ids = ids.coalesce(TASKS_A_CORE * ids.sparkSession.sparkContext.defaultParallelism)
    omega = np.random.default_rng(5).standard_normal((FEATURES, RANK + EXTRA)).astype(np.float32)
    q, _ = np.linalg.qr(_summed(ids, idf, omega, False))
    values, vectors = np.linalg.eigh(_summed(ids, idf, q.astype(np.float32), True))
    best = np.argsort(-values)[:RANK]
    best = best[values[best] > LEAST_VALUE * values.max()]  # the rest of a small corpus is rounding noise
    return (idf[:, None] * (q @ vectors[:, best]) / np.sqrt(values[best])).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-9)


def common_subsequence(item: list[bytes], text: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over the item's positions."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        if m := places.get(w, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def heads(ids: np.ndarray) -> np.ndarray:
    """A hash of the MIN_WORDS features from each position on."""
    out = np.zeros(max(0, len(ids) - MIN_WORDS + 1), np.uint64)
    for k in range(MIN_WORDS):
        out = (out ^ ids[k : k + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class Index:
    """A block of benchmark items and the latent directions they are searched in."""

    def __init__(self, items: list[tuple[int, list[bytes]]], directions: np.ndarray) -> None:
        features = Features()
        self.items, of, vectors, least = items, [], [], []
        self.sizes = np.array([len(words) for _, words in items], np.int64)
        self.ids = np.full((len(items), LONG_ITEM), FEATURES, np.int16)
        for own, (_, words) in zip(self.ids, items, strict=True):
            own[: len(words)] = features.of(words[:LONG_ITEM])
        self.table = np.concatenate([directions, np.zeros((1, directions.shape[1]), np.float32)])  # with a row for what fills a chunk up
        self.short: dict[bytes, list[int]] = {}  # by first word
        self.short_marks = np.zeros(FEATURES + 1, bool)  # by its feature
        self.heads: dict[int, list[int]] = {}
        self.head_marks = np.zeros(1 << 20, bool)  # by the top bits
        for i, (_, words) in enumerate(items):
            if len(words) < MIN_WORDS:
                self.short.setdefault(words[0], []).append(i)
                self.short_marks[features.of(words[:1])] = True
                continue
            head = heads(features.of(words[:MIN_WORDS]))
            self.heads.setdefault(int(head[0]), []).append(i)
            self.head_marks[head >> np.uint64(44)] = True
            pieces = [words] if len(words) <= LONG_ITEM else [words[a : a + PIECE] for a in range(0, len(words) - PIECE // 2, PIECE // 2)]
            for piece in pieces:
                of.append(i)
                vectors.append(directions[features.of(piece)].sum(0))
                least.append(COSINE * min(1.0, max(LEAST_PART, len(piece) / (2 * CHUNK))) ** 0.5)
        self.least = np.array(least, np.float32)
        self.of, self.vectors = np.array(of, np.int64), unit(np.array(vectors, np.float32).reshape(len(of), directions.shape[1]))

    def candidates(self, sums: np.ndarray, flat: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, item, cosine) of the bound of the item or more, if enough of the item's words may show around the passage."""
        sums = unit(sums)
        step = max(1, (1 << 21) // max(1, len(self.vectors)))
        for i in range(0, len(sums), step):
            cosines = sums[i : i + step] @ self.vectors.T
            at, piece = np.nonzero(cosines >= self.least)
            found = self._may_show(flat, place, i + at, self.of[piece])
            at, piece = at[found], piece[found]
            yield from zip((i + at).tolist(), self.of[piece].tolist(), cosines[at, piece].tolist(), strict=True)

    def _may_show(self, flat: np.ndarray, place: np.ndarray, passages: np.ndarray, items: np.ndarray) -> np.ndarray:
        """False where fewer of the item's features than LIKELY show around the passage: they bound the words that do. Long items pass."""
        out = self.sizes[items] > LONG_ITEM
        there = np.zeros((LOOKED_AT, FEATURES + 1), bool)
        for i in range(0, len(items), LOOKED_AT):
            first, own = passages[i : i + LOOKED_AT], items[i : i + LOOKED_AT]
            size, row = np.minimum(self.sizes[own], LONG_ITEM)[:, None], np.arange(len(own))[:, None]
            low = (first - np.minimum(place[first], LONG_ITEM // CHUNK))[:, None] * CHUNK
            low = np.maximum(low, first[:, None] * CHUNK - size)
            high = np.minimum((first[:, None] + 2) * CHUNK + size, len(flat))
            near = low + np.arange(2 * (CHUNK + size.max()))
            near = flat[np.where(near < high, near, low)]
            there[row, near] = True
            shown = (there[row, self.ids[own]] & (np.arange(LONG_ITEM) < size)).sum(1)
            there[row, near] = False
            out[i : i + LOOKED_AT] |= shown >= LIKELY * size[:, 0]
        return out

    def starts(self, ids: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, item, 1) where an item's first words stand."""
        found = heads(ids)
        for at in np.flatnonzero(self.head_marks[found >> np.uint64(44)]).tolist():
            for i in self.heads.get(int(found[at]), ()):
                yield at // CHUNK, i, 1.0

    def verdict(self, item: list[bytes], around: list[bytes]) -> tuple[float, float] | None:
        """(share of the item, share of its answer) in the text around a passage, if they suffice."""
        there = set(around)  # words that don't show at all bound the subsequence from above
        if sum(map(there.__contains__, item)) < LIKELY * len(item):
            return None
        share = common_subsequence(item, around) / len(item)
        if share < LIKELY:
            return None
        answer = item[-ANSWER:]
        # The answer counts as a nearly unbroken run, else common words would make it up.
        runs = [common_subsequence(answer, around[i : i + len(answer) + 2]) for i in range(max(1, len(around) - len(answer) + 1))]
        shown = max(runs) / len(answer)
        return (share, shown) if share >= SURE or shown >= ANSWER_SURE else None

    def matches(self, texts: list[str | None], features: Features) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item_id, cosine, share, answer share) for the items that each text holds."""
        for group, ids, counts in _grouped(*features.of_texts(texts)):
            chunks, row = _chunks(ids, counts)
            flat, words = chunks.ravel(), {}  # of the texts that hold a candidate
            sums = _projected(self.table, chunks)
            place = np.arange(len(chunks)) - np.searchsorted(row, row)
            follows = np.append(row[1:] == row[:-1], False)
            windows = sums.copy()
            windows[:-1] += sums[1:] * follows[:-1, None]
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for p, i, cosine in chain(self.starts(flat), self.candidates(windows, flat, place)):
                r = int(row[p])
                found = best.get((r, i))
                if found and found[1] == 1.0:
                    continue
                item, at = self.items[i][1], int(place[p]) * CHUNK
                if r not in words:
                    words[r] = words_of(texts[group[r]])
                around = words[r][max(0, at - len(item)) : at + 2 * CHUNK + len(item)]
                if (v := self.verdict(item, around)) and (not found or v > found[1:]):
                    best[r, i] = (cosine, *v)
            for (r, i), v in best.items():
                yield (group[r], self.items[i][0], *v)
            for r, i in self.short_matches(flat, row, [texts[g] for g in group], words):
                yield (group[r], self.items[i][0], 1.0, 1.0, 1.0)

    def short_matches(self, flat: np.ndarray, row: np.ndarray, texts: list[str | None], words: dict[int, list[bytes]]) -> set[tuple[int, int]]:
        """(row, item) where all words of a short item stand in a row; texts without a first word's feature are not cut into words."""
        found = set()
        places = np.flatnonzero(self.short_marks[flat]) if self.short else np.zeros(0, np.int64)
        rows = row[places // CHUNK]
        for r, at in zip(rows.tolist(), (places - np.searchsorted(row, rows) * CHUNK).tolist(), strict=True):
            if r not in words:
                words[r] = words_of(texts[r])
            for i in self.short.get(words[r][at], ()):
                if words[r][at : at + len(self.items[i][1])] == self.items[i][1]:
                    found.add((r, i))
        return found


def _grouped(ids: np.ndarray, counts: np.ndarray, step: int = STEP) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rows with words, in groups of about ``step`` words: the rows, their words' features and how many each has."""
    ends = np.cumsum(counts)
    rows = np.flatnonzero(counts)
    first = 0
    while first < len(rows):
        done = ends[rows[first]] - counts[rows[first]]
        last = min(len(rows), int(np.searchsorted(ends[rows], done + step)) + 1)
        own = rows[first:last]
        yield own.tolist(), ids[done : ends[own[-1]]], counts[own]
        first = last


def _find(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches):
            found = list(shared.value.matches(batch.column("text").to_pylist(), features))
            ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            rest = [pa.array([f[k] for f in found], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))]
            yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return run


def _clean(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches):
            leaks = {f[0] for f in shared.value.matches(batch.column("text").to_pylist(), features)}
            yield batch.filter(pa.array([i not in leaks for i in range(batch.num_rows)], pa.bool_()))

    return run


def _indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """A broadcast index for each block of at most BLOCK items or so."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = -(-items.count() // BLOCK)
    if not blocks:
        return
    ids = durable(hashed(docs))
    directions = _directions(ids, _weights(ids))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        own = [(r["item_id"], w) for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"])) if (w := words_of(r["text"]))]
        if own:
            yield docs.sparkSession.sparkContext.broadcast(Index(own, directions))


LEAKS = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item (item_id, text) that it holds, verbatim or as a paraphrase."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], LEAKS)
    for shared in _indexes(rows, benchmark):
        out = out.unionByName(rows.mapInArrow(_find(shared), LEAKS))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the documents that hold a benchmark item; no shuffle."""
    out = docs
    for shared in _indexes(docs.select("doc_id", "text"), benchmark):
        out = out.mapInArrow(_clean(shared), docs.schema)
    return out
