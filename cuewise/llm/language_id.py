"""Language ID with hyperdimensional profiles.

Every letter has a random bipolar vector of DIM components, made from its code point and SEED alone. A letter
n-gram (n = 3) is bound as rot2(first) * rot1(second) * third; a text is the bundle (sum) of its n-grams' vectors and a
language's prototype is the bundle of its training texts. A text takes the language whose prototype has the
largest cosine with it, which is its score (0 at least).

Letters are lower-cased; every run of other characters is one boundary symbol, bound like a letter. A batch of texts
becomes a matrix of n-gram counts times a matrix of n-gram vectors. Training sums n-gram vectors by language in each
task and then by (language, component); only prototypes reach the driver, DIM numbers a language.

Rejection: unrelated vectors have cosines of 0, give or take 1 / sqrt(DIM). ``identified_documents`` drops texts
whose best cosine is below REJECT, three such deviations: their n-grams are none of any learned language's. A text
of fewer than EVIDENCE different n-grams says too little to be rejected for that.

Defined cases: null text, or one without a letter: ``und`` with score 0, and rejected; a text of fewer than three
symbols is padded by its boundaries; very long texts are bundled whole; rows with null lang or null text don't train; a
null doc_id hashes as the empty text; ties go to the first language by code point; with no training rows all is ``und``,
and only what has no letter is rejected; repeated rows each count; an empty table gives an empty result; other
columns are ignored, and pass through ``identified_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import held_out

DIM = 512
SEED = 11
REJECT = 3 / DIM**0.5
EVIDENCE = 32
BATCH_ROWS, BATCH_CHARS = 256, 1 << 20
BOUNDARY = 0
TABLE = 1 << 22  # n-grams that are counted in a table; more are sorted
UNKNOWN = "und"


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A bipolar vector (int8) for each code point: the bits of a mixed counter that starts at the code point."""
    x = (points.astype(np.uint64)[:, None] * np.uint64(DIM // 64) + np.arange(DIM // 64, dtype=np.uint64) + np.uint64(SEED << 32)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
    return (2 * bits.astype(np.int8) - 1).reshape(len(points), DIM)


def _fold_table() -> np.ndarray:
    """Code point to the lower-cased letter's code point, or BOUNDARY."""
    table = np.full(0x110000, BOUNDARY, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            table[point] = ord(c.lower()[0])
    return table


_folded: np.ndarray | None = None


def symbols_of(text: str) -> np.ndarray:
    """The text's letters between single boundaries, as code points; none if it has no letter."""
    global _folded
    if _folded is None:  # one table a worker process
        _folded = _fold_table()
    s = _folded[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not s.any():
        return s[:0]
    s = np.concatenate([[BOUNDARY], s, [BOUNDARY]]).astype(np.uint32)
    return s[np.concatenate([[True], (s[1:] != BOUNDARY) | (s[:-1] != BOUNDARY)])]


def bundles(texts: list[np.ndarray]) -> np.ndarray:
    """The bundled vector (float64) of each list of symbols."""
    out = np.zeros((len(texts), DIM))
    full = [i for i, s in enumerate(texts) if len(s)]
    if not full:
        return out
    flat = np.concatenate([texts[i] for i in full])
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    mark[flat] = 1
    points = np.flatnonzero(mark)
    mark[points] = np.arange(len(points))
    k, at = len(points), mark[flat]
    lengths = np.array([len(texts[i]) for i in full])
    last = np.cumsum(lengths)
    inside = np.ones(len(flat), bool)
    inside[last - 1] = inside[last - 2] = False  # no n-gram starts there
    first = np.flatnonzero(inside)
    codes = (at[first] * k + at[first + 1]) * k + at[first + 2]
    if k**3 <= TABLE:
        seen = np.zeros(k**3, np.int64)
        seen[codes] = 1
        known = np.flatnonzero(seen)
        seen[known] = np.arange(len(known))
        place = seen[codes]
    else:
        known, place = np.unique(codes, return_inverse=True)
    row = np.repeat(np.arange(len(full)), lengths - 2)
    own = letter_vectors(points)
    rotated = np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own
    total = np.zeros((len(full), DIM))
    order = None
    step = max(1, (1 << 24) // max(DIM, len(full)))
    for i in range(0, len(known), step):
        part = known[i : i + step]
        vectors = (rotated[0][part // k**2] * rotated[1][part // k % k] * rotated[2][part % k]).astype(np.float32)
        if step < len(known):
            if order is None:
                order = np.argsort(place, kind="stable")
                ends = np.searchsorted(place[order], np.arange(len(known) + 1))
            here = order[ends[i] : ends[min(i + step, len(known))]]
            r, c = row[here], place[here] - i
        else:
            r, c = row, place
        counts = np.bincount(r * len(part) + c, minlength=len(full) * len(part)).reshape(len(full), len(part))
        total += counts.astype(np.float32) @ vectors
    out[full] = total
    return out


def _groups(texts: list[str | None]) -> Iterator[list[np.ndarray]]:
    waiting, held = [], 0
    for text in texts:
        waiting.append(symbols_of(text or ""))
        held += len(waiting[-1])
        if len(waiting) == BATCH_ROWS or held >= BATCH_CHARS:
            yield waiting
            waiting, held = [], 0
    if waiting:
        yield waiting


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, i, v): component i of the sum of the partition's n-gram vectors for a language."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        at = 0
        for group in _groups(texts):
            vectors = np.rint(bundles(group)).astype(np.int64)
            for lang, vector in zip(langs[at : at + len(group)], vectors, strict=True):
                totals[lang] = totals.get(lang, 0) + vector
            at += len(group)
    for lang in sorted(totals):
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM, pa.string()), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(totals[lang])], ["lang", "i", "v"])


def learn_prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their unit prototypes, from ``docs`` (text, lang)."""
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    rows = known.mapInArrow(_learn, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    names = sorted({r["lang"] for r in rows})
    out = np.zeros((len(names), DIM))
    for r in rows:
        out[names.index(r["lang"]), r["i"]] = r["v"]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    keep = norms[:, 0] > 0
    return [n for n, k in zip(names, keep, strict=True) if k], (out / np.where(norms > 0, norms, 1))[keep]


def variety(symbols: np.ndarray) -> int:
    """The number of different n-grams; 0 for texts without letters."""
    return len(np.unique(np.stack([symbols[:-2], symbols[1:-1], symbols[2:]]), axis=1).T) if len(symbols) else 0


def _best(texts: list[str | None], prototypes: np.ndarray) -> Iterator[tuple[np.ndarray, int, float]]:
    """(symbols, best prototype, its cosine) of each text; no symbols for texts without letters."""
    for group in _groups(texts):
        vectors = bundles(group)
        norms = np.linalg.norm(vectors, axis=1)
        cosines = vectors @ prototypes.T / np.where(norms > 0, norms, 1)[:, None]
        for symbols, row in zip(group, cosines, strict=True):
            best = int(row.argmax()) if len(row) else 0
            yield symbols, best, float(row[best]) if len(row) else 0.0


def _predict(names: list[str], prototypes: np.ndarray) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_best(batch.column("text").to_pylist(), prototypes))
            pred = [names[best] if len(symbols) and names else UNKNOWN for symbols, best, _ in found]
            score = [min(1.0, max(0.0, cosine)) if len(symbols) else 0.0 for symbols, _, cosine in found]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, buckets: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score; prototypes come from the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(buckets).alias("held_out"), "lang", "text")
    names, prototypes = learn_prototypes(rows.where(~F.col("held_out")))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(names, prototypes), "doc_id long, held_out boolean, lang_pred string, score double")


def identified_documents(docs: DataFrame, buckets: int = 4) -> DataFrame:
    """``docs`` with all its columns, without those that are rejected: no letter, or a cosine below REJECT with EVIDENCE.

    No shuffle. Where no language could be learned, those without letters go all the same and the others stay.
    """
    names, prototypes = learn_prototypes(docs.select("doc_id", "lang", "text").where(~held_out(buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _best(batch.column("text").to_pylist(), prototypes)
            yield batch.filter(pa.array([len(x) > 0 and (not names or cosine >= REJECT or variety(x) < EVIDENCE) for x, _, cosine in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
