"""Embedding whitening by hierarchical merging of singular value decompositions.

Entries become whole numbers x = floor(1024 * c) + 100000. Each task reduces its rows, batch by batch, to one summary:
their number, exact sums, means, and all singular values and right vectors of the centred rows. Two summaries
merge without loss: the rows S V^T of both, and one row sqrt(n1 n2 / (n1 + n2)) (m1 - m2) that corrects for the means, are
stacked and decomposed again, with every dimension kept. Summaries merge FAN at a time, level by level, in the
cluster; one of them reaches the driver, of dim * (dim + 3) numbers whatever the rows.

The right vectors are the covariance's eigenvectors and s^2 / n its eigenvalues. Rows are centred before anything is
multiplied, so the shift of 100000 costs no digits. ``identity_error`` is measured: the whitened rows are
summarised and merged in the same way, and the covariance that comes out is compared with the identity.

``deviation`` is exact: a long where it fits, else null, and in ``deviation_exact`` up to 38 digits (beyond: null).

Defined cases: vectors that are null, empty or hold null or non-finite entries, or entries whose x is above 2^62, are left out;
so are those of another length than the most frequent one (ties: the shorter), with which they have no covariance; repeated
rows and null vec_ids each count and return; very long vectors are whitened whole; a component without variance (e is 0 but
for rounding, as with one row or equal rows) has whitened 0 and explained 0 and no part in identity_error; with ties
between eigenvalues any orthogonal choice is right, and one is made for all rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import durable
from cuewise.llm.vectors import by_length

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**62
FAN = 16
LENGTHS = 64  # lengths of vectors that a task holds summaries of
FLAT = 1e-24  # of the largest eigenvalue: what rounding leaves of none
DIGITS = 10**38

SUMMARY = "dim int, part int, n long, sums array<decimal(38,0)>, mean array<double>, s array<double>, vt array<double>"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), *[pa.list_(pa.float64())] * 3]
_NAMES = ["dim", "part", "n", "sums", "mean", "s", "vt"]


@dataclass
class Summary:
    """Rows without their order: number, exact sums (empty where not whole), means, singular values, right vectors."""

    n: int
    mean: np.ndarray
    s: np.ndarray
    vt: np.ndarray
    sums: list[int] = field(default_factory=list)

    @staticmethod
    def of(rows: np.ndarray) -> Summary:
        """``rows`` hold whole numbers (int64), or doubles, which get no sums."""
        sums = []
        if rows.dtype == np.int64:
            large = np.abs(rows).max() > (1 << 62) // len(rows)
            sums = [int(x) for x in rows.astype(object).sum(0)] if large else rows.sum(0).tolist()
        mean = np.array([x / len(rows) for x in sums]) if sums else rows.mean(0)
        _, s, vt = np.linalg.svd(rows - mean, full_matrices=False)
        return Summary(len(rows), mean, s, vt, sums)

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        between = math.sqrt(self.n / n * other.n) * (self.mean - other.mean)
        _, s, vt = np.linalg.svd(np.vstack([self.s[:, None] * self.vt, other.s[:, None] * other.vt, between]), full_matrices=False)
        return Summary(n, self.mean + (other.mean - self.mean) * (other.n / n), s, vt, [a + b for a, b in zip(self.sums, other.sums, strict=True)])

    def row(self, dim: int, part: int) -> list:
        return [dim, part, self.n, [Decimal(x) for x in self.sums], self.mean.tolist(), self.s.tolist(), self.vt.ravel().tolist()]

    @staticmethod
    def read(r: dict) -> Summary:
        return Summary(r["n"], np.array(r["mean"]), np.array(r["s"]), np.array(r["vt"]).reshape(-1, len(r["mean"])), [int(x) for x in r["sums"]])


def _rows(summaries: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in summaries], t) for i, t in enumerate(_TYPES)], _NAMES)


def whole(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have their x within the bounds, and those rows' x."""
    with np.errstate(over="ignore"):
        scaled = np.floor(matrix * SCALE)
    fine = (np.abs(scaled) < LARGEST).all(1)
    return fine, scaled[fine].astype(np.int64) + SHIFT


def _whole_blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, matrix in by_length(batch.column("embedding")):
        yield whole(matrix)[1]


def _summarise(blocks: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Callable:
    """One summary a task and length of vector; more only where a task meets more than LENGTHS lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Summary] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            for rows in blocks(batch):
                if len(rows):
                    own = Summary.of(rows)
                    held[rows.shape[1]] = held[rows.shape[1]].merged(own) if rows.shape[1] in held else own
            if len(held) > LENGTHS:
                yield _rows([s.row(dim, part) for dim, s in held.items()])
                held = {}
        yield _rows([s.row(dim, part) for dim, s in held.items()])

    return run


def _merge(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    total = reduce(Summary.merged, map(Summary.read, sorted(rows, key=lambda r: r["part"])))
    return pa.Table.from_batches([_rows([total.row(rows[0]["dim"], rows[0]["part"] // FAN)])])


def summary_of(vectors: DataFrame, blocks: Callable[[pa.RecordBatch], Iterator[np.ndarray]] = _whole_blocks) -> Summary | None:
    """The summary of the most frequent length's vectors, merged level by level."""
    level = durable(vectors.mapInArrow(_summarise(blocks), SUMMARY))
    parts = level.agg(F.max("part")).first()[0]
    if parts is None:
        return None
    while True:
        level = level.groupBy("dim", F.floor(F.col("part") / FAN)).applyInArrow(_merge, SUMMARY)
        parts //= FAN
        if parts == 0:
            break
    best = level.agg(F.max_by(F.struct(*_NAMES), F.struct("n", -F.col("dim"))).alias("best")).first()["best"]
    return Summary.read(best.asDict())


@dataclass
class Fit:
    """The whitening of vectors of one length."""

    n: int
    sums: list[int]
    axes: np.ndarray  # dim x components, over the components' deviations
    explained: np.ndarray
    varied: int  # components with variance

    @staticmethod
    def of(summary: Summary, components: int) -> Fit:
        dim = len(summary.mean)
        s = np.zeros(dim)
        s[: len(summary.s)] = summary.s[:dim]
        k = min(components, dim)
        values = s[:k] ** 2 / summary.n
        varied = int((values > FLAT * max(values[0], 1.0) * dim).sum())
        axes = np.zeros((dim, k))
        axes[:, :varied] = summary.vt[:varied].T / np.sqrt(values[:varied])
        share = np.zeros(k)
        share[:varied] = s[:varied] ** 2 / (s**2).sum()
        return Fit(summary.n, summary.sums, axes, share, varied)

    def apart(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the whole part of the mean, and the rest of the sums: x - S / n = apart - rest / n."""
        base = [s // self.n for s in self.sums]
        return x - np.array(base, np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        apart, rest = self.apart(x)
        return (apart - rest / self.n) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sums of (n x - S)^2."""
        apart, rest = self.apart(x)
        most = float(np.abs(apart).max()) * self.n + self.n
        if most**2 * x.shape[1] < LARGEST:
            return ((self.n * apart - rest) ** 2).sum(1).tolist()
        wide = self.n * apart.astype(object) - rest.astype(object)
        return (wide * wide).sum(1).tolist()


def _whitened_blocks(fit: Fit) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    def blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for x in _whole_blocks(batch):
            if x.shape[1] == len(fit.sums) and len(x):
                yield fit.whitened(x)[:, : fit.varied]

    return blocks


def identity_error(vectors: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    found = summary_of(vectors, _whitened_blocks(fit)) if fit.varied else None
    if found is None:
        return 0.0
    covariance = (found.vt.T * found.s**2) @ found.vt / found.n
    return float(np.abs(covariance - np.eye(fit.varied)).max())


def _apply(fit: Fit, error: float) -> Callable:
    k = fit.axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in by_length(batch.column("embedding")):
                if matrix.shape[1] != len(fit.sums):
                    continue
                fine, x = whole(matrix)
                if not len(x):
                    continue
                each = np.repeat(np.arange(len(x)), k)
                exact = fit.deviations(x)
                ids = batch.column("vec_id").take(pa.array(rows[fine])).take(pa.array(each))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.cast(pa.int64()),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), fit.n)),
                        pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()).take(pa.array(each)),
                        pa.array(fit.whitened(x).ravel()),
                        pa.array(np.tile(fit.explained, len(x))),
                        pa.array(np.full(len(each), error)),
                        pa.array([Decimal(d) if d < DIGITS else None for d in exact], pa.decimal128(38, 0)).take(pa.array(each)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    return run


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: see the module's head. ``vectors`` has vec_id and embedding."""
    vectors = vectors.select("vec_id", "embedding")
    summary = summary_of(vectors)
    if summary is None:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    fit = Fit.of(summary, components)
    return vectors.mapInArrow(_apply(fit, identity_error(vectors, fit)), WHITENED)
