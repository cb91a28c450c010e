"""Hidden Markov language model: Baum-Welch over partitions, exact likelihood by scaled forward recursion.

States emit word classes and a class emits its words: P(w | s) = P(class | s) * P(w | class). The TOP most
frequent training words and the end token are classes of their own; other words, unseen ones too, share
TAIL classes by a hash of their last three bytes. So transitions and emissions have a fixed size (the
broadcast is bounded) while every word's count enters the score exactly.

Training: the classes of all training documents are written once; each of ROUNDS rounds of Baum-Welch reads them all.
Each task adds up its expected counts as fixed-point integers and one aggregation by class sums them, so the sum
does not depend on the order of tasks. A document is trained in segments of SEGMENT tokens: the first starts from the
model's start distribution and alone counts for it, the others from the stationary distribution of the transitions.
Scoring runs the recursion over whole documents, with memory for one state vector each.

Counts: the KNOWN most frequent words of WIDEST bytes at most are looked up where the texts are, from a broadcast
of bounded size. Of the others a document sends a row for each different word to the corpus's counts and gets one
row with their sum back; texts are never shuffled.

Defined cases: null text is the empty text: one end token; very long texts are scored whole; a null doc_id hashes as
the empty text; ties in frequency fall to the smaller word; repeated rows each count; with no training rows N
is 0 and V is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import durable, first_rows, held_out

STATES = 8
TOP = 4096
TAIL = 2048
ROUNDS = 9
SEGMENT = 512
FIXED = float(1 << 20)
PRIOR = 50.0
KNOWN, WIDEST = 1 << 17, 256
CHUNK = 1 << 20
END = b"\n"  # no word has white space


def tail_class(word: bytes) -> int:
    return TOP + 1 + zlib.crc32(word[-3:]) % TAIL


class Classes(dict):
    """Word bytes to class; fills itself with tail classes up to a bound."""

    def __missing__(self, word: bytes) -> int:
        found = tail_class(word)
        if len(self) < 2_000_000:
            self[word] = found
        return found


class Model:
    """Start, transition and emission probabilities of the classes; ``top`` maps frequent words to classes."""

    def __init__(self, top: list[bytes], class_counts: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.top = top
        self.prior = (class_counts + 0.5) / (class_counts + 0.5).sum()
        noise = rng.gamma(2.0, 0.5, size=(len(self.prior), STATES))
        self.emit = self.prior[:, None] * noise
        self.emit /= self.emit.sum(0)
        self.move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(self.move, 0.9)
        self.start = np.full(STATES, 1.0 / STATES)

    def classes(self) -> Classes:
        return Classes({w: i for i, w in enumerate(self.top)} | {END: TOP})

    def update(self, counts: np.ndarray) -> None:
        """M-step: the rows of ``counts`` are the classes, then the transitions, then the start."""
        k = len(self.prior)
        emit = counts[:k] + PRIOR * self.prior[:, None]
        self.emit = emit / emit.sum(0)
        move = counts[k : k + STATES] + 1.0 + np.eye(STATES) * 4.0
        self.move = move / move.sum(1, keepdims=True)
        start = counts[k + STATES] + 1.0
        self.start = start / start.sum()


def time_major(sequences: list[np.ndarray]) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Sequences in order of falling length, token by token: symbols, how many sequences last at each step, the order."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    flat = np.concatenate([sequences[i] for i in order])
    starts = np.cumsum(lengths) - lengths
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    # Token t of the i-th sequence goes behind those of all earlier steps and of the i longer sequences.
    before = np.cumsum(active) - active
    out = np.empty_like(flat)
    out[before[np.arange(len(flat)) - np.repeat(starts, lengths)] + np.repeat(np.arange(len(lengths)), lengths)] = flat
    return out, active.tolist(), order


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of each sequence, by the scaled recursion."""
    symbols, active, order = time_major(sequences)
    symbols = symbols.astype(np.intp)
    total = np.zeros(len(sequences))
    emit, pull = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    pushed, at = model.start[:, None], 0
    for n in active:
        alpha = np.take(emit, symbols[at : at + n], axis=1) * pushed[:, :n]
        scale = alpha.sum(0)
        total[:n] += np.log10(scale)
        alpha /= scale
        pushed = pull @ alpha
        at += n
    out = np.empty(len(sequences))
    out[order] = total
    return out


def stationary(move: np.ndarray) -> np.ndarray:
    """The distribution of states that ``move`` leaves as it is."""
    values, vectors = np.linalg.eig(move.T)
    found = np.abs(np.real(vectors[:, np.argmax(np.real(values))]))
    return found / found.sum()


def expected_counts(model: Model, sequences: list[np.ndarray], first: np.ndarray | None = None) -> np.ndarray:
    """E-step: expected emissions of each class, then transitions, then starts, by state.

    ``first`` tells which sequences begin a document; all do by default. Arrays are states x tokens.
    """
    symbols, active, order = time_major(sequences)
    k, n0 = len(model.prior), active[0]
    symbols = symbols.astype(np.intp)
    begins = np.ones(n0, bool) if first is None else first[order]
    move = model.move.astype(np.float32)
    seen = np.take(model.emit.T.astype(np.float32), symbols, axis=1)
    alphas, scales = np.empty_like(seen), np.empty(len(symbols), np.float32)
    pushed = np.where(begins, model.start[:, None], stationary(model.move)[:, None]).astype(np.float32)
    ends = np.cumsum(active).tolist()
    for n, b in zip(active, ends, strict=True):
        alpha = alphas[:, b - n : b]
        np.multiply(seen[:, b - n : b], pushed[:, :n], out=alpha)
        scale = alpha.sum(0)
        alpha /= scale
        scales[b - n : b] = scale
        pushed = move.T @ alpha
    moved = np.zeros((STATES, STATES))
    beta = np.ones((STATES, n0), np.float32)  # those that have not begun from their end yet stay 1
    for t in range(len(active) - 1, -1, -1):
        n, b = active[t], ends[t]
        pull = seen[:, b - n : b] * beta[:, :n]
        alphas[:, b - n : b] *= beta[:, :n]  # now the posteriors
        if t:
            pull /= scales[b - n : b]
            before = ends[t - 1] - active[t - 1]
            moved += alphas[:, before : before + n] @ pull.T
            beta[:, :n] = move @ pull
    counts = np.zeros((k + STATES + 1, STATES))
    for s in range(STATES):
        counts[:k, s] = np.bincount(symbols, weights=alphas[s], minlength=k)
    counts[k : k + STATES] = moved * model.move
    counts[k + STATES] = alphas[:, :n0][:, begins].sum(1, dtype=np.float64)
    return counts


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c): tokens with their number, summed as far as a bounded table goes."""
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    for batch in batches:
        for text in _texts(batch):
            counts.update(tokens_of(text))
            if len(counts) > 600_000:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def _encode(shared) -> callable:
    """mapInArrow function: the classes of a text's tokens, as int16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value.classes()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                found = [np.array([classes[w] for w in tokens_of(t)], np.int16).tobytes() for t in _texts(batch.slice(i, 1024))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["tokens"])

    return run


def _e_step(model) -> callable:
    """mapInArrow function: expected counts of a partition, fixed-point, one row a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        total, waiting, first, held = np.zeros((len(own.prior) + STATES + 1, STATES)), [], [], 0
        for batch in batches:
            for tokens in batch.column("tokens"):
                symbols = np.frombuffer(tokens.as_buffer(), np.int16)
                for i in range(0, len(symbols), SEGMENT):
                    waiting.append(symbols[i : i + SEGMENT])
                    first.append(i == 0)
                    held += len(waiting[-1])
                    if held >= CHUNK // 2:
                        total += expected_counts(own, waiting, np.array(first))
                        waiting, first, held = [], [], 0
        if waiting:
            total += expected_counts(own, waiting, np.array(first))
        used = np.flatnonzero(total.any(1))
        fixed = np.rint(total[used] * FIXED).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(fixed[:, s]) for s in range(STATES)]], ["i", *[f"s{s}" for s in range(STATES)]])

    return run


def _round(model: Model, docs: DataFrame) -> np.ndarray:
    """One Baum-Welch E-step over ``docs`` (tokens); what reaches the driver is classes x states."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [f"s{s}" for s in range(STATES)]
    rows = docs.select("tokens").mapInArrow(_e_step(shared), "i int, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((len(model.prior) + STATES + 1, STATES))
    for r in rows.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[r["i"]] = [r[n] for n in names]
    shared.unpersist()
    return out / FIXED


def train(docs: DataFrame, model: Model) -> Model:
    """EM over all of ``docs`` (text) in every round; without rows the model stays as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    encoded = durable(docs.select("text").mapInArrow(_encode(shared), "tokens binary"))
    for _ in range(ROUNDS):
        counts = _round(model, encoded)
        if not counts.any():
            break
        model.update(counts)
    return model


class Lexicon:
    """The known words' numbers, classes and log10(c + 1); and log10(n + v + 1) of each class of several words."""

    def __init__(self, model: Model, words: list[bytes], counts: np.ndarray, sizes: np.ndarray) -> None:
        classes = model.classes()
        self.model, self.number = model, {w: i for i, w in enumerate(words)}
        self.cls = np.array([classes[w] for w in words], np.int16)
        self.log = np.log10(counts + 1.0)
        self.room = np.where(np.arange(len(sizes)) > TOP, np.log10(sizes.sum(1) + 1), 0.0)


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, log double, word string, tf long"


def _score(shared) -> callable:
    """(doc_id, held_out, text) to a row for each document, and one for each of its words that the lexicon lacks.

    ``known_log`` is the sum of log10(c + 1) over the tokens in the lexicon; ``log`` what is known of the score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        uid, tails = TaskContext.get().partitionId() << 33, Classes()

        def rows(texts: list[list[bytes]], ids: pa.Array, held: pa.Array, uid: int) -> Iterator[pa.RecordBatch]:
            sums, sequences, rest = [], [], ([], [], [])
            for j, words in enumerate(texts):
                at = np.fromiter((lex.number.get(w, -1) for w in words), np.int32, len(words))
                cls, log, rare = lex.cls[at], lex.log[at], np.flatnonzero(at < 0)
                own = Counter(words[i] for i in rare)
                cls[rare] = [tails[words[i]] for i in rare]
                log[rare] = 0.0
                sums.append((len(words), len(words) - len(rare), log.sum(), log[cls > TOP].sum() - lex.room[cls].sum()))
                sequences.append(cls)
                rest[0].extend([uid + j] * len(own))
                rest[1].extend(own)
                rest[2].extend(own.values())
            total = forward(lex.model, sequences) + np.array([x[3] for x in sums])
            uids = pa.array(np.arange(uid, uid + len(texts)))
            columns = [uids, ids, held, *[pa.array([x[i] for x in sums], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], pa.array(total)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(texts), pa.string()), pa.nulls(len(texts), pa.int64())], NAMES)
            n = len(rest[0])
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(rest[0], pa.int64()), *none, pa.array(rest[1], pa.binary()).cast(pa.string()), pa.array(rest[2], pa.int64())], NAMES)

        for batch in batches:
            waiting, start, size = [], 0, 0
            for i, text in enumerate(_texts(batch)):
                waiting.append(tokens_of(text))
                size += len(waiting[-1])
                if size >= CHUNK or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(waiting))
                    yield from rows(waiting, part.column("doc_id"), part.column("held_out"), uid)
                    uid += len(waiting)
                    waiting, start, size = [], i + 1, 0

    return run


NAMES = [c.split()[0] for c in SCORED.split(", ")]


def most_frequent(counts: DataFrame) -> list:
    """The KNOWN most frequent words of ``counts`` (word, c), ties by word. Only words from the power of two on that leaves enough are sorted."""
    power = F.floor(F.log2("c")).cast("int")
    sizes = {r["p"]: r["n"] for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()}
    least = next((p for p in sorted(sizes, reverse=True) if sum(n for q, n in sizes.items() if q >= p) >= KNOWN), 0)
    return first_rows(counts.where(power >= least), KNOWN, F.col("c").desc(), "word")


def score_documents(docs: DataFrame, buckets: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; trained on the rows not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(buckets).alias("held_out"), "text")
    training = rows.where(~F.col("held_out")).select("text")
    counts = durable(training.mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))

    # KNOWN words of WIDEST bytes at most, then TOP + TAIL + 1 classes at most reach the driver.
    end = END.decode()
    often = most_frequent(counts.where((F.octet_length("word") <= WIDEST) & (F.col("word") != end)))
    top = [r["word"].encode() for r in often[:TOP]]
    frequent = spark.createDataFrame([(w.decode(), i) for i, w in enumerate(top)] + [(end, TOP)], "word string, i int")
    suffix = F.expr("crc32(substring(cast(word as binary), -3, 3))")
    cls = counts.join(F.broadcast(frequent), "word", "left").select(F.coalesce("i", (suffix % TAIL + TOP + 1).cast("int")).alias("i"), "c")
    sizes = np.zeros((TOP + 1 + TAIL, 2))
    for r in cls.groupBy("i").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        sizes[r["i"]] = r["n"], r["v"]
    total, distinct = int(sizes[:, 0].sum()), int(sizes[:, 1].sum())

    model = train(training, Model(top, sizes[:, 0]))
    words = [r["word"].encode() for r in often] + ([END] if total else [])
    lexicon = Lexicon(model, words or [END], np.array([r["c"] for r in often] + [sizes[TOP, 0]] if words else [0.0]), sizes)
    scored = durable(rows.mapInArrow(_score(spark.sparkContext.broadcast(lexicon)), SCORED))

    rare = scored.where("word is not null").select("uid", "word", "tf").join(counts, "word")
    rare = rare.groupBy("uid").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more_log"))
    whole = scored.where("word is null").join(rare, "uid", "left")
    more, more_log = F.coalesce("more", F.lit(0)), F.coalesce("more_log", F.lit(0.0))
    n_known = F.col("n_known") + more if total else F.lit(0).cast("long")
    base = F.col("known_log") + more_log - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    columns = ["doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log") + more_log).alias("score")]
    return whole.select(*columns)
