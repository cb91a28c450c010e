"""Personal data: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Strict patterns give the base spans (e-mail, IP, card, phone), which always stay. Looser patterns give more
candidates: written-out e-mails, numbers with unusual separators or without a plus. On every candidate of every
document, regex, checksum, gazetteer, context, boundary and shape labelers vote yes, no or nothing.

Candidates are counted by their votes and features over all documents. From the votes' patterns (at most 3**6 a kind),
expectation-maximisation estimates each labeler's reliability without labels. A logistic span classifier is trained on
the posteriors, by Newton steps whose sums are aggregations over the counted candidates: it sees the votes and, beyond them,
the span's length and separators, the characters next to it and the words before and after it (hashed). A second pass
adds the loose candidates that it is sure of and that overlap no base span of their kind.

Defined cases: null text is the empty text; a null doc_id is returned as such; spans count code points, ends excluded; of
matches that tie for a place the leftmost counts; with no candidates the classifier adds nothing; repeated rows each get their row; an empty table gives an empty result; other
columns are ignored. No pattern backtracks over long runs, so very long texts take linear time.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import durable

KINDS = ("email", "ip", "card", "phone")
LABELERS = 6
SURE = 0.8
WINDOW = 40
ROUNDS = 50
NEWTON = 12  # steps of the classifier's training, at most
HASHED = 16  # buckets of the words before and after a span
FIXED = 1 << 20  # sums are whole numbers of this part, so that their order does not matter
HELD = 1 << 16  # counts that a task holds before it passes them on

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}", re.ASCII | re.IGNORECASE),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:(?:[./_]|  )[0-9]{4}){3})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.(-])(?:(?:00|\+)[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
}

#: Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es uk it nl eu ch at us ca".split())
CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420".split())
ISSUERS = tuple("4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 6011 65 35 62".split())
CONTEXT = {
    "email": frozenset("email e-mail mail contact write courriel correo adresse kontakt".split()),
    "ip": frozenset("ip host server address addr client login adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit payment carte tarjeta karte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax téléphone teléfono telefon".split()),
}
AGAINST = frozenset("version section chapter isbn issn order invoice page token sha id ref release build".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def strict_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it is valid) of the strict patterns, leftmost and without overlap for each kind."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end, True
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), small_parts(m.group())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            if len(digits) >= 13:
                yield "card", m.start(), m.end(), len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15


def loose_matches(text: str, valid: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the loose patterns outside the valid strict matches; cards bar phones too.

    Inside a strict match that is not valid, a part may be: two numbers in a row look like one too long.
    """
    for kind, pattern in _LOOSE.items():
        if kind == "email":
            # What every match holds, whichever form its dots have.
            low = text.lower()
            if not any(s in low for s in ("(at)", "[at]", "{at}", " at ")):
                continue
        elif kind == "ip" and not any(s in text for s in ("[.]", "(.)", "[dot]")):
            continue
        taken = [*valid.get(kind, ()), *(valid.get("card", ()) if kind == "phone" else ())]
        for m in pattern.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                yield kind, m.start(), m.end()


def votes(text: str, kind: str, start: int, end: int, valid: bool | None) -> tuple[int, ...]:
    """What the labelers say: 1 yes, 0 nothing, -1 no. ``valid`` is None for loose candidates."""
    span = text[start:end]
    digits = _digits(span)
    before, after = text[max(0, start - WINDOW) : start], text[end : end + 1]
    words = {w.strip(".,:;()[]\"'").lower() for w in before.split()}
    context = 1 if words & CONTEXT[kind] else -1 if words & AGAINST else 0
    boundary = -1 if (before[-1:].isalnum() or after.isalnum()) else 1
    regex = 0 if valid is None else 1 if valid else -1
    if kind == "email":
        last = re.split(r"\.| dot |[(\[{]dot[)\]}]", span.lower())[-1].strip(" )]}")
        check, gazetteer, shape = (1 if last.isalpha() else -1), (1 if last in TOP_DOMAINS else -1), (1 if span[0].isalnum() else -1)
    elif kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        check = 1 if all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1
        gazetteer = -1 if parts[0] in ("0", "127", "255") else 0
        shape = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
    elif kind == "card":
        check = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
        shape = 1 if len(digits) in (15, 16) and len(set(digits)) > 3 else -1
    else:
        check = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = 1 if span[0] == "+" and digits.startswith(CALLING_CODES) or digits.startswith("00") else 0
        shape = 1 if re.search(r"[ ().-]", span) and len(set(digits)) > 2 else -1
    return regex, check, gazetteer, context, boundary, shape


def _strict(text: str) -> tuple[list[tuple[str, int, int, bool]], dict[str, list[tuple[int, int]]]]:
    """All strict matches, and the valid ones by kind."""
    found = list(strict_matches(text))
    by: dict[str, list[tuple[int, int]]] = {}
    for kind, a, b, valid in found:
        if valid:
            by.setdefault(kind, []).append((a, b))
    return found, by


SIZES = {"votes": len(KINDS) + 2 * LABELERS, "length": 4, "separators": 3, "before": 4, "after": 4, "word before": HASHED, "word after": HASHED}
WIDTH = sum(SIZES.values())


def _side(c: str) -> int:
    """What kind of character stands next to a span."""
    return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3


def _bucket(word: str) -> int:
    return zlib.crc32(word.strip(".,:;()[]\"'").lower().encode("utf-8", "replace")) % HASHED


def span_features(text: str, kind: str, start: int, end: int, pattern: tuple[int, ...]) -> tuple[int, ...]:
    """The features of a span that are on, out of WIDTH."""
    on = [KINDS.index(kind), *(len(KINDS) + j + (LABELERS if v < 0 else 0) for j, v in enumerate(pattern) if v)]
    separators = {c for c in text[start:end] if not c.isalnum()}
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    own = [min(3, (end - start) // 10), min(2, len(separators)), _side(before[-1:]), _side(after[:1]), _bucket((before.split() or [""])[-1]), _bucket((after.split() or [""])[0])]
    at = SIZES["votes"]
    for value, size in zip(own, list(SIZES.values())[1:], strict=True):
        on.append(at + value)
        at += size
    return tuple(on)


def _count_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, votes, x, n): candidates by votes and features."""

    def out(counts: Counter) -> pa.RecordBatch:
        keys = sorted(counts)
        columns = [pa.array([k[0] for k in keys], pa.string()), *[pa.array([list(k[i]) for k in keys], pa.list_(pa.int32())) for i in (1, 2)], pa.array([counts[k] for k in keys], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "votes", "x", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            found, by = _strict(text)
            for kind, a, b, valid in [*found, *((*m, None) for m in loose_matches(text, by))]:
                own = votes(text, kind, a, b, valid)
                counts[kind, own, span_features(text, kind, a, b, own)] += 1
        if len(counts) > HELD:
            yield out(counts)
            counts = Counter()
    yield out(counts)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """EM of the labelers' reliabilities (Dawid-Skene): the posterior of each vote pattern being personal data."""
    if not len(patterns):
        return np.zeros(0)
    yes = np.clip(0.5 + patterns.sum(1) / (2.0 * LABELERS), 0.05, 0.95)
    for _ in range(rounds):
        logs = []
        for share in (yes * counts, (1 - yes) * counts):
            table = np.array([[share[patterns[:, j] == v].sum() + 1.0 for v in (-1, 0, 1)] for j in range(LABELERS)])
            table /= table.sum(1, keepdims=True)
            logs.append(math.log(share.sum() + 1.0) + sum(np.log(table[j, patterns[:, j] + 1]) for j in range(LABELERS)))
        yes = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    # The classes have no names of their own: personal data is where more labelers say yes.
    agree = patterns.sum(1)
    if (agree * yes * counts).sum() / max(1e-9, (yes * counts).sum()) < (agree * (1 - yes) * counts).sum() / max(1e-9, ((1 - yes) * counts).sum()):
        yes = 1 - yes
    return yes


def prior_weights() -> np.ndarray:
    """What is expected of the votes before training, and nothing of the other features."""
    return np.array([-1.0] * len(KINDS) + [1.0] * LABELERS + [-1.0] * LABELERS + [0.0] * (WIDTH - SIZES["votes"]))


def _newton_sums(shared) -> callable:
    """Counted candidates to the sums (i, s) of a Newton step: gradient and Hessian, flat, in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posterior = shared.value
        total = np.zeros((WIDTH + 1, WIDTH))
        for batch in batches:
            kinds, patterns, on = (batch.column(c).to_pylist() for c in ("kind", "votes", "x"))
            x = np.zeros((batch.num_rows, WIDTH))
            for i, own in enumerate(on):
                x[i, own] = 1.0
            y = np.array([posterior[k, tuple(v)] for k, v in zip(kinds, patterns, strict=True)])
            n = np.log1p(batch.column("n").to_numpy())
            p = 1 / (1 + np.exp(-x @ weights))
            total[:WIDTH] += (x * (n * p * (1 - p))[:, None]).T @ x
            total[WIDTH] += x.T @ (n * (p - y))
        flat = np.rint(total.ravel() * FIXED).astype(np.int64)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(flat[used])], ["i", "s"])

    return run


def train_classifier(counted: DataFrame | None, pull: float = 1.0) -> np.ndarray:
    """Logistic weights of the span classifier from the counted candidates, each weighing as the log of its count.

    The driver gets at most len(KINDS) * 3**LABELERS rows for the EM and (WIDTH + 1) * WIDTH sums a step.
    """
    weights = prior_weights()
    rows = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect() if counted is not None else []
    if not rows:
        return weights
    posterior: dict[tuple, float] = {}
    for kind in KINDS:
        own = sorted((tuple(r["votes"]), r["n"]) for r in rows if r["kind"] == kind)
        found = estimate(np.array([v for v, _ in own], int).reshape(-1, LABELERS), np.array([n for _, n in own], float))
        posterior |= {(kind, v): float(y) for (v, _), y in zip(own, found, strict=True)}
    prior, spark = weights.copy(), counted.sparkSession
    for _ in range(NEWTON):
        shared = spark.sparkContext.broadcast((weights, posterior))
        total = np.zeros((WIDTH + 1) * WIDTH)
        for r in counted.mapInArrow(_newton_sums(shared), "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect():
            total[r["i"]] = r["s"] / FIXED
        total = total.reshape(WIDTH + 1, WIDTH)
        step = np.clip(np.linalg.solve(total[:WIDTH] + pull * np.eye(WIDTH), total[WIDTH] + pull * (weights - prior)), -2, 2)
        weights = weights - step
        if np.abs(step).max() < 1e-3:
            break
    return weights


def find_spans(text: str | None, weights: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans, each by kind as in KINDS, then start."""
    if not text:
        return [], []
    found, by = _strict(text)
    base = [(kind, a, b) for kind, a, b, valid in found if valid]
    more = []
    for kind, a, b in loose_matches(text, by):
        v = votes(text, kind, a, b, None)
        # A checksum that fails is proof against a number, whatever the other labelers say.
        if v[1] > 0 and 1 / (1 + math.exp(-float(weights[list(span_features(text, kind, a, b, v))].sum()))) >= SURE:
            more.append((kind, a, b))
    return base, more


def _rows(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                base, more = find_spans(text, shared.value)
                numbers = Counter(k for k, _, _ in base)
                for i, kind in enumerate(KINDS):
                    columns[i].append(numbers[kind])
                order = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))
                columns[4].append(hashlib.sha256(order(base).encode()).hexdigest())
                columns[5].append(order(base + more))
            arrays = [*[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.select("text").mapInArrow(_count_candidates, "kind string, votes array<int>, x array<int>, n long")
    weights = train_classifier(durable(counted.groupBy("kind", "votes", "x").agg(F.sum("n").alias("n"))))
    result = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(_rows(docs.sparkSession.sparkContext.broadcast(weights)), result)
