"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows round the hits.

Learning uses at most about SAMPLE labelled training rows, chosen by a hash of doc_id (the documented
bound of the classifier); their ids are broadcast, so no text is shuffled. Words whose document frequency among toxic rows is too
large for chance (binomial tail, Bonferroni over the candidate words) form the lexicon with their log odds.

The lexicon's trie and the automata of all words within 1 or 2 edits of its terms (by length) are run
together as one lazily determinised automaton (tokens: what stands between Unicode white space): a state is the set of (trie node, edits used), a
token walks it character by character and most tokens leave it after a few. Tokens near a term that are
common in clean training rows are innocent neighbours and don't count; the other neighbours of a term count with
a weight of their own, the log odds of what the training rows have of them, drawn to those of the term.

A hit in a context window of quotation (between quotation marks, or a few words after a reporting
verb) counts as quoted. A logistic model over the weight of plain and of quoted hits, their density and the largest
gives the score; its prior expects hits to be toxic, quoted ones less so, and the sample corrects it.

Defined cases: null text is the empty text and gets the score of a text without hits; a null doc_id
hashes as the empty text and has no label; a document with several labels is toxic if one says so; with no
labels or no toxic ones the lexicon is empty and every score is the same; a token near several terms counts for the nearest,
the first by code point of equals; very long texts are scored whole; repeated rows each count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import durable, first_rows, held_out

SAMPLE = 20_000
TERMS, CANDIDATES = 512, 5_000
ALPHA = 0.05
THRESHOLD = 0.3
LEAST, MOST = 0.7, 6.0  # weight of a hit
DRAWN, NEAR_RATE = 2.0, 0.95  # neighbours count as if so many had been seen, at this toxic share
QUOTE_CHARS, QUOTE_WORDS = 80, 4
MEMO = 500_000

#: Reporting verbs that introduce a quotation, by language.
REPORTING = frozenset("said says wrote writes called calls quoted quote claimed shouted replied dit disait écrit appelé cité sagte sagt schrieb nannte zitierte dijo dice escribió llamó citó".split())
#: Pairs of quotation marks.
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}

_TOKEN = re.compile(r"\S+")
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…"


def edits_for(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class FuzzyLexicon:
    """The trie of the terms with Levenshtein automata of 0 to 2 edits, determinised as tokens need it."""

    def __init__(self, terms: dict[str, float], innocent: frozenset[str] = frozenset(), near: dict[str, float] | None = None) -> None:
        self.terms, self.innocent, self.near = terms, innocent, terms if near is None else near
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.budget = [0]
        for t in sorted(terms):
            node, most = 0, edits_for(t)
            self.budget[0] = max(self.budget[0], most)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], most)
            self.term[node] = t
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state after closing it under skipped term characters; -1 for the empty one."""
        waiting = list(nodes)
        while waiting:
            node = waiting.pop()
            for child in self.children[node].values():
                e = nodes[node] + 1
                if e <= self.budget[child] and e < nodes.get(child, 9):
                    nodes[child] = e
                    waiting.append(child)
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state].items():
            steps = [(node, e + 1)]
            steps += [(child, e + (c != d)) for d, child in self.children[node].items()]
            for to, cost in steps:
                if cost <= self.budget[to] and cost < out.get(to, 9):
                    out[to] = cost
        found = self.moves[state][c] = self._state(out)
        return found

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its number of edits, and the distance; the first by order among equals."""
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return None
        best = None
        for node, e in self.sets[state].items():
            t = self.term[node]
            if t and e <= edits_for(t) and (best is None or (e, t) < best):
                best = (e, t)
        if best is None or (best[0] and word in self.innocent):
            return None
        return best[1], best[0]


class Matches(dict):
    """Lower-cased tokens to (weight, edits) or None; fills itself up to a bound."""

    def __init__(self, lexicon: FuzzyLexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> tuple[float, int] | None:
        found = self.lexicon.find(token.strip(_EDGES))
        weight = (self.lexicon.near if found[1] else self.lexicon.terms).get(found[0], 0.0) if found else 0.0
        out = (weight, found[1]) if weight > LEAST else None
        if len(self) < MEMO:
            self[token] = out
        return out


def tokens_of(text: str | None) -> list[str]:
    """The lower-cased text between white space, that of Unicode; ``_TOKEN`` finds the same with their places."""
    return (text or "").lower().split()


def quoted(low: str, start: int, end: int) -> bool:
    """Whether a context window round low[start:end] quotes it."""
    before, after = low[max(0, start - QUOTE_CHARS) : start], low[end : end + QUOTE_CHARS]
    for left, right in QUOTES.items():
        opened = before.rfind(left)
        if opened >= 0 and right in after and (before[opened + 1 :].count(right) == 0 if left != right else before.count(left) % 2 == 1):
            return True
    return any(w.strip(_EDGES) in REPORTING for w in before.split()[-QUOTE_WORDS:])


N_FEATURES = 6
#: Prior means of the model's weights: what is expected of hits before labels are seen.
PRIOR = np.array([-3.0, 0.5, 1.0, 0.5, 0.1, 0.3])


def features(text: str | None, matches: Matches) -> np.ndarray:
    tokens = tokens_of(text)
    out = np.zeros(N_FEATURES)
    out[0] = 1.0
    hits = [m for m in map(matches.__getitem__, tokens) if m]
    if not hits:
        return out
    plain = aside = top = 0.0
    number = 0
    low = text.lower()
    for place in _TOKEN.finditer(low):
        m = matches[place.group()]
        if not m:
            continue
        if quoted(low, place.start(), place.end()):
            aside += m[0]
            continue
        number += 1
        top = max(top, m[0])
        plain += m[0]
    out[1:] = number > 0, math.log1p(plain), math.log1p(100 * number / len(tokens)), math.log1p(aside), top
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X >= k) of a binomial, from its largest terms."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, min(n, k + 200) + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def learn_lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int, words: int) -> dict[str, float]:
    """Terms and weights from (word, toxic rows, clean rows) with it; ``words``: how many words were candidates."""
    if not toxic or not clean:
        return {}
    p = toxic / (toxic + clean)
    found = []
    for word, t, c in counts:
        if word and t >= 3 and t > p * (t + c) and (tail := binomial_tail(t, t + c, p)) < math.log(ALPHA / max(1, words)):
            weight = math.log((t + 0.25) / (toxic + 0.5)) - math.log((c + 0.25) / (clean + 0.5))
            found.append((tail, word, min(MOST, weight)))
    return {w: x for _, w, x in sorted(found)[:TERMS] if x > LEAST}


def near_weights(lexicon: FuzzyLexicon, near: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The weight of each term's misspellings, from the sample's words (word, toxic rows, clean rows) near to terms."""
    seen: dict[str, list[float]] = {w: [DRAWN * NEAR_RATE, DRAWN * (1 - NEAR_RATE)] for w in lexicon.terms}
    for word, t, c in near:
        if (found := lexicon.find(word)) and found[1]:
            seen[found[0]][0] += t
            seen[found[0]][1] += c
    base = math.log((toxic + 0.5) / (clean + 0.5))
    return {w: min(lexicon.terms[w], MOST, math.log(a / b) - base) for w, (a, b) in seen.items()}


def fit(rows: np.ndarray, labels: np.ndarray, pull: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Logistic weights by Newton steps, pulled to PRIOR."""
    w = PRIOR.copy()
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-rows @ w))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + pull * np.eye(len(w)), rows.T @ (p - labels) + pull * (w - PRIOR))
        w = w - np.clip(step, -2, 2)
    return w


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, t, c): rows of the sample that are toxic and clean and have the word; '' has the rows themselves."""
    counts: list[Counter] = [Counter(), Counter()]
    for batch in batches:
        for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts[label].update({t.strip(_EDGES) for t in tokens_of(text)} | {""})
    words = sorted(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], ["word", "t", "c"])


def _features(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Matches(FuzzyLexicon(*shared.value))
        for batch in batches:
            rows = np.array([features(t, matches) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(rows), pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _near_words(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = FuzzyLexicon(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([bool((f := lexicon.find(w)) and f[1]) for w in batch.column("word").to_pylist()], pa.bool_()))

    return run


class Model:
    """The arguments of a FuzzyLexicon and the logistic weights."""

    def __init__(self, lexicon: tuple[dict[str, float], frozenset[str], dict[str, float]], weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both already without held-out rows."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = known.count()
    share = 1_000_000 if n <= SAMPLE else SAMPLE * 1_000_000 // n
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) < share)
    # About SAMPLE rows of 12 bytes at most: a bounded broadcast.
    sample = durable(docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text"))
    counts = durable(sample.mapInArrow(_word_counts, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    totals = counts.where("word = ''").first()
    toxic, clean = (totals["t"], totals["c"]) if totals else (0, 0)
    likely = counts.where(F.col("t") >= 3)
    lead = F.col("t") / (F.col("t") + F.col("c") + 1.0)
    best = first_rows(likely.where(F.col("word") != ""), CANDIDATES, (lead * F.log1p("t")).desc(), "word")
    terms = learn_lexicon([(r["word"], r["t"], r["c"]) for r in best], toxic, clean, likely.count())
    # Neighbours of the terms that the sample's rows use: bounded by the sample's words, and few.
    near = counts.where("word != ''").mapInArrow(_near_words(spark.sparkContext.broadcast(terms)), counts.schema)
    near = sorted((r["word"], r["t"], r["c"]) for r in near.collect())
    innocent = frozenset(w for w, t, c in near if c >= 2 and t * clean <= c * toxic * 2)
    lexicon = (terms, innocent, near_weights(FuzzyLexicon(terms, innocent), near, toxic, clean))
    rows = sample.mapInArrow(_features(spark.sparkContext.broadcast(lexicon)), "toxic int, x array<double>").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES)
    return Model(lexicon, fit(x, np.array([r["toxic"] for r in rows], float)))


def _score(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matches = Matches(FuzzyLexicon(*model.lexicon))
        for batch in batches:
            rows = np.array([features(t, matches) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            score = 1 / (1 + np.exp(-rows @ model.weights))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, buckets: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows are never read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(buckets).alias("held_out"), "text")
    model = learn(rows.where(~F.col("held_out")).select("doc_id", "text"), labels.where(~held_out(buckets)).select("doc_id", "toxic"))
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double, predicted int")
