"""Ratcliff-Obershelp similarity of texts, exact, and upper bounds that spare most of its calls.

The longest common block of two texts (of equals the first in ``a``, then the first in ``b``) splits them in two, and so on.
It is found by looking for ever longer pieces of ``a`` in ``b``; where the product of both lengths is above AUTOMATON, in one pass of
``a`` through the suffix automaton of ``b``, so that long texts cost no more than their length for each level of blocks.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cuewise.functions.text import clean_for_similarity

_CLEAN = re.compile(r"[、。！？\s]")
AUTOMATON = 1 << 23


def cleaned(text: str | None) -> str:
    return _CLEAN.sub("", text or "")


class SuffixAutomaton:
    """All substrings of a text; each state knows where its substrings first end."""

    def __init__(self, text: str) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [0]
        last = 0
        for end, c in enumerate(text, 1):
            new, p = self._state({}, end, end), last
            while p >= 0 and c not in self.step[p]:
                self.step[p][c] = new
                p = self.link[p]
            self.link[new] = 0 if p < 0 else self._target(p, c)
            last = new

    def _state(self, step: dict[str, int], length: int, first_end: int) -> int:
        self.step.append(step)
        self.link.append(0)
        self.length.append(length)
        self.first_end.append(first_end)
        return len(self.step) - 1

    def _target(self, p: int, c: str) -> int:
        """The state of p's longest substring and c: the one there, or a copy of it where that one is longer."""
        q = self.step[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.step[q]), self.length[p] + 1, self.first_end[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def longest_block(self, a: str) -> tuple[int, int, int]:
        best, state, size = (0, 0, 0), 0, 0
        for end, c in enumerate(a, 1):
            while state and c not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.step[state]:
                state, size = self.step[state][c], size + 1
            if size > best[2]:
                best = end - size, self.first_end[state] - size, size
        return best


def _by_search(a: str, b: str) -> tuple[int, int, int]:
    at = size = 0
    for i in range(len(a)):
        if i + size >= len(a):
            break
        while i + size < len(a) and a[i : i + size + 1] in b:
            at, size = i, size + 1
    return at, b.find(a[at : at + size]), size


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common block; a length of 0 if there is none."""
    return SuffixAutomaton(b).longest_block(a) if len(a) * len(b) > AUTOMATON else _by_search(a, b)


def matched(a: str, b: str) -> int:
    """The characters in the blocks that two texts share, each block left and right of a longer one."""
    if a == b:
        return len(a)
    total, waiting = 0, [(a, b)]
    while waiting:
        x, y = waiting.pop()
        i, j, n = longest_block(x, y)
        if n:
            total += n
            if i and j:
                waiting.append((x[:i], y[:j]))
            if i + n < len(x) and j + n < len(y):
                waiting.append((x[i + n :], y[j + n :]))
    return total


def text_similarity(a: str | None, b: str | None) -> float:
    """2 * matches / total length of the cleaned texts; 0 if one is empty."""
    a, b = cleaned(a), cleaned(b)
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a and b else 0.0


def similarity_limit(a: str | None, b: str | None) -> float:
    """No similarity is above this: what both have of each character."""
    a, b = cleaned(a), cleaned(b)
    return 2.0 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) if a and b else 0.0


@F.arrow_udf(DoubleType())
def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(map(text_similarity, a.to_pylist(), b.to_pylist()), pa.float64())


# Filters on the result stay above it, so that each pair is compared once.
_similarity = _similarity.asNondeterministic()


def similarity(a: Column, b: Column) -> Column:
    return _similarity(a, b)


def similarity_bound(a: Column, b: Column) -> Column:
    """No similarity is above this: 2 * the shorter length / both lengths of the cleaned texts."""
    la, lb = F.length(clean_for_similarity(a)), F.length(clean_for_similarity(b))
    return F.when((la > 0) & (lb > 0), 2.0 * F.least(la, lb) / (la + lb)).otherwise(0.0)


def multiset_bound(a: Column, b: Column) -> Column:
    """A bound below ``similarity_bound``: 2 * what both cleaned texts have of each character / both lengths."""
    ca, cb = clean_for_similarity(a), clean_for_similarity(b)
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c))
    letters = F.array_distinct(F.regexp_extract_all(ca, F.lit("(?s)."), F.lit(0)))
    common = F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(times(ca, c), times(cb, c)))
    la, lb = F.length(ca), F.length(cb)
    return F.when((la > 0) & (lb > 0), 2.0 * common / (la + lb)).otherwise(0.0)


def similarity_above(a: Column, b: Column, threshold: float) -> Column:
    """The similarity where its bounds reach ``threshold``, else null: filter rows by a bound before calling this."""
    possible = F.when(similarity_bound(a, b) >= threshold, multiset_bound(a, b) >= threshold).otherwise(False)
    return F.when(possible, similarity(F.when(possible, a), F.when(possible, b)))
