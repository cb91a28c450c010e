"""Timing realignment: segments are looked for near their time with a recogniser, and overlaps are repaired.

Searching needs a segment and what is heard around it, so it is a map over rows: with a table of words these come from a
range join in buckets of time, with a plugged-in recogniser from the sound. What a neighbour's new place changes is
sequential: a fold over a media item's rows in their order, as a stream that holds one row and the words around it. No
media item is gathered in either step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.functions.similarity import cleaned, similarity_limit, text_similarity
from cuewise.functions.text import expansion_values, strip
from cuewise.operators.hearing import HEARD, heard_lists, slices, with_heard
from cuewise.operators.models import STRICT, Recogniser, RecogniserFactory
from cuewise.schema import COLUMNS, SEGMENT, WORDS
from cuewise.sources.tables import dealt

#: Bounds of the searches.
SHORTEST, RATE = 0.1, 5.0
EXCELLENT, GOOD, FAIR, TOO_LONG = 0.9, 0.85, 0.6, 1.5
SEGMENTS, WORDS_A_RUN = 5, 15
BOUNDARY = 0.5
INDEXED = 32  # runs from which on an index of them pays

@dataclass(frozen=True)
class Segment:
    start: float
    end: float
    text: str
    moved: bool = False


@dataclass(frozen=True)
class Found:
    start: float | None
    end: float | None
    score: float


def _hear(recogniser: Recogniser, media: str, start: float, end: float, words: bool) -> dict[str, Any] | None:
    """What is heard in a slice; None if it is too short or the recogniser fails."""
    if end - start < SHORTEST:
        return None
    try:
        return recogniser.transcribe(media, start, end, words, STRICT)
    except Exception:  # any failure of the plugged-in recogniser means that nothing was heard
        return None


def _words(heard: dict[str, Any]) -> list[dict[str, Any]]:
    return [w for s in heard.get("segments", []) for w in s.get("words") or []]


class RunIndex:
    """Upper bounds of a text's similarity with every run of neighbouring pieces, from n-grams indexed by their places.

    Blocks that two texts share cannot have more of a character than both have. Nor can k blocks hold more bigrams than both
    have, and between two blocks at least one character of either text is in none: so M characters in blocks have
    3 M <= shared bigrams + 1 + both lengths. Counts of a run are differences of running counts.
    """

    def __init__(self, target: str, pieces: list[str], longest: int) -> None:
        target, pieces = cleaned(target), [cleaned(p) for p in pieces]
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        own = np.frombuffer(target.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.longest, n = longest, len(pieces)
        # The runs of each first piece, in a row each; those that would end behind the last piece end there.
        start = np.repeat(self.at[:-1], longest)
        end = self.at[np.minimum(np.arange(n)[:, None] + np.arange(1, longest + 1), n)].ravel()
        total = len(own) + end - start
        common = self._common(points, own, start, end)
        pairs = self._common(self._pairs(points), self._pairs(own), start, np.maximum(end - 1, start))
        most = np.minimum(common, (pairs + 1 + total) // 3)
        self.bounds = np.where((end > start) & (len(own) > 0), 2.0 * most / np.maximum(total, 1), 0.0).tolist()

    @staticmethod
    def _pairs(points: np.ndarray) -> np.ndarray:
        return (points[:-1] << np.uint64(32)) | points[1:]

    @staticmethod
    def _common(grams: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many n-grams ``own`` shares with those from each start to its end."""
        known, times = np.unique(own, return_counts=True)
        if not len(known):
            return np.zeros(len(start), np.int64)
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        marks = np.zeros((len(known), len(grams) + 1), np.int32)
        marks[at, np.arange(1, len(grams) + 1)] = known[at] == grams
        running = np.cumsum(marks, axis=1, dtype=np.int32)
        last = np.minimum(end, len(grams))
        return np.minimum(running[:, last] - running[:, np.minimum(start, last)], times[:, None]).sum(0)

    def bound(self, first: int, last: int) -> float:
        return self.bounds[first * self.longest + last - first]


class Subsequence:
    """The longest common subsequence of a text and one that grows, by bits: shared blocks are never longer together."""

    def __init__(self, target: str) -> None:
        self.length, self.masks = len(target), {}
        for i, c in enumerate(target):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def start(self) -> None:
        self.open, self.read = (1 << self.length) - 1, 0

    def add(self, text: str) -> None:
        full = (1 << self.length) - 1
        for c in text:
            if met := self.open & self.masks.get(c, 0):
                self.open = ((self.open + met) | (self.open - met)) & full
        self.read += len(text)

    def bound(self) -> float:
        """No similarity with what was added is above."""
        return 2.0 * (self.length - self.open.bit_count()) / max(1, self.length + self.read)


def _best_run(target: str, texts: list[str], spans: list[tuple[float, float]], longest: int, limit: float, floor: float = 0.0) -> Found:
    """The best run of neighbouring pieces: the first of equals, cut short once excellent or too long.

    Runs that cannot beat the best one, or reach ``floor``, are not compared.
    """
    best = Found(None, None, 0.0)
    texts = [t.strip() for t in texts]
    index = RunIndex(target, texts, min(longest, len(texts))) if len(texts) * min(longest, len(texts)) >= INDEXED else None
    common, own = Subsequence(cleaned(target)), [cleaned(t) for t in texts]
    for first in range(len(texts)):
        joined, read = "", first
        common.start()
        for last in range(first, min(first + longest, len(texts))):
            joined += texts[last]
            possible = index.bound(first, last) if index else 1.0
            if possible > best.score and possible >= floor:
                while read <= last:
                    common.add(own[read])
                    read += 1
                possible = common.bound()
            if possible > best.score and possible >= floor:
                score = text_similarity(target, joined)
                if score > best.score:
                    best = Found(spans[first][0], spans[last][1], score)
                if score >= EXCELLENT:
                    return best
            if len(joined) > limit * TOO_LONG:
                break
        if best.score >= GOOD:
            break
    return best


def find_in_words(target: str, words: list[dict[str, Any]], offset: float = 0.0, floor: float = 0.0) -> Found:
    """Where ``target`` shows among words; without a place if no run is fair."""
    clean = cleaned(target)
    if not clean or not words:
        return Found(None, None, 0.0)
    best = _best_run(target, [w.get("word", "") for w in words], [(w.get("start", 0.0), w.get("end", 0.0)) for w in words], WORDS_A_RUN, len(clean), floor)
    if best.start is None or best.score < FAIR:
        return Found(None, None, best.score)
    return Found(offset + best.start, offset + best.end, best.score)


def find_in_transcription(target: str, heard: dict[str, Any] | None, floor: float = 0.0) -> Found:
    """Where ``target`` shows among recognised segments, or else among their words.

    With a ``floor`` of FAIR the places are the same, and scores below it may be too low.
    """
    if not heard or not cleaned(target):
        return Found(None, None, 0.0)
    segments = heard.get("segments", [])
    best = _best_run(target, [s.get("text", "") for s in segments], [(s["start"], s["end"]) for s in segments], SEGMENTS, len(target), floor)
    if best.start is not None and best.score >= FAIR:
        return best
    finer = find_in_words(target, _words(heard), floor=floor)
    return finer if finer.score > best.score else Found(None, None, best.score)


def verify_by_time(segment: Segment, media: str, recogniser: Recogniser, config: dict) -> Segment:
    """Keeps a segment that is heard at its time; else shifts its window back and forth, ever farther, for a better place."""
    if len(segment.text.strip()) < 2:
        return segment
    threshold = config.get("similarity", config.get("min_similarity", 0.6))
    length = segment.end - segment.start
    reach = segment.start + max(length, len(segment.text.strip()) / RATE)
    if reach - segment.start < SHORTEST:
        return segment
    heard = _hear(recogniser, media, segment.start, reach, False)
    first = text_similarity(segment.text, heard["text"].strip()) if heard else 0.0
    if first >= threshold:
        return segment
    best, place = first, None
    for step in _steps("time_based", config):
        for start in (max(0.0, segment.start - step), segment.start + step):
            if best >= threshold:
                break
            heard = _hear(recogniser, media, start, start + length, True)
            if heard is None or similarity_limit(segment.text, heard["text"]) <= best:
                continue
            score = text_similarity(segment.text, heard["text"].strip())
            if score > best:
                best, place = score, (start, heard)
    if place is None:
        return segment
    start, heard = place
    words = _words(heard)
    found = (start + words[0].get("start", 0.0), start + words[-1].get("end", length)) if words else (start, start + length)
    return segment if found == (segment.start, segment.end) else replace(segment, start=found[0], end=found[1], moved=True)


def search_by_text(segment: Segment, media: str, recogniser: Recogniser, config: dict) -> Segment:
    """Looks for a segment's text in growing windows and moves it there, whatever its neighbours."""
    if len(segment.text.strip()) < 2:
        return segment
    best, start, end = 0.0, None, None
    for step in _steps("text_search", config):
        if best >= config.get("similarity", 0.85):
            break
        low = max(0.0, segment.start - step)
        found = find_in_transcription(segment.text, _hear(recogniser, media, low, segment.end + step, True), FAIR)
        if found.start is not None and found.score > best:
            best, start, end = found.score, low + found.start, low + found.end
    least = config.get("adjustment_threshold", 0.3)
    if start is None or (abs(start - segment.start) < least and abs(end - segment.end) < least):
        return segment
    return replace(segment, start=start, end=end, moved=True)


def _steps(method: str, config: dict) -> list[float]:
    """How far each try of a search reaches."""
    if method == "text_search":
        return expansion_values(config.get("expansion", 10.0), config.get("expansion_attempts", 4))
    return expansion_values(config.get("expansion", config.get("max_expansion", 3.0)), config.get("expansion_attempts", 5))


def find_boundary(prev: Segment, curr: Segment, media: str, recogniser: Recogniser) -> float | None:
    """The time between two segments' texts in what is heard over both; None if no split fits."""
    heard = _hear(recogniser, media, prev.start, curr.end, True)
    words = _words(heard) if heard else []
    texts = [w.get("word", "") for w in words]
    if not words:
        return None
    bounds = (_limits(prev.text, texts) + _limits(curr.text, texts[::-1])[::-1]) / 2
    best, at = 0.0, len(words)
    # The likeliest borders first, of equally likely ones the first; of equally good ones the first counts.
    for i in np.argsort(-bounds[:-1], kind="stable").tolist():
        if bounds[i] < best or bounds[i] < BOUNDARY:
            break
        score = (text_similarity(prev.text, "".join(texts[:i])) + text_similarity(curr.text, "".join(texts[i:]))) / 2
        if score > best or (score == best and i < at):
            best, at = score, i
    if best < BOUNDARY:
        return None
    border = words[at - 1].get("end") if at else words[0].get("start")
    return None if border is None else prev.start + border


def _limits(target: str, texts: list[str]) -> np.ndarray:
    """``similarity_limit`` of ``target`` with the first 0, 1, ... of ``texts`` joined, from running counts of its characters."""
    target, texts = cleaned(target), [cleaned(t) for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    if not target:
        return np.zeros(len(ends))
    known, times = np.unique(np.frombuffer(target.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    running = np.concatenate([np.zeros((len(known), 1), np.int64), np.cumsum(points == known[:, None], axis=1)], axis=1)
    common = np.minimum(running[:, ends], times[:, None]).sum(0)
    return np.where(ends > 0, 2.0 * common / (len(target) + ends), 0.0)


@dataclass(frozen=True)
class Placed:
    """A segment, where its search has put it (itself, if nowhere), and the words heard there."""

    was: Segment
    now: Segment
    heard: list[tuple[float, float, str]] | None = None


def between_neighbours(rows: Iterator[Placed], min_gap: float) -> Iterator[Placed]:
    """Moved segments cut to the room after the one before, as that has come out, and before the next one's old start.

    A segment without room stays where it was.
    """
    before, waiting = None, next(rows, None)
    while waiting is not None:
        after, now = next(rows, None), waiting.now
        if now.moved:
            start = now.start if before is None else max(now.start, before.end + min_gap)
            end = now.end if after is None else min(now.end, after.was.start - min_gap)
            now = replace(now, start=start, end=end) if end > start else waiting.was
        yield replace(waiting, now=now)
        before, waiting = now, after


def repaired(rows: Iterator[Placed], media: str, ear: Callable[[list | None], Recogniser], min_gap: float) -> Iterator[Segment]:
    """Moves the border of each moved segment and a neighbour that it comes too near, one pair after the other.

    A pair in which both have moved may be looked at twice. ``ear`` makes a recogniser of the words heard around a pair.
    Holds one row, and those words that end after its start.
    """
    last = next(rows, None)
    if last is None:
        return
    prev, words = last.now, last.heard
    for row in rows:
        curr = row.now
        near = last.now.end > curr.start - min_gap
        times = (last.now.moved and near) + (curr.moved and curr.start < last.now.end + min_gap)
        if words is not None:
            words = sorted({*words, *row.heard}) if times else row.heard
        for _ in range(times):
            border = find_boundary(prev, curr, media, ear(words))
            if border is None:
                middle = (prev.end + curr.start) / 2
                prev, curr = replace(prev, end=middle), replace(curr, start=middle + min_gap)
            else:
                prev = replace(prev, end=border)
                if border + min_gap < curr.end:
                    curr = replace(curr, start=border + min_gap)
        yield prev
        if words is not None and times:
            words = [w for w in words if w[1] > curr.start]
        last, prev = row, curr
    yield prev


def repair_overlaps(rows: list[Segment], media: str, recogniser: Recogniser, min_gap: float) -> list[Segment]:
    """``repaired`` for a list and one recogniser."""
    return list(repaired((Placed(r, r) for r in rows), media, lambda _: recogniser, min_gap))


def _segments(batch: pa.RecordBatch) -> list[Segment]:
    columns = [batch.column(c).to_pylist() for c in ("start", "end", "text")]
    return [Segment(a, b, text or "") for a, b, text in zip(*columns, strict=True)]


def _take_words(column: pa.Array, kept: list[list[int]]) -> pa.Array:
    """Of each list in ``column`` the items at the positions in ``kept``."""
    at = column.offsets.to_pylist()
    flat = column.flatten().take(pa.array([a - at[0] + i for a, own in zip(at, kept, strict=False) for i in own], pa.int64()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)), flat)


def _around(words: list[tuple[float, float, str]], margin: float, *segments: Segment) -> list[int]:
    """The positions of the words that come within ``margin`` of a segment."""
    return [i for i, (a, b, _) in enumerate(words) if any(a < s.end + margin and b > s.start - margin for s in segments)]


def _search(method: str, config: dict, recogniser: RecogniserFactory, heard: bool, min_gap: float) -> Callable:
    """Adds to_start and to_end: where a segment is found, null if it stays. Of the words heard those near its place stay."""
    look = search_by_text if method == "text_search" else verify_by_time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ear = None if heard else recogniser(None)
        for batch in slices(batches):
            media, rows = batch.column("media_id").to_pylist(), _segments(batch)
            words = heard_lists(batch) if heard else [None] * len(rows)
            found = [look(r, m, recogniser(w) if heard else ear, config) for r, m, w in zip(rows, media, words, strict=True)]
            own = [batch.column(c) for c in COLUMNS]
            to = [pa.array([getattr(f, c) if f.moved else None for f in found], pa.float64()) for c in ("start", "end")]
            near = []
            if heard:
                # A segment without room goes back to where it was.
                near = [_take_words(batch.column("heard"), [_around(w, min_gap, f, r) for w, f, r in zip(words, found, rows, strict=True)])]
            yield pa.RecordBatch.from_arrays([*own, *to, *near], [*COLUMNS, "to_start", "to_end", *["heard"] * heard])

    return run


def _settle(method: str, recogniser: RecogniserFactory, heard: bool, min_gap: float) -> Callable:
    """Partitions in order of (media_id, seg_idx): each media item's rows between their neighbours, and repaired."""

    def ear(words: list | None) -> Recogniser:
        return recogniser(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if heard else recogniser(None)
        held: list[pa.RecordBatch] = []  # batches whose rows are not all out: two at most, but for tiny ones

        def rows() -> Iterator[tuple[Any, Placed]]:
            for batch in slices(batches):
                held.append(batch)
                words = heard_lists(batch) if heard else [None] * batch.num_rows
                moves = zip(batch.column("to_start").to_pylist(), batch.column("to_end").to_pylist(), strict=True)
                for media, was, (a, b), w in zip(batch.column("media_id").to_pylist(), _segments(batch), moves, words, strict=True):
                    yield media, Placed(was, was if a is None else replace(was, start=a, end=b, moved=True), w)

        def settled() -> Iterator[Segment]:
            for media, group in groupby(rows(), key=lambda r: r[0]):
                placed = (p for _, p in group)
                if method == "text_search":
                    placed = between_neighbours(placed, min_gap)
                yield from repaired(placed, media, ear if heard else lambda _: own, min_gap)

        done: list[Segment] = []
        for segment in settled():
            done.append(segment)
            if held and len(done) == held[0].num_rows:
                yield _out(held.pop(0), done)
                done = []

    return run


def _out(batch: pa.RecordBatch, rows: list[Segment]) -> pa.RecordBatch:
    """The batch's rows with their new times; moved ones lose their words."""
    words = batch.column("words")
    at = words.offsets.to_pylist()
    kept = [[] if r.moved else list(range(b - a)) for r, a, b in zip(rows, at, at[1:], strict=False)]
    columns = {c: batch.column(c) for c in COLUMNS} | {"start": pa.array([r.start for r in rows], pa.float64()), "end": pa.array([r.end for r in rows], pa.float64()), "words": _take_words(words, kept)}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _window(method: str, config: dict, min_gap: float) -> tuple[Column, Column]:
    """From when to when a search may hear."""
    farthest = max(_steps(method, config)) + min_gap
    late = F.col("end") if method == "text_search" else F.greatest("end", F.col("start") + F.length(strip(F.col("text"))) / RATE)
    return F.least("start", "end") - farthest, F.greatest("start", late) + farthest


def realign_timing(df: DataFrame, config: dict, recogniser: RecogniserFactory, truth: DataFrame | None = None) -> DataFrame:
    """Segments with realigned times by the method that the config names (an unknown one means time_based); a moved one loses
    its words.

    ``truth``, if given, holds rows (media_id, word, start, end); ``recogniser`` then gets those around a segment. Else it
    gets None, once a task, and hears the sound itself.
    """
    method = "text_search" if config.get("method") == "text_search" else "time_based"
    own, min_gap = config.get(method, {}), config.get("min_gap", 0.1)
    rows = df.select(*COLUMNS).withColumn("words", F.coalesce("words", F.array().cast(WORDS)))
    if truth is not None:
        rows = with_heard(rows, truth, *_window(method, own, min_gap))
    heard = truth is not None
    schema = f"{SEGMENT}, to_start double, to_end double" + (f", heard {HEARD}" if heard else "")
    found = rows.mapInArrow(_search(method, own, recogniser, heard, min_gap), schema)
    return dealt(found, "media_id").sortWithinPartitions("media_id", "seg_idx").mapInArrow(_settle(method, recogniser, heard, min_gap), SEGMENT)
