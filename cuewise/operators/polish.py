"""Rewriting texts in batches with a model of text, and splitting long segments with one."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.jsonfix import response_items
from cuewise.functions.similarity import text_similarity
from cuewise.operators.cues import batches
from cuewise.operators.filters import HEARD_WORDS
from cuewise.operators.hearing import slices
from cuewise.operators.models import TextModel, TextModelFactory
from cuewise.schema import COLUMNS, SEGMENT
from cuewise.sources.details import DETAILS
from cuewise.sources.tables import dealt

POLISH = "Correct only clear recognition errors and punctuation in these subtitles; add, drop and reorder nothing.\n{lines}\n" 'Answer with JSON only: {{"polished": ["...", "..."]}}'
SPLIT = "Split this subtitle at natural pauses into pieces of about {most} characters; change nothing.\n1. {text}\n" 'Answer with JSON only: {{"segments": ["...", "..."]}}'

#: What a split must keep of the text, and how pieces are matched to words.
SHORTEST, LONGEST, ALIKE = 0.8, 1.3, 0.85
ACCEPT, COVER = 0.70, 0.8
LEAST_SECONDS = 0.5
#: How far behind a piece's length its words are looked for, and from how much before it an end counts.
REACH, SPARE, BEFORE = 2, 10, 5


class Unreadable(ValueError):
    """An answer that holds no list; keeps what was asked and what came back."""

    def __init__(self, error: str, prompt: str, raw: str) -> None:
        super().__init__(error)
        self.prompt, self.raw = prompt, raw


def _items(model: TextModel, prompt: str, key: str, llm: dict) -> list[str]:
    raw = None
    try:
        raw = model.generate(prompt, llm.get("max_tokens", 1024), llm.get("temperature", 0.0))
        items, error = response_items(raw, key)
    except Exception as failure:  # whatever the plugged-in model raised
        raise Unreadable(f"{type(failure).__name__}: {failure}", prompt, raw) from failure
    if items is None:
        raise Unreadable(f"ValueError: {error}", prompt, raw)
    return items


def _ask(model: TextModel, texts: list[str], llm: dict) -> list[str]:
    return _items(model, POLISH.format(lines="\n".join(f"{i}. {t}" for i, t in enumerate(texts, 1))), "polished", llm)


def polish_texts(model: TextModel, texts: list[str], llm: dict, compat: bool = False) -> tuple[list[str | None], list[Unreadable]]:
    """New texts by position, and the failures: first that of the batch, then those of single texts.

    A failed batch is asked for one by one; what fails again keeps its text. Positions that the answer lacks keep
    their text too (``compat``: None, as the original drops them); what it has too many is ignored.
    """
    try:
        found: list[str | None] = list(_ask(model, texts, llm)[: len(texts)])
        return found + (texts if not compat else [None] * len(texts))[len(found) :], []
    except Unreadable as failure:
        failures = [failure]
    out: list[str | None] = []
    for text in texts:
        try:
            out.append((_ask(model, [text], llm) or [text])[0])
        except Unreadable as failure:
            failures.append(failure)
            out.append(text)
    return out, failures


def polish_segments(df: DataFrame, model: TextModelFactory, size: int = 10, llm: dict | None = None, compat: bool = False) -> DataFrame:
    """Segments with polished texts, ``error``: why a batch had to be asked for one by one, or null, and ``details``: on a batch's
    first row each failed question with its answer (see ``cuewise.sources.details``).

    Batches are dealt out to the tasks whole, and stream through them in their order: one model a task.
    """

    def polished(own: TextModel | str, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(words=[list(w) for w in rows["words"]])
        if isinstance(own, str):
            new, failures = rows["text"].tolist(), [Unreadable(own, None, None)]
        else:
            new, failures = polish_texts(own, rows["text"].tolist(), llm or {}, compat)
        details = [{"stage": "text_polishing", "item": int(rows["batch_id"].iloc[0]), "prompt": f.prompt, "raw": f.raw, "error": str(f)} for f in failures]
        kept = rows.assign(text=new, error=str(failures[0]) if failures else None)[[t is not None for t in new]].drop(columns=["batch_id", "pos"])
        return kept.assign(details=pd.Series([details, *[[]] * (len(kept) - 1)][: len(kept)], index=kept.index, dtype="object"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            own: TextModel | str = model()
        except Exception as error:  # the texts stay as they are
            own = f"{type(error).__name__}: {error}"
        rest = None
        for frame in frames:
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            fresh = (rows["media_id"] != rows["media_id"].shift()) | (rows["batch_id"] != rows["batch_id"].shift())
            groups = [g for _, g in rows.groupby(fresh.cumsum(), sort=False)]
            rest = groups.pop() if groups else None
            yield from (polished(own, g) for g in groups)
        if rest is not None and len(rest):
            yield polished(own, rest)

    order = ["media_id", "batch_id", "pos"]
    dealt_out = dealt(batches(df.select(*COLUMNS), size), "media_id", "batch_id").sortWithinPartitions(*order)
    return dealt_out.mapInPandas(run, f"{SEGMENT}, error string, details {DETAILS}")


def _clean(text: str) -> str:
    import re

    return re.sub(r"[、。？！\s…「」『』【】（）()\[\]]+", "", text)


def valid_split(text: str, pieces: list[str]) -> bool:
    """Whether the pieces are the text, but for little."""
    joined = "".join(pieces)
    whole, got = len(_clean(text)), len(_clean(joined))
    return bool(joined.strip()) and SHORTEST * whole <= got <= LONGEST * whole and text_similarity(text, joined) >= ALIKE


def _reach(rest: str, piece: str) -> int:
    """How many characters of ``rest`` the piece takes up; 0 if it isn't there."""
    at = rest.find(piece)
    if at == 0 or 0 < at < len(piece) // 2:
        return at + len(piece)
    best, end = 0.0, 0
    matched = 0
    for n, c in enumerate(rest[: REACH * len(piece) + SPARE], 1):
        matched += matched < len(piece) and c == piece[matched]
        if n >= max(1, len(piece) - BEFORE):
            score = COVER * matched / len(piece) + (1 - COVER) * matched / n
            if score > best:
                best, end = score, n
    return end if best >= ACCEPT else 0


def pieces_to_words(pieces: list[str], words: list[dict], start: float, end: float) -> list[tuple[float, float, str, list[dict]]] | None:
    """Times and words of each piece by matching cleaned texts; None if more than half of them get no words.

    A piece that isn't found gets its share of the words that are left; the last one takes the rest.
    """
    clean = [_clean(w["word"]) for w in words]
    done = [0, *accumulate(map(len, clean))]
    rest, at, word, out = "".join(clean), 0, 0, []
    shown = [(p, _clean(p)) for p in pieces if _clean(p)]
    for i, (piece, key) in enumerate(shown):
        first, took = word, _reach(rest[at:], key)
        if took:
            at += took
            while word < len(words) and done[word] < at:
                word += 1
        else:
            word += min(len(words) - word, max(1, (len(words) - word) // (len(shown) - i)))
            at = max(at, done[word])
        if i == len(shown) - 1:
            word = len(words)
        own = words[first:word]
        out.append((own[0]["start"] if own else start, own[-1]["end"] if own else end, piece, own))
    return None if 2 * sum(not o[3] for o in out) > len(out) else out


def close_gaps(rows: list[tuple[float, float, str, list]], rate: float) -> list[tuple[float, float, str, list]]:
    """Pieces start where the one before ends if they came later; one that is too short borrows from the next."""
    rows = list(rows)
    for i in range(1, len(rows)):
        start, end, text, words = rows[i]
        start = min(start, rows[i - 1][1])
        lacking = max(LEAST_SECONDS, len(text) / rate) - (end - start)
        if end - start < LEAST_SECONDS and i + 1 < len(rows):
            a, b, *more = rows[i + 1]
            if (loan := min(lacking, b - a - LEAST_SECONDS)) > 0:
                end += loan
                rows[i + 1] = (end, b, *more)
        rows[i] = (start, end, text, words)
    return rows


def split_row(model: TextModel, start: float, end: float, text: str, words: list[dict], most: int, rate: float, llm: dict, failures: list[Unreadable] | None = None) -> list[tuple[float, float, str, list]]:
    """The pieces into which a model splits a segment; the segment itself if the answer is no good, of which ``failures`` is told."""
    failures = [] if failures is None else failures
    prompt = SPLIT.format(most=most, text=text)
    whole = [(start, end, text, words)]
    seconds = end - start
    if len(text) <= most or seconds <= 0 or len(text) / seconds > rate:
        return whole
    try:
        pieces = _items(model, prompt, "segments", llm)
    except Unreadable as failure:  # the segment stays whole
        failures.append(failure)
        return whole
    if len(pieces) < 2 or not valid_split(text, pieces):
        failures.append(Unreadable("ValueError: the pieces are not the text", prompt, "\n".join(pieces)))
        return whole
    if words:
        found = pieces_to_words(pieces, words, start, end)
        return close_gaps(found, rate) if found else whole
    total, at = sum(map(len, pieces)), [0, *accumulate(map(len, pieces))]
    return [(start + seconds * a / total, start + seconds * b / total, p, []) for a, b, p in zip(at, at[1:], pieces, strict=False)]


def split_with_model(df: DataFrame, model: TextModelFactory, most: int = 30, rate: float = 20.0, llm: dict | None = None, details: bool = False) -> DataFrame:
    """Segments of more than ``most`` characters, split by a model; others as they are.

    Pieces get the times of their words, or of their share of the characters where there are none. One pass over what
    comes before: short segments go through the same tasks, and the model is asked for long ones alone. A model that
    can't be made leaves all segments whole. A null text stays as it is. No shuffle but the renumbering's. With ``details`` a column of that name has, on a
    segment's first piece, the question and answer that were no good.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            own = model()
        except Exception:  # whatever the plugged-in model raised: its segments stay whole
            own = None
        for batch in slices(batches):
            out = []
            for media, number, start, end, text, words in zip(*[batch.column(c).to_pylist() for c in COLUMNS], strict=True):
                start, end = (float("nan") if t is None else t for t in (start, end))
                failures: list[Unreadable] = []
                whole = [(start, end, text, words or [])]
                pieces = whole if own is None or text is None else split_row(own, start, end, text, words or [], most, rate, llm or {}, failures)
                told = [{"stage": "segment_splitting", "item": number, "prompt": f.prompt, "raw": f.raw, "error": str(f)} for f in failures]
                out += [(media, number, k, *piece, [] if k else told) for k, piece in enumerate(pieces)]
            columns = [pa.array(column, field.type, from_pandas=True) for column, field in zip(zip(*out, strict=True), fields, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)

    kinds = [("media_id", pa.string()), ("seg_idx", pa.int32()), ("sub_idx", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("text", pa.string()), ("words", HEARD_WORDS)]
    told_kind = pa.list_(pa.struct([("stage", pa.string()), ("item", pa.int32()), *[(c, pa.string()) for c in ("prompt", "raw", "error")]]))
    fields = pa.schema([*kinds, ("details", told_kind)])
    schema = SEGMENT.replace("seg_idx int,", "seg_idx int, sub_idx int,") + f", details {DETAILS}"
    made = df.select(*COLUMNS).mapInArrow(run, schema)
    at = F.row_number().over(Window.partitionBy("media_id").orderBy("seg_idx", "sub_idx")) - 1
    return made.withColumn("seg_idx", at.cast("int")).select(*COLUMNS, *["details"] * details)
