"""Large tables fill Arrow batches: what a task makes of one is bounded, and searches cost few passes over arrays."""

import random

import numpy as np
import pyarrow as pa

from cuewise.functions.similarity import text_similarity
from cuewise.operators import align, hearing
from cuewise.plans.adapters import piece_times


def test_batches_are_read_in_slices():
    batch = pa.RecordBatch.from_pydict({"media_id": ["m"] * 1000, "heard": [[{"start": 0.0, "end": 1.0, "word": "w"}]] * 1000})
    parts = list(hearing.slices(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= hearing.SLICE and sum(p.num_rows for p in parts) == 1000
    assert [w for p in parts for w in hearing.heard_lists(p)] == [[(0.0, 1.0, "w")]] * 1000


def test_times_of_pieces():
    rng = random.Random(5)
    texts = ["", " ", "a", "a b", "ä  b ", "😀 x", *["".join(rng.choice("ab あ") for _ in range(rng.randint(0, 40))) for _ in range(300)]]
    starts, ends = np.array([rng.random() * 9 for _ in texts]), np.array([rng.random() * 9 + 9 for _ in texts])
    want = []
    for t, a, b in zip(texts, starts.tolist(), ends.tolist(), strict=True):
        places = [0, *[i + 1 for i, c in enumerate(t) if c == " " and i + 1 < len(t)], *([len(t)] if t else [])]
        want.append([a + (b - a) * (k / max(1, len(t))) for k in places])
    assert piece_times(pa.array(texts), starts, ends).to_pylist() == want


def test_runs_are_bounded_in_one_go(monkeypatch):
    calls, common = [], align.RunIndex._common
    monkeypatch.setattr(align.RunIndex, "_common", staticmethod(lambda *a: calls.append(1) or common(*a)))
    rng = random.Random(7)
    for _ in range(60):
        target = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 12)))
        pieces = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 12))]
        longest = rng.randint(1, len(pieces))
        calls.clear()
        index = align.RunIndex(target, pieces, longest)
        assert len(calls) == 2
        for first in range(len(pieces)):
            for last in range(first, min(first + longest, len(pieces))):
                assert index.bound(first, last) >= text_similarity(target, "".join(pieces[first : last + 1])) - 1e-12


def border_by_trying_all(prev, curr, words):
    best, border = 0.0, None
    texts = [w["word"] for w in words]
    for i in range(len(words)):
        score = (text_similarity(prev.text, "".join(texts[:i])) + text_similarity(curr.text, "".join(texts[i:]))) / 2
        if score > best:
            best, border = score, prev.start + (words[i - 1]["end"] if i else words[0]["start"])
    return border if best >= align.BOUNDARY else None


def test_borders_are_compared_likeliest_first(monkeypatch):
    calls = []
    monkeypatch.setattr(align, "text_similarity", lambda a, b: calls.append(1) or text_similarity(a, b))
    rng, tried = random.Random(9), 0
    for _ in range(400):
        words = [{"word": "".join(rng.choice("abcdefg 、") for _ in range(rng.randint(0, 5))), "start": float(i), "end": i + 0.5} for i in range(rng.randint(0, 25))]
        cut = rng.randint(0, len(words))
        said = ["".join(w["word"] for w in part) for part in (words[:cut], words[cut:])]
        prev, curr = (align.Segment(a, b, "".join(c for c in t if rng.random() < 0.9)) for a, b, t in zip((1.0, 9.0), (9.5, 20.0), said, strict=True))

        class Ear:
            def transcribe(self, *_, own=words):
                return {"segments": [{"words": own}]}

        assert align.find_boundary(prev, curr, "m", Ear()) == border_by_trying_all(prev, curr, words)
        tried += len(words)
    assert len(calls) < tried  # two a border that is compared: fewer than half of them are
