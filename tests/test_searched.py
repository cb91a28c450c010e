"""The looks that spare most texts the costly text functions: none that these change may be left out, and few others looked at."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from cuewise.functions import text as T

BLANK = "".join(map(chr, T.SPACES))


def stammer(t):
    clean = re.sub(f"[、。？！…{BLANK}]", "", t)
    if not clean or (len(clean) >= 8 and len(set(clean)) <= 2):
        return True
    top = max(Counter(clean).values())
    words = [w for w in re.split(f"[、。？！…{BLANK}]+", t) if w]
    word = max(Counter(words).values())
    return (top >= 50 and top >= 0.8 * len(clean)) or (word >= 5 and word >= 0.8 * len(words))


def repeats(t):
    return any(re.search(rf"(.{{{n}}})\1{{4}}", t) for n in range(1, 16))


def few(t):
    clean = re.sub(f"[、。？！{BLANK}]", "", t)
    return len(clean) >= 3 and len(set(clean)) <= 2


@pytest.mark.parametrize("searched", [1, 50, 1 << 20])
def test_no_text_is_missed(searched, monkeypatch):
    monkeypatch.setattr(T, "SEARCHED", searched)
    rng = random.Random(searched)
    looks = (stammer, T.stammering), (repeats, lambda a: T.repeating(a, 15, 5)), (few, T.few_characters)
    for _ in range(150):
        pieces = ["".join(rng.choice(rng.choice(["ab ", "abcdefgh   、…", "あい、 ", "a😀 b", "x"])) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 30))]
        texts = [None, *[rng.choice(["", "zq ", "あ "]) + p * rng.choice([1, 5, 20]) + rng.choice(["", "…", "zz y"]) for p in pieces]]
        column = pa.concat_arrays([pa.array(["other", None]), pa.array(texts, pa.string())]).slice(2)
        for exact, look in looks:
            assert all(seen for t, seen in zip(texts, look(column), strict=True) if t is None or exact(t))


def test_plain_texts_are_spared(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").toPandas()["text"]
    lines = pa.array([x for t in docs for x in t.split("\n") if len(x) > 40])
    assert T.repeating(lines, 15, 5).mean() < 0.2 and T.stammering(lines).mean() < 0.2 and T.few_characters(lines).mean() < 0.2
