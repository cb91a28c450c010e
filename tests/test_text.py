import random

import pytest
from pyspark.sql import functions as F

from cuewise.functions import text as T
from cuewise.functions.jsonfix import fix_response, response_items
from cuewise.functions.similarity import similarity, similarity_bound, text_similarity


def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in cells.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a,b,want", [("これは", "これわ", 0.667), ("そうですね", "そーですね", 0.8), ("10個", "十個", 0.4), ("わかりました", "分かりました", 0.833), ("", "", 0.0), ("。。。", "。。。", 0.0)])
def test_similarity(spark, a, b, want):
    assert text_similarity(a, b) == pytest.approx(want, abs=1e-3)
    assert value(spark, similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want, abs=1e-3)
    assert value(spark, similarity_bound(F.col("a"), F.col("b")), a=a, b=b) >= text_similarity(a, b) - 1e-9


def test_cleaners(spark):
    t = F.col("t")
    assert value(spark, T.clean_for_matching(t), t="（こんにちは）") == "こんにちは"
    assert value(spark, T.clean_for_matching(t), t="こんにちは　世界") == "こんにちは世界"
    assert value(spark, T.normalize_text(t), t=" a、b…　c!? ") == "abc"
    assert value(spark, T.strip(t), t="　 a b \n") == "a b"
    assert value(spark, T.contains_japanese(t), t="abc") is False
    assert value(spark, T.contains_japanese(t), t="abcあ") is True


@pytest.mark.parametrize("seconds,want", [(0.0, "00:00:00.000"), (3661.5, "01:01:01.500"), (-1.0, "23:59:59.000"), (90000.25, "01:00:00.250"), (1.9999999, "00:00:02.000"), (0.9996, "00:00:00.999")])
def test_format_timestamp(spark, seconds, want):
    assert value(spark, T.format_timestamp(F.col("s")), s=seconds) == want


@pytest.mark.parametrize("text,want", [("やめて" * 6, "やめて、やめて、やめて..."), ("あ" * 25, "あ、あ、あ...、あ、あ、あ...、あ、あ、あ......"), ("普通の文", "普通の文"), ("$1" * 5, "$1、$1、$1...")])
def test_condense(spark, text, want):
    assert value(spark, T.condense_word_repetitions(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("", True), ("、。", True), ("ああああああああ", True), ("ああああああ", False), ("a b a b", False), ("x " * 9 + "yz", True), ("これは普通です", False), ("く" + "う" * 60, True)])
def test_stammer(spark, text, want):
    assert value(spark, T.is_only_repetitive_stammer(F.col("t")), t=text) is want


def test_expansion_values():
    assert T.expansion_values(10.0, 5) == [0.5, 1.1, 2.3, 4.8, 10.0]
    assert T.expansion_values(10.0, 4) == [0.5, 1.4, 3.7, 10.0]
    assert T.expansion_values(3.0, 1) == [3.0]


def naive_edges(text, most, primary, secondary, near, far, slack):
    """Character by character, as the rule is told."""
    edges, length, i = [0], 0, 0
    while i < len(text):
        length += 1
        if length >= most:
            hits = [i + j for width, breaks in ((near, primary), (far, secondary)) for j in range(width) if i + j < len(text) and text[i + j] in breaks]
            if hits:
                i = hits[0]
            if hits or length >= most + slack:
                edges.append(i + 1)
                length = 0
        i += 1
    return edges if edges[-1] == len(text) else [*edges, len(text)]


def test_piece_edges_against_naive():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("aaaaab.,c") for _ in range(rng.randrange(60)))
        args = (rng.randrange(1, 15), frozenset("."), frozenset(","), 5, rng.choice([3, 10]), rng.choice([0, 5]))
        assert T.piece_edges(text, *args) == naive_edges(text, *args)


def test_split_long_lines(spark):
    df = spark.createDataFrame([("あ" * 45,), ("短い",), ("これは長いテキストです。さらに続きます。おわり",)], "text string")
    got = [r["text"] for r in T.split_long_lines(df).collect()]
    assert got[0] == "\n".join(["あ" * 20, "あ" * 20, "あ" * 5]) and got[1] == "短い"
    assert got[2].replace("\n", "") == "これは長いテキストです。さらに続きます。おわり"


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"polished": ["a", "b"]}', ["a", "b"]),
        ('```json\n{"polished": ["a"]}\n```', ["a"]),
        ('【JSON】\n["a", "b"]', ["a", "b"]),
        ("1. a\nmore\n2) b", ["a more", "b"]),
        ('["a"]', ["a"]),
        ('{"polished": ["a", "b"', ["a", "b"]),
        ('{"polished": ["a"]} and so on', ["a"]),
        ('text [1, 2] more ["x"]', ["1", "2"]),
        ("'a' then 'b'", ["a", "b"]),
        ("こんにちは", ["こんにちは"]),
        ("", None),
        ("plain words", None),
        ('{"polished": ["a, [b]", "c\\"d"], "n": 1', ["a, [b]", 'c"d']),
        ("{'polished': ['a' 'b',]}", ["a", "b"]),
        ('1. "a" [x]\n2. b', ['"a" [x]', "b"]),
        ('so: {"other": {"polished": ["a"]}} {"polished": ["b"]}', ["b"]),
        ('{"polished": ["\\u3042\\ud83d\\ude00"]}', ["あ😀"]),
        ("don't know", None),
        ("[]", []),
        ("Here you go:\n1. see [1]\n2. second", ["see [1]", "second"]),
        ('Result:\n1. a\n2. ["b"]\n3. c', ["a", '["b"]', "c"]),
        ('["a", "b"]\n1. c', ["a", "b"]),
        ('```json\n["1. a", "b"]\n```', ["1. a", "b"]),
        ('[JSON]\n["a"]\n2) no', ["a"]),
        ('{"polished": ["a\\tb", "c', ["a\tb"]),
        ('{"polished": ["q\\"uo", 1, null, {"x": ["y"]}]}', ['q"uo', "1", "null", '{"x": ["y"]}']),
    ],
)
def test_response(raw, want):
    assert response_items(raw)[0] == want


def test_response_key():
    assert fix_response('{"segments": ["a", "b"]}', "segments") == {"segments": ["a", "b"]}


@pytest.mark.parametrize("block", [1, 2, 7, 512])
def test_offsets_in_blocks(spark, block):
    from itertools import accumulate

    from cuewise.functions.text import offsets

    rows = [(i, [(i * k) % 5 for k in range(n)]) for i, n in enumerate([0, 1, 2, 6, 7, 8, 60])]
    got = spark.createDataFrame(rows, "i int, n array<int>").select("i", "n", offsets(F.col("n"), block).alias("at")).collect()
    assert {r["i"]: r["at"] for r in got} == {i: [0, *accumulate(n)][: len(n)] for i, n in rows}
