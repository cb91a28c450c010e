"""Scalar text functions as column expressions; all but ``cut_edges`` stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

#: The characters that the cleaners delete.
NORMALIZE = r"(?U)[\s、。！？…\.,!?]+"
MATCHING = r"(?U)[、。？！\s…「」『』【】（）()\[\]]+"
SIMILARITY = r"(?U)[、。！？\s]"
STAMMER = r"(?U)[、。？！\s…]"
JAPANESE = r"[぀-ゟ゠-ヿ一-鿿]"

#: Break characters of the splitters for text without word timings.
PRIMARY_BREAKS = ("。", "？", "！")
SECONDARY_BREAKS = ("、", "が", "を", "に", "で", "と", "の", "は", "も", "て", "た", "ね", "よ", "わ", "ば", "し")


#: The characters of the class \s with (?U): Unicode white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trims Unicode white space at both ends. Only the ends are looked at, where a pattern would be tried at each character."""
    return F.trim(text, F.lit(WHITE_SPACE))


def normalize_text(text: Column) -> Column:
    return F.regexp_replace(text, NORMALIZE, "")


def clean_for_matching(text: Column) -> Column:
    return F.regexp_replace(text, MATCHING, "")


def clean_for_similarity(text: Column) -> Column:
    return F.regexp_replace(text, SIMILARITY, "")


def clean_stammer(text: Column) -> Column:
    return F.regexp_replace(text, STAMMER, "")


def clean_sound_effects(text: Column) -> Column:
    """Only trims: the feature behind the name is switched off."""
    return strip(text)


def simplify_repetitions(text: Column) -> Column:
    """Only trims: the feature behind the name is switched off."""
    return strip(text)


def contains_japanese(text: Column) -> Column:
    return text.rlike(JAPANESE)


def tokens(text: Column, separators: str) -> Column:
    """Non-empty pieces between runs of ``separators`` (a character class)."""
    return F.filter(F.split(text, f"(?U){separators}+"), lambda w: w != "")


def characters(text: Column) -> Column:
    """The code points of a text, as strings."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def most_frequent(items: Column) -> Column:
    """How often the most frequent element of an array of strings occurs; 0 if there is none.

    One pass over the sorted array: a lambda that mentions ``items`` would make it anew for each element.
    """
    kind = "struct<best:int,run:int,last:string>"

    def step(state: Column, x: Column) -> Column:
        run = F.when(x == state["last"], state["run"] + 1).otherwise(F.lit(1))
        return F.struct(F.greatest(state["best"], run).alias("best"), run.alias("run"), x.alias("last")).cast(kind)

    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("run"), F.lit(None).cast("string").alias("last")).cast(kind)
    return F.aggregate(F.array_sort(items), start, step, lambda s: s["best"])


#: Bytes of texts that are searched at once.
SEARCHED = 1 << 20
#: What ``\s`` matches with (?U).
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The characters that the checks of stammers leave out, without and with the ellipsis.
MARKS = np.array([*SPACES, *map(ord, "、。？！")], np.uint32)
PAUSES = np.array([*MARKS, ord("…")], np.uint32)
FEW = 8  # characters by whose variety a text is judged first


def searched(texts: pa.Array, look: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each text whether ``look``, which gets the code points of some texts and where each begins and ends, says so; true for nulls.

    What is held besides the texts is a few times SEARCHED or the longest text.
    """
    texts = texts.cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)) if len(texts) else np.zeros(0, np.int64)
    # Parts begin where another SEARCHED bytes are full.
    edges = [0, *(np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SEARCHED)) + 1).tolist(), len(texts)]
    return np.concatenate([np.zeros(0, bool), *[_searched(texts.slice(a, b - a).to_pylist(), look) for a, b in zip(edges, edges[1:], strict=False)]])


def _searched(texts: list[bytes | None], look: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    try:
        found = look(*code_points(texts))
    except UnicodeDecodeError:  # such bytes are not for this; the exact functions look at all of these texts
        return np.ones(len(texts), bool)
    return found | np.array([t is None for t in texts], bool)


def code_points(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts one after the other, and where each text begins and ends."""
    whole = b"".join(t or b"" for t in texts)
    edges = np.concatenate([[0], np.cumsum([len(t or b"") for t in texts])]).astype(np.int64)
    points = np.frombuffer(whole, np.uint8)
    if whole.isascii():
        return points, edges
    starts = np.concatenate([[0], np.cumsum((points & 0xC0) != 0x80)])  # each code point has one first byte
    return np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32), starts[edges]


def _rows(edges: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The texts that places lie in."""
    return np.searchsorted(edges[1:], places, side="right")


def repeating(texts: pa.Array, longest: int, least: int) -> np.ndarray:
    """False where no piece of up to ``longest`` code points stands ``least`` times in a row.

    A run of copies of n code points is a run of (least - 1) n places that equal the one n further on, so at least - 1
    multiples of n in a row they do. Those are found first, and then it is counted how far such a run goes on to both sides.
    """

    def look(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        found = np.zeros(len(edges) - 1, bool)
        for n in range(1, longest + 1):
            at = points[::n]
            same = at[1:] == at[:-1]
            for _ in range(least - 2):
                same = same[:-1] & same[1:]
            places = np.flatnonzero(same) * n
            ahead = _equal(points, places[:, None] + np.arange((least - 1) * n), n)
            behind = _equal(points, places[:, None] - np.arange(1, n), n)
            found[_rows(edges, places[ahead + behind >= (least - 1) * n])] = True
        return found

    return searched(texts, look)


def _equal(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """How many of the places in each row, up to the first that does not, equal the code point ``n`` further on."""
    inside = (at >= 0) & (at + n < len(points))
    at = np.where(inside, at, 0)
    return np.logical_and.accumulate(inside & (points[at] == points[np.minimum(at + n, len(points) - 1)]), axis=1).sum(1)


def _kept(points: np.ndarray, edges: np.ndarray, without: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are none of ``without``, those, and where each text begins and ends among them."""
    bits = np.zeros(1 << 16, bool)
    bits[without] = True
    keep = ~bits[points] if points.dtype == np.uint8 else ~(bits[np.minimum(points, 0xFFFF)] & (points < 0x10000))
    return keep, points[keep], np.concatenate([[0], np.cumsum(keep)])[edges]


def _few(kept: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether the first FEW kept code points of each text (all, if fewer) have two distinct ones at most."""
    if not len(kept):
        return np.ones(len(edges) - 1, bool)
    # Places behind a text's end repeat its first code point.
    at = edges[:-1, None] + np.arange(FEW)
    at = np.where(at < edges[1:, None], at, edges[:-1, None])
    own = np.sort(kept[np.minimum(at, len(kept) - 1)], axis=1)
    return (own[:, 1:] != own[:, :-1]).sum(1) <= 1


def few_characters(texts: pa.Array) -> np.ndarray:
    """False where a text without MARKS has more than two distinct code points among its first."""
    return searched(texts, lambda points, edges: _few(*_kept(points, edges, MARKS)[1:]))


def stammering(texts: pa.Array) -> np.ndarray:
    """False where a text is no stammer: its first characters differ, none stands four times in a row and few words twice.

    Of N words, five at least, of which 80 % are equal, 3 and 0.6 N - 1 at least follow one like themselves. Words are told apart by their
    lengths and characters; others that seem equal only cost a closer look.
    """
    weights = np.random.default_rng(3).integers(1, 1 << 62, 1 << 12, np.int64)

    def look(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        keep, kept, ends = _kept(points, edges, PAUSES)
        found = _few(kept, ends)
        same = kept[1:] == kept[:-1]
        found[_rows(ends, np.flatnonzero(same[:-2] & same[1:-1] & same[2:]))] = True
        # A word begins at a kept code point behind another one, or at the beginning of a text.
        begins = keep.copy()
        begins[1:] &= ~keep[:-1]
        first = edges[:-1][edges[:-1] < len(points)]
        begins[first] = keep[first]
        starts = np.cumsum(keep)[np.flatnonzero(begins)] - 1  # among the kept ones
        with np.errstate(over="ignore"):
            sums = np.concatenate([[0], np.cumsum(weights[kept.astype(np.int64) & 0xFFF])])
        stops = np.append(starts[1:], len(kept))
        size, own = stops - starts, sums[stops] - sums[starts]
        twice = (size[1:] == size[:-1]) & (own[1:] == own[:-1])
        pairs, words = (np.bincount(_rows(ends, x), minlength=len(found)) for x in (starts[:-1][twice], starts))
        found[(pairs >= 3) & (5 * (pairs + 1) >= 3 * words)] = True
        return found

    return searched(texts, look)


def _may(look: Callable[[pa.Array], np.ndarray], text: Column) -> Column:
    @F.arrow_udf(BooleanType())
    def may(texts: pa.Array) -> pa.Array:
        return pa.array(look(texts))

    return may(text)


def is_only_repetitive_stammer(text: Column) -> Column:
    """Blank or punctuation only, few or one dominating character, or one dominating word.

    Counting is for the few texts that could pass.
    """
    return F.when(_may(stammering, text), _only_repetitive_stammer(text)).otherwise(F.lit(False))


def _only_repetitive_stammer(text: Column) -> Column:
    """Counting is for the few texts that could pass: one character in 80 % of at least 50 has a run of four
    somewhere, and one word in 80 % leaves few distinct ones.
    """
    clean = clean_stammer(text)
    n = F.length(clean)
    distinct = lambda c: F.size(F.array_distinct(characters(c)))
    few = F.when((n >= 8) & (distinct(F.substring(clean, 1, 8)) <= 2), distinct(clean) <= 2).otherwise(F.lit(False))
    one = (n >= 50) & clean.rlike(r"(?s)(.)\1{3}")
    top = F.when(one, most_frequent(characters(clean))).otherwise(F.lit(0))
    words = tokens(strip(text), "[、。？！\\s…]")
    # Five words have four gaps between them.
    could = text.rlike("(?U)(?:[^、。？！\\s…]+[、。？！\\s…]+){4}[^、。？！\\s…]")
    top_word = F.when(could & (F.size(F.array_distinct(words)) - 1 <= 0.2 * F.size(words)), most_frequent(words)).otherwise(F.lit(0))
    return (n == 0) | few | ((top >= 50) & (top / n >= 0.8)) | ((top_word >= 5) & (F.try_divide(top_word, F.size(words)) >= 0.8))


def is_repetitive_characters(text: Column) -> Column:
    """At most two distinct characters in at least three."""
    clean = F.regexp_replace(strip(text), r"(?U)[、。？！\s]", "")
    return F.when(_may(few_characters, text), (F.length(clean) >= 3) & (F.size(F.array_distinct(characters(clean))) <= 2)).otherwise(F.lit(False))


def condensing_passes(text: Column, longest: int = 15, least: int = 5, shown: int = 3) -> Column:
    """``condense_word_repetitions`` without a look whether there are any: each pass tries every place of the text."""
    shorter = "、".join(["$1"] * shown) + "..."
    return reduce(lambda t, n: F.regexp_replace(t, rf"(?d)(.{{{n}}})(?:\1){{{least - 1},}}", shorter), range(longest, 0, -1), text)


def condense_word_repetitions(text: Column, longest: int = 15, least: int = 5, shown: int = 3) -> Column:
    """Runs of at least ``least`` copies of a piece become ``shown`` copies; longer pieces first, each pass on the last.

    The passes are for the few texts that hold a repetition: in others the first changes nothing, so neither do the rest.
    """

    passes = condensing_passes(text, longest, least, shown)
    return F.when(_may(lambda texts: repeating(texts, longest, least), text), passes).otherwise(text) if least > 1 else passes


def detect_vocalization(text: Column, options: list[str]) -> Column:
    """The first option that the text contains, else the first of all."""
    found = [F.when(text.contains(o), F.lit(o)) for o in options]
    return F.coalesce(*found, F.lit(options[0]))


def build_vocalization(sound: Column, duration: Column, short: float = 2.0, medium: float = 5.0, counts: tuple[int, int, int] = (1, 2, 3)) -> Column:
    n = F.when(duration < short, counts[0]).when(duration < medium, counts[1]).otherwise(counts[2])
    return F.array_join(F.array_repeat(sound, n), "、")


def format_timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm: microseconds rounded, milliseconds cut off, hours wrapping at a day."""
    micros = F.pmod(F.rint(seconds * 1e6).cast("long"), F.lit(86_400_000_000))
    part = lambda unit, modulus: F.pmod(F.expr("cast(0 as long)") + F.floor(micros / unit), F.lit(modulus)).cast("int")
    return F.format_string("%02d:%02d:%02d.%03d", part(3_600_000_000, 24), part(60_000_000, 60), part(1_000_000, 60), part(1_000, 1000))


def format_display_time(seconds: Column) -> Column:
    """Like format_timestamp, without a wrap and with rounded milliseconds: for people to read."""
    hours, minutes = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60)
    return F.format_string("%02d:%02d:%06.3f", hours.cast("int"), minutes.cast("int"), F.pmod(seconds, F.lit(60.0)))


def piece_edges(text: str, most: int, primary: frozenset[str], secondary: frozenset[str], near: int = 5, far: int = 10, slack: int = 5) -> list[int]:
    """Where the pieces of a text without word timings begin and end: 0, the cuts, the length.

    A piece that has ``most`` characters ends at the first primary break among its last character and the
    ``near - 1`` after it, else at the first secondary break among ``far``, else here once it is ``slack`` longer.
    """
    edges, at = [0], 0
    while at < len(text):
        at = max(at + 1, edges[-1] + most)  # the first end that a piece can have
        if at > len(text):
            break
        hard = next((j for j in range(at, min(at + near, len(text) + 1)) if text[j - 1] in primary), 0)
        soft = hard or next((j for j in range(at, min(at + far, len(text) + 1)) if text[j - 1] in secondary), 0)
        if soft or at - edges[-1] >= most + slack:
            edges.append(soft or at)
            at = edges[-1]
    return edges if edges[-1] == len(text) else [*edges, len(text)]


def cut_edges(text: Column, most: int, primary: tuple[str, ...], secondary: tuple[str, ...], near: int = 5, far: int = 10, slack: int = 5) -> Column:
    """``piece_edges`` of a column, array<int>. Its state resets where the data says, so it is no window or fold
    of columns; an Arrow UDF sends the text once and gets a few numbers back."""
    hard, soft = frozenset(primary), frozenset(secondary)

    @F.pandas_udf(ArrayType(IntegerType()))
    def edges(texts: pd.Series) -> pd.Series:
        return pd.Series([piece_edges(t, most, hard, soft, near, far, slack) if t is not None else None for t in texts])

    return edges(text)


#: Pieces whose offsets one fold finds: a fold copies its array for each piece, so longer lists are folded in blocks.
FOLDED = 512


def offsets(lengths: Column, block: int = FOLDED) -> Column:
    """array<int>: where each of an array of pieces begins, from their lengths; ``lengths`` is a column's name or cheap.

    Two levels of folds, within blocks and over their totals, so that a text of many pieces costs no square of their number.
    """

    def fold(own: Column) -> Column:
        return F.aggregate(own, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))

    def begins(own: Column) -> Column:
        return F.slice(fold(own), F.lit(1), F.size(own))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda k: F.slice(lengths, k * block + 1, F.lit(block)))
    totals = F.transform(blocks, lambda own: F.aggregate(own, F.lit(0), lambda a, n: a + n))
    long = F.flatten(F.zip_with(blocks, begins(totals), lambda own, first: F.transform(begins(own), lambda at: at + first)))
    return F.when(F.size(lengths) <= block, begins(lengths)).otherwise(long)


def between(edges: Column, make) -> Column:
    """array of ``make(start, end)`` for each two neighbours in an array of positions; ``edges`` is a column's name or cheap."""
    starts = F.slice(edges, F.lit(1), F.greatest(F.size(edges) - 1, F.lit(0)))
    return F.transform(starts, lambda a, i: make(a, F.element_at(edges, i + 2)))


def split_long_lines(df: DataFrame, most: int = 20, text: str = "text") -> DataFrame:
    """``df`` with its texts broken into lines of about ``most`` characters."""
    lines = between(F.col("__edges"), lambda a, b: F.substring(F.col(text), a + 1, b - a))
    wrapped = F.when(F.length(text) <= most, F.col(text)).otherwise(F.array_join(lines, "\n"))
    return df.withColumn("__edges", cut_edges(F.col(text), most, PRIMARY_BREAKS, SECONDARY_BREAKS, near=5, far=3, slack=0)).withColumn(text, wrapped).drop("__edges")


def expansion_values(target: float, attempts: int, least: float = 0.5) -> list[float]:
    """Widths of a search that grows by a constant factor from ``least`` to ``target``."""
    from math import ceil

    if attempts <= 1:
        return [target]
    growth = (target / least) ** (1 / (attempts - 1))
    return [ceil(least * growth**i * 10) / 10 for i in range(attempts - 1)] + [target]
