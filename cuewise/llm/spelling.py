"""Spelling variants: one-edit pairs by merging errata tries along heavy paths.

All words stand in a trie. At each node the child whose subtree holds most words is heavy, the others are light, and so
is the end of a word that ends there. Two words one edit apart part at one node, and at most one of them goes on along
the heavy edge there; so it is enough to merge light subtrees into their siblings with one character skipped
or replaced. For a word and each of its light edges that makes these errata, whose coinciding with a terminal is a pair:

* the word with the heavy character in place of its own, and with the heavy character put before its own;
* the word without its own character (only where the next one differs: of a run, the last), and
* for two light edges of one node, the word with a blank in place of its own character: equal ones coincide.

A pair comes up exactly once, so near words are counted without listing pairs twice. A word has at most log2 of the number of
words light edges (small to large), so errata number a logarithm for each word, not its length times the alphabet.

The trie is distributed: a node is its depth and the rolling hash of its prefix, children are counted by aggregation, and
heavy children meet the words in a join of two written tables, which adaptive execution splits where a prefix is hot. Two nodes
that share a hash share one heavy character, which costs at most a few more errata; words are always compared whole.
A group of blanks has at most one word for each letter of the alphabet. No word is too long: its prefixes are never written out.

Defined cases: a null text has no words; a null doc_id hashes as the empty text; of a very long text all words count; letters
outside A-Z, a-z and U+00C0 to U+00FF end a run; repeated rows each count; ties for a form go to the smallest word in code-point
order; an empty table, or one without a word that occurs MIN_COUNT times, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import durable

MIN_LENGTH, MIN_COUNT = 5, 3
NOISE = 97
RATIO = 2
HELD = 1 << 18  # counts that a task holds before it passes them on
BLANK = "*"  # no letter
#: Rolling hash of prefixes: modulus and base.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E68

_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def noisy_words(doc_id: str, text: str) -> Iterator[tuple[str, int]]:
    """Each different lower-cased run of a text, with a character less where its checksum says so, and how often it occurs."""
    seen = zlib.crc32(f"{doc_id}:".encode())
    runs: Counter[str] = Counter()
    for run, n in Counter(_RUNS.findall(text)).items():
        runs[run.translate(_LOWER)] += n
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seen)
        if h % NOISE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    held: Counter[str] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), strict=True):
            for word, n in noisy_words(doc_id.as_py() or "", (text.as_py() or b"").decode("utf-8", "replace")):
                if len(word) >= MIN_LENGTH:
                    held[word] += n
            if len(held) > HELD:
                yield out(held)
                held = Counter()
    yield out(held)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word) to (id, at, node, step): each edge of a word's path; the end is an edge with an empty step."""

    def out(ids: list[int], at: list[int], nodes: list[int], steps: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(nodes, pa.int64()), pa.array(steps, pa.string())], ["id", "at", "node", "step"])

    for batch in batches:
        held = [], [], [], []
        for own, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
            node = 0
            for at, step in enumerate([*word, ""]):
                for column, value in zip(held, (own, at, node, step), strict=True):
                    column.append(value)
                node = (node * BASE + ord(step or BLANK)) % PRIME
                if len(held[0]) >= HELD:
                    yield out(*held)
                    held = [], [], [], []
        yield out(*held)


def light_edges(words: DataFrame) -> DataFrame:
    """(id, at, heavy): where a word of ``words`` (id, word) leaves the heavy path of its trie, and the heavy character there."""
    steps = durable(words.select("id", "word").mapInArrow(_steps, "id long, at int, node long, step string"))
    children = steps.groupBy("at", "node", "step").agg(F.count("*").alias("n"))
    # The end of a word is never heavy; a node with one way on has no light edge.
    size = F.struct((F.col("step") != "").alias("goes_on"), "n", "step")
    nodes = durable(children.groupBy("at", "node").agg(F.max(size).alias("most"), F.count("*").alias("ways")).where("ways > 1").select("at", "node", F.col("most.step").alias("heavy")))
    return steps.join(nodes, ["at", "node"]).where("step != heavy").select("id", "at", "heavy")


def _errata(words: DataFrame, light: DataFrame) -> DataFrame:
    """(word, n, wild, key): the errata of each word at each of its light edges."""
    word, at = F.col("word"), F.col("at")
    before, rest = F.substring(word, F.lit(1), at), F.substring(word, at + 1, F.length(word))
    own, after = F.substring(rest, 1, 1), F.substring(rest, F.lit(2), F.length(word))
    inside = own != ""
    row = lambda wild, key, where: F.when(where, F.struct(F.lit(wild).alias("wild"), key.alias("key")))
    made = F.array(
        row(False, F.concat(before, "heavy", after), inside),
        row(False, F.concat(before, "heavy", rest), F.lit(True)),
        row(False, F.concat(before, after), inside & (F.substring(after, 1, 1) != own)),
        row(True, F.concat(before, F.lit(BLANK), after), inside),
    )
    return light.join(words, "id").select("word", "n", F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("word", "n", "e.*")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words of ``words`` (id, word, n) are one edit away, and the most frequent of them."""
    errata = durable(_errata(words, light_edges(words)))
    rank = lambda n, word: F.struct((-n).alias("less"), word.alias("near"))
    met = errata.where("not wild").select(F.col("word").alias("a"), F.col("n").alias("n_a"), "key").join(words.select(F.col("word").alias("key"), F.col("n").alias("n_b")), "key")
    met = met.select(F.explode(F.array(F.struct(F.col("a").alias("word"), rank(F.col("n_b"), F.col("key")).alias("best")), F.struct(F.col("key").alias("word"), rank(F.col("n_a"), F.col("a")).alias("best")))).alias("p")).select("p.word", F.lit(1).alias("n"), "p.best")
    # At most one member for each letter: the best other one is the first or the second.
    group = errata.where("wild").groupBy("key").agg(F.array_sort(F.collect_list(rank(F.col("n"), F.col("word")))).alias("m")).where(F.size("m") > 1)
    each = group.select("m", F.explode("m").alias("own"))
    other = F.when(F.col("own.near") == F.col("m")[0]["near"], F.col("m")[1]).otherwise(F.col("m")[0])
    each = each.select(F.col("own.near").alias("word"), (F.size("m") - 1).alias("n"), other.alias("best"))
    return met.unionByName(each).groupBy("word").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of ``forms`` (word, form) lead to. Forms at least double in frequency, so there are no rings;
    each round doubles the steps taken, so that a few rounds do."""
    now = durable(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while now.where("moved").take(1):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = durable(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), replaced=now)
    return now.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that occurs often enough in ``docs`` (doc_id, text)."""
    words = durable(count_words(docs).withColumn("id", F.monotonically_increasing_id()))
    near = durable(near_words(words))
    best_n = -F.col("best.less")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(best_n >= RATIO * F.col("n"), F.col("best.near")).alias("form"), F.when(best_n >= RATIO * F.col("n"), best_n).alias("form_n"))
    found = durable(found)
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
