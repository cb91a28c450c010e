"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

The filter has a fixed number of 256-bit blocks (four 64-bit words, two bits a word), so it is at most
``blocks`` rows however long the list is and can be broadcast. A URL probes one block, as one row of
a broadcast hash join. Only possible hits go on to the exact join with the list; the rest never
shuffle. A longer list raises the share of false positives, never a wrong verdict.

Defined cases: a null URL, or one without ``://``, has empty host and path and is never listed; repeated
pages each get their own row; of two fitting rules of one length the last in order counts; very long URLs are read whole;
an empty list blocks nothing, and an empty table gives an empty result; columns other than id and URL are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import fold_ascii

#: Rules of the query: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

BLOCKS = 1 << 15
WORDS = 4
BITS = 2


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return fold_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` or a default port, and path without ``.html`` or a closing slash.

    Scheme, query and fragment go, so one listed page matches all the forms under which it is linked.
    Null where the URL has no host.
    """
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), r"(/|\.html)+$", "")
    return F.when(host != "", F.concat(host, path))


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    first = F.xxhash64(key)
    second = F.xxhash64(F.lit(1), key)

    def bit(i: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int"))

    masks = [bit(BITS * w).bitwiseOR(bit(BITS * w + 1)) for w in range(WORDS)]
    return F.pmod(first, F.lit(blocks)).cast("int"), masks


def bloom_filter(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """At most ``blocks`` rows (block, w0..w3): the filter of the column ``key``."""
    block, masks = _places(F.col(key), blocks)
    placed = keys.where(F.col(key).isNotNull()).select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return placed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def maybe_in(df: DataFrame, key: str, bloom: DataFrame, out: str = "maybe", blocks: int = BLOCKS) -> DataFrame:
    """``df`` with the boolean ``out``: false only if ``key`` is surely not in the filter."""
    block, masks = _places(F.col(key), blocks)
    small = bloom.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)])
    # At most `blocks` rows of 36 bytes by construction: a proven bound for the broadcast.
    joined = df.withColumn("__b", block).join(F.broadcast(small), F.col("__b") == F.col("__block"), "left")
    hit = reduce(lambda a, b: a & b, [F.col(f"__w{i}").bitwiseAND(m) == m for i, m in enumerate(masks)])
    return joined.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__b", "__block", *[f"__w{i}" for i in range(WORDS)])


def _rules(rules: list[tuple[str, str, str]], of) -> Column:
    """The first fitting rule, longest first; ``of`` maps a rule to its value."""
    out = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(of(host, path, verdict))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """A verdict for each page: its rule's, else ``block`` if its canonical URL is listed, else ``allow``.

    ``listed`` has a column ``url``. Returns page_id, host, path, rule, verdict, listed (boolean).
    """
    mine = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    mine = mine.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), canonical_url(F.col("url")).alias("key"))
    keys = listed.select(canonical_url(F.col("url")).alias("key")).where("key is not null").distinct()
    probed = maybe_in(mine, "key", bloom_filter(keys, "key"))
    hits = probed.where("maybe").join(keys.withColumn("__in", F.lit(True)), "key", "left").withColumn("listed", F.coalesce("__in", F.lit(False)))
    rest = probed.where("not maybe").withColumn("listed", F.lit(False))
    columns = ["page_id", "host", "path", "listed"]
    both = hits.select(columns).unionByName(rest.select(columns))
    rule = _rules(rules, lambda host, path, _: host + path)
    verdict = F.coalesce(_rules(rules, lambda *r: r[2]), F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")
