"""Final cleanup: repetitive stammers, and words that recur too often overall or within a time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions import text as T
from cuewise.schema import WORDS, no_words, reindex

RUN = 20
PARTS = f"array<struct<start:double,end:double,text:string,words:{WORDS}>>"
#: A private-use character that marks the edges of runs; texts don't hold it.
EDGE = ""


def with_portions(df: DataFrame, text: str, name: str = "portions") -> DataFrame:
    """``df`` with array<struct<at, piece, repeats>>: a text cut round its runs of RUN or more equal characters."""
    marked = F.split(F.regexp_replace(text, rf"(?d)((.)\2{{{RUN - 1},}})", f"{EDGE}$1{EDGE}"), EDGE)
    rows = df.withColumn("__pieces", marked).withColumn("__lengths", F.transform("__pieces", F.length)).withColumn("__at", T.offsets(F.col("__lengths")))
    cut = F.transform("__pieces", lambda p, i: F.struct(F.element_at("__at", i + 1).alias("at"), p.alias("piece"), (i % 2 == 1).alias("repeats")))
    return rows.withColumn(name, cut).drop("__pieces", "__lengths", "__at")


def _settings(config: dict) -> tuple[dict, dict]:
    words = {"longest": 15, "least": 5, "shown": 3}
    own = config.get("word_repetition", {})
    words |= {to: own[name] for name, to in (("max_pattern_length", "longest"), ("min_repetitions", "least"), ("condensed_display_count", "shown")) if name in own}
    return words, config.get("vocalization_replacement", {})


def vocalization(text: Column, duration: Column, config: dict) -> Column:
    """The sound that stands for ``text``, as often as its duration calls for."""
    options = config.get("vocalization_options", ["あ", "ん", "うん", "はぁ", "ふぅ"])
    counts = config.get("short_repeat_count", 1), config.get("medium_repeat_count", 2), config.get("long_repeat_count", 3)
    return T.build_vocalization(T.detect_vocalization(text, options), duration, config.get("short_duration_threshold", 2.0), config.get("medium_duration_threshold", 5.0), counts)


def filter_stammers(df: DataFrame, config: dict | None = None) -> DataFrame:
    """Condenses stammers; with vocalisation enabled, replaces them by a sound.

    A segment that is all stammer stays one (its words are lost to a sound only). Of others, repetitions are
    condensed and long runs of a character become parts of their own; words stay only with an unchanged text.
    """
    words, sound = _settings(config or {})
    speak = bool(sound.get("enable"))
    start, end, text = F.col("start"), F.col("end"), F.col("text")
    row = lambda a, b, t, w: F.struct(a.alias("start"), b.alias("end"), t.alias("text"), w.alias("words"))
    all_stammer = row(start, end, vocalization(text, end - start, sound), no_words()) if speak else row(start, end, F.col("condensed"), F.col("words"))

    n = F.greatest(F.length("condensed"), F.lit(1))
    at = lambda k: start + (end - start) * (k / n)

    def part(p: Column) -> Column:
        a, b = at(p["at"]), at(p["at"] + F.length(p["piece"]))
        changed = vocalization(p["piece"], b - a, sound) if speak else T.condensing_passes(p["piece"], **words)
        own = F.when(p["piece"] == text, F.col("words")).otherwise(no_words())
        return F.when(p["repeats"], row(a, b, changed, no_words())).otherwise(row(a, b, p["piece"], own))

    found = F.filter(F.col("portions"), lambda p: p["repeats"] | (T.strip(p["piece"]) != ""))
    whole = F.array(row(start, end, F.col("condensed"), F.when(F.col("condensed") == text, F.col("words")).otherwise(no_words()))).cast(PARTS)
    parts = F.when(F.size(found) > 0, F.transform(found, part).cast(PARTS)).otherwise(whole)
    made = F.when(F.col("__stammer"), F.array(all_stammer).cast(PARTS)).otherwise(parts)
    # The 15 passes of the condensing run once a row, not once for each mention.
    once = with_portions(df.withColumn("condensed", T.condense_word_repetitions(text, **words)).withColumn("__stammer", T.is_only_repetitive_stammer(text)), "condensed")
    out = once.select("media_id", "seg_idx", F.posexplode_outer(made).alias("sub_idx", "part")).select("media_id", "seg_idx", "sub_idx", "part.*")
    return reindex(out, "seg_idx", "sub_idx")


def only_token(text: Column) -> Column:
    """The one distinct token of a text, or null if it has several or none."""
    words = T.tokens(T.strip(text), "[、\\s]")
    return F.when(F.size(F.array_distinct(words)) == 1, words[0])


def short_token(text: Column, longest: int) -> Column:
    """``only_token`` if it has up to ``longest`` characters, else null. Texts whose first token is longer are not split."""
    head = F.substring(F.trim(text, F.lit(T.WHITE_SPACE + "、")), 1, longest + 1)
    token = only_token(text)
    return F.when((F.length(head) <= longest) | head.rlike("(?U)[、\\s]"), F.when(F.length(token) <= longest, token))


def recurring_words(df: DataFrame, total: int | None = 12, cluster: int | None = None, window: float = 60.0, longest: int = 3, least: int = 5) -> DataFrame:
    """(media_id, token): tokens of up to ``longest`` characters that segments consist of too often.

    Overall at least ``total`` times, or ``cluster`` times within ``window`` seconds (bounds included) if there
    are ``least`` at all; None switches a rule off. Counting aggregates before it shuffles; only the cluster rule
    has a window, over tokens that can meet it.
    """
    rows = df.select("media_id", "start", only_token(F.col("text")).alias("token")).where(F.length("token") <= longest)
    out = None
    if total is not None:
        out = rows.groupBy("media_id", "token").agg(F.count("*").alias("n")).where(F.col("n") >= total).select("media_id", "token")
    if cluster is not None:
        often = rows.groupBy("media_id", "token").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") >= cluster)).select("media_id", "token")
        # In slots of time as wide as the window, each token also as a guest of the slot before its own: a frequent one spreads.
        width = max(1, round(window * 1e6))
        micros = F.rint(F.col("start") * 1e6).cast("long")
        slot = F.floor(F.col("at") / width)
        places = F.explode(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot - 1).alias("slot"), F.lit(False).alias("own"))))
        timed = rows.join(often, ["media_id", "token"], "left_semi").withColumn("at", micros).select("media_id", "token", "at", places.alias("p")).select("media_id", "token", "at", "p.*")
        ahead = Window.partitionBy("media_id", "token", "slot").orderBy("at").rangeBetween(0, round(window * 1e6))
        close = timed.withColumn("near", F.count("*").over(ahead)).where(F.col("own") & (F.col("near") >= cluster))
        close = close.select("media_id", "token").distinct()
        out = close if out is None else out.unionByName(close).distinct()
    return rows.select("media_id", "token").limit(0) if out is None else out


def rewrite_recurring_words(df: DataFrame, words: DataFrame, config: dict | None = None) -> DataFrame:
    """Segments that are only one of ``words`` (media_id, token) become a sound of fitting length; none is dropped."""
    _, sound = _settings(config or {})
    rows = df.withColumn("token", only_token(F.col("text")))
    out = rows.join(words.withColumn("__hit", F.lit(True)), ["media_id", "token"], "left")
    text = F.when(F.col("__hit"), vocalization(T.strip(F.col("text")), F.col("end") - F.col("start"), sound)).otherwise(F.col("text"))
    return out.select("media_id", "seg_idx", "start", "end", text.alias("text"), "words")


def rewrite_recurring(df: DataFrame, config: dict | None = None, total: int | None = 12, cluster: int | None = None, window: float = 60.0, longest: int = 3, least: int = 5) -> DataFrame:
    """``rewrite_recurring_words`` of ``recurring_words``, in one pass over ``df``: the counts are windows in its partitioning by media item.

    Segments without a short token are each alone in their window.
    """
    _, sound = _settings(config or {})
    rows = df.withColumn("__token", short_token(F.col("text"), longest)).withColumn("__alone", F.when(F.col("__token").isNull(), F.col("seg_idx")))
    group = Window.partitionBy("media_id", "__token", "__alone")
    n, hit = F.count("*").over(group), F.lit(False)
    if total is not None:
        hit = hit | (n >= total)
    if cluster is not None:
        micros = F.rint(F.col("start") * 1e6).cast("long")
        rows = rows.withColumn("__near", F.count("*").over(group.orderBy(micros).rangeBetween(0, round(window * 1e6))))
        hit = hit | ((n >= least) & (n >= cluster) & (F.max("__near").over(group) >= cluster))
    rows = rows.withColumn("__hit", F.col("__token").isNotNull() & hit)
    text = F.when(F.col("__hit"), vocalization(T.strip(F.col("text")), F.col("end") - F.col("start"), sound)).otherwise(F.col("text"))
    return rows.select("media_id", "seg_idx", "start", "end", text.alias("text"), "words")


def final_cleanup(df: DataFrame, config: dict, watch: Callable[[str, DataFrame], DataFrame] = lambda step, df: df) -> DataFrame:
    """Stammers, then recurring words; the cluster rule needs no overall rule to be on."""
    out = df
    stammer = config.get("stammer_filter", {})
    if stammer.get("enable", True):
        out = watch("stammers", filter_stammers(out, stammer))
    overall, cluster = config.get("global_word_filter", {}), config.get("cluster_filter", {})
    total = overall.get("min_occurrences", 12) if overall.get("enable") else None
    close = cluster.get("min_occurrences", 6) if cluster.get("enable") else None
    if total is None and close is None:
        return out
    return watch("recurring words", rewrite_recurring(out, stammer, total, close, cluster.get("time_window_seconds", 60)))
