"""One query for each operator over the driver's tables, and its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.functions import jsonfix
from cuewise.functions import similarity as S
from cuewise.functions import text as T
from cuewise.operators import align, cleanup, cues, filters, merge, models, polish, split
from cuewise.plans import adapters
from cuewise.plans.pipeline import Pipeline
from cuewise.schema import WORDS, reindex
from cuewise.sources.tables import read_table, spread

#: The tables hold Latin text, so the breaks and markers are Latin too.
PRIMARY, SECONDARY, MARKERS = (".", "?", "!"), (",",), (",", "the", "and")
PHRASES = ["(?i)all ?rights", "^[0-9]+$", "[0-9]{12,}"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.seg_lines(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.seg_turns(read_table(spark, sf_dir, "conversations"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.seg_events(read_table(spark, sf_dir, "events"))


def _shown(df: DataFrame) -> DataFrame:
    """Segments without their words, times rounded as in the SQL."""
    return df.select("media_id", "seg_idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text", F.size("words").alias("n_words"))


def _cues(df: DataFrame) -> DataFrame:
    return df.select("media_id", "cue", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text", "timing")


def segment_cues(spark, sf_dir):
    """Lines, collapsed, without implausible rates, as cues."""
    return _cues(cues.vtt_cues(filters.validate_timing(merge.remove_consecutive_duplicates(lines(spark, sf_dir)), 14.0)))


def dup_collapse_lines(spark, sf_dir):
    return _shown(merge.remove_consecutive_duplicates(lines(spark, sf_dir)))


def dup_collapse_events(spark, sf_dir):
    return _shown(merge.remove_consecutive_duplicates(events(spark, sf_dir)))


def _numbered_events(spark, sf_dir) -> DataFrame:
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)) / 1e6
    rows = read_table(spark, sf_dir, "events").select(F.lit("all").alias("media_id"), F.col("event_id").cast("int").alias("seg_idx"), start.alias("start"), F.col("event_type").alias("text"), "value")
    return rows.select("media_id", "seg_idx", "start", (F.col("start") + F.col("value")).alias("end"), "text", F.array().cast(WORDS).alias("words"))


def dup_collapse_long(spark, sf_dir):
    """All events as one media item, in chunks that are scanned apart and stitched."""
    return _shown(merge.remove_consecutive_duplicates(_numbered_events(spark, sf_dir), chunk=1000))


def merge_incomplete_long(spark, sf_dir):
    return _shown(merge.merge_incomplete_segments(_numbered_events(spark, sf_dir), ("e", "k"), 30.0, 12, chunk=1000))


def gap_fill_long(spark, sf_dir):
    return _cues(cues.vtt_cues(_numbered_events(spark, sf_dir), chunk=1000))


def merge_incomplete_turns(spark, sf_dir):
    return _shown(merge.merge_incomplete_segments(turns(spark, sf_dir), (".",), 0.5, 600))


def merge_incomplete_lines(spark, sf_dir):
    return _shown(merge.merge_incomplete_segments(adapters.dealt_with_words(lines(spark, sf_dir)), (".", ","), 0.5, 200))


def single_char_merge(spark, sf_dir):
    return _shown(merge.merge_single_char_segments(_named(events(spark, sf_dir), LETTERS)))


def phrase_filter(spark, sf_dir):
    return _shown(filters.remove_phrases(lines(spark, sf_dir), filters.phrase_patterns({"patterns": PHRASES})))


def phrase_filter_legacy(spark, sf_dir):
    config = {"phrases": ["All rights reserved.", "..."], "regex_patterns": ["^Licensed", "("]}
    return _shown(filters.remove_phrases(lines(spark, sf_dir), filters.phrase_patterns(config)))


def timing_filter(spark, sf_dir):
    return _shown(filters.validate_timing(events(spark, sf_dir), 0.5))


def filter_chain(spark, sf_dir):
    config = {"phrase_filter": {"enable": True, "patterns": ["^cl"]}, "consecutive_duplicates": {"enable": True}, "timing_validation": {"enable": True, "max_chars_per_second": 0.5}}
    return _shown(filters.filter_invented(events(spark, sf_dir), config))


#: Tokens of at most three letters, and of one, that stand for the types of events.
TOKENS = {"click": "cli", "purchase": "pur", "signup": "sig", "view": "vie", "error": "err"}
LETTERS = {"click": "c", "purchase": "p", "signup": "s", "view": "v", "error": "e"}


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Texts that ``names`` holds replaced, others whole."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn("text", F.coalesce(known[F.col("text")], "text"))


def _short(df):
    return _named(df, TOKENS)


def global_words(spark, sf_dir):
    return cleanup.recurring_words(_short(events(spark, sf_dir)), total=14)


def cluster_words(spark, sf_dir):
    return cleanup.recurring_words(_short(events(spark, sf_dir)), total=None, cluster=3, window=40_000.0)


def global_word_rewrite(spark, sf_dir):
    rows = _short(events(spark, sf_dir))
    config = {"vocalization_replacement": {"vocalization_options": ["u", "c", "v"], "short_duration_threshold": 20.0, "medium_duration_threshold": 60.0}}
    return _shown(cleanup.rewrite_recurring_words(rows, cleanup.recurring_words(rows, total=14), config))


def interval_anti_merge(spark, sf_dir):
    rows = events(spark, sf_dir)
    return _shown(merge.merge_segments(rows.where("text = 'purchase'"), rows.where("text <> 'purchase'"), bucket=3600.0))


def gap_fill_cues(spark, sf_dir):
    return _cues(cues.vtt_cues(events(spark, sf_dir)))


def gap_fill_worded(spark, sf_dir):
    """Cues of turns of which every second has words: it keeps its start, others begin where the one before ends."""
    rows = turns(spark, sf_dir).withColumn("start", F.col("start") + 0.25)
    worded = F.when(F.col("seg_idx") % 2 == 1, F.col("words")).otherwise(F.array().cast(WORDS))
    return _cues(cues.vtt_cues(adapters.with_words(rows).withColumn("words", worded)))


def vtt_file_text(spark, sf_dir):
    return cues.vtt_files(cues.vtt_cues(turns(spark, sf_dir)))


def format_timestamps(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select("media_id", "seg_idx", T.format_timestamp(F.col("start")).alias("at"), T.format_display_time(F.col("start")).alias("shown"))


def neighbour_overlap(spark, sf_dir):
    return merge.neighbour_overlaps(events(spark, sf_dir))


def batch_ids(spark, sf_dir):
    return cues.batches(turns(spark, sf_dir), 10).select("media_id", "seg_idx", "batch_id", "pos")


def split_bypass(spark, sf_dir):
    return _shown(split.bypass_split(lines(spark, sf_dir)))


def word_split(spark, sf_dir):
    return _shown(split.split_segments(adapters.with_words(turns(spark, sf_dir)), 60, PRIMARY, SECONDARY))


def char_split(spark, sf_dir):
    return _shown(split.split_segments(lines(spark, sf_dir), 30, char_primary=PRIMARY, char_secondary=(",", " ")))


def line_wrap(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("text", F.translate("text", ".,", "。、"))
    return T.split_long_lines(rows).select("media_id", "seg_idx", F.col("text").alias("wrapped"))


def text_cleaners(spark, sf_dir):
    t = F.col("text")
    return lines(spark, sf_dir).select(
        "media_id", "seg_idx", T.normalize_text(t).alias("normalized"), T.clean_for_matching(t).alias("matching"), T.clean_for_similarity(t).alias("similar"), T.clean_stammer(t).alias("stammer"), T.contains_japanese(t).alias("japanese")
    )


def stammer_flags(spark, sf_dir):
    t = F.col("text")
    return lines(spark, sf_dir).select("media_id", "seg_idx", T.is_only_repetitive_stammer(t).alias("is_stammer"), T.is_repetitive_characters(t).alias("is_repetitive"))


def condense_repetitions(spark, sf_dir):
    return lines(spark, sf_dir).select("media_id", "seg_idx", T.condense_word_repetitions(F.col("text")).alias("text"))


def stammer_parts(spark, sf_dir):
    return _shown(cleanup.filter_stammers(lines(spark, sf_dir), {"word_repetition": {"min_repetitions": 30}, "vocalization_replacement": {"enable": True}}))


def vocalizations(spark, sf_dir):
    return events(spark, sf_dir).select("media_id", "seg_idx", cleanup.vocalization(F.col("text"), F.col("end") - F.col("start"), {"vocalization_options": ["u", "cl", "v"], "short_duration_threshold": 20.0, "medium_duration_threshold": 60.0}).alias("sound"))


def similarity_bounds(spark, sf_dir):
    """Neighbouring turns whose similarity could reach 0.5."""
    from cuewise.schema import by_position

    rows = turns(spark, sf_dir).select("media_id", "seg_idx", "text", F.lag("text").over(by_position()).alias("before")).where("before is not null")
    return rows.select("media_id", "seg_idx", F.round(S.similarity_bound(F.col("text"), F.col("before")), 9).alias("bound")).where("bound >= 0.5")


def similarity_neighbours(spark, sf_dir):
    """Neighbouring turns with a similarity of at least 0.3; the bound spares the UDF the others."""
    from cuewise.schema import by_position

    rows = turns(spark, sf_dir).select("media_id", "seg_idx", "text", F.lag("text").over(by_position()).alias("before")).where("before is not null")
    near = rows.where(S.similarity_bound(F.col("text"), F.col("before")) >= 0.3)
    return near.select("media_id", "seg_idx", F.round(S.similarity(F.col("text"), F.col("before")), 6).alias("similarity")).where("similarity >= 0.3")


def response_fix(spark, sf_dir):
    """Model answers of several malformed kinds, made from the turns."""
    q = F.to_json(F.array("text"))
    kinds = [F.concat(F.lit('{"polished": '), q, F.lit("}")), F.concat(F.lit("```json\n{\"polished\": "), q, F.lit("}\n```")), F.concat(F.lit("【JSON】\n"), q), q, F.concat(F.lit('{"polished": '), q), F.concat(F.lit('{"polished": '), q, F.lit("} done"))]
    rows = turns(spark, sf_dir).withColumn("raw", F.element_at(F.array(*kinds), F.col("seg_idx") % len(kinds) + 1))
    fixed = rows.withColumn("found", jsonfix.parse_json_response(F.col("raw")))
    return fixed.select("media_id", "seg_idx", F.col("found.items")[0].alias("text"), F.col("found.error").alias("error"))


def polish_batches(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    return polish.polish_segments(rows, lambda: models.StubTextModel(lambda t: f"- {t}"), 10).select("media_id", "seg_idx", "text", "error")


class _Sentences:
    """A stand-in model that splits the one line of a prompt after its full stops."""

    def generate(self, prompt: str, max_tokens: int = 0, temperature: float = 0.0) -> str:
        import json
        import re

        text = re.search(r"(?m)^1\. (.*)$", prompt)[1]
        return json.dumps({"segments": [p for p in re.split(r"(?<=\.) ", text) if p]}, ensure_ascii=False)


def model_split(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    return _shown(polish.split_with_model(adapters.with_words(rows), _Sentences, 60))


def _shifted(df: DataFrame) -> DataFrame:
    """Short segments whose clock is wrong by up to 1.2 s, without words."""
    shift = (F.col("seg_idx") % 5 - 2) * 0.6
    return df.withColumns({"start": F.greatest(F.lit(0.0), F.col("start") + shift), "end": F.col("end") + shift, "words": F.array().cast("array<struct<word:string,start:double,end:double>>")})


def _spoken(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pieces of the turns, with the words that are really spoken."""
    rows = adapters.with_words(turns(spark, sf_dir))
    rows = split.split_segments(rows, 40, PRIMARY, SECONDARY)
    return _shifted(rows), adapters.word_table(rows)


def realign_time_based(spark, sf_dir):
    rows, truth = _spoken(spark, sf_dir)
    return _shown(align.realign_timing(rows, {"method": "time_based", "time_based": {"similarity": 0.75}}, models.TableRecogniser, truth))


def realign_text_search(spark, sf_dir):
    rows, truth = _spoken(spark, sf_dir)
    return _shown(align.realign_timing(rows, {"method": "text_search", "text_search": {"expansion": 3.0, "expansion_attempts": 3}}, models.TableRecogniser, truth))


def revalidate_timing(spark, sf_dir):
    rows, truth = _spoken(spark, sf_dir)
    return _shown(filters.validate_timing(rows, 14.0, models.TableRecogniser, truth))


def _half_worded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Turns whose clock is wrong, every second one with words; and the words that are really spoken."""
    rows = adapters.with_words(turns(spark, sf_dir))
    return _shifted(rows).drop("words").join(rows.select("media_id", "seg_idx", F.when(F.col("seg_idx") % 2 == 0, F.col("words")).otherwise(F.array().cast(WORDS)).alias("words")), ["media_id", "seg_idx"]), adapters.word_table(rows)


def second_look(spark, sf_dir):
    """Segments that are too fast, too short or without words get what is heard in their time."""
    rows, truth = _half_worded(spark, sf_dir)
    return _shown(filters.revalidate_segments(rows, models.TableRecogniser, truth, 14.0))


def phrase_second_look(spark, sf_dir):
    """Segments that match a phrase stay with what is heard in their time, if that differs and matches none."""
    rows, truth = _half_worded(spark, sf_dir)
    return _shown(filters.remove_phrases(rows, ["(?i)^the", "ing$"], models.TableRecogniser, truth))


def subtitle_pipeline(spark, sf_dir):
    config = {
        "segment_merging": {"incomplete_markers": list(MARKERS)},
        "segment_splitting": {"max_line_length": 60, "primary_breaks": list(PRIMARY), "secondary_breaks": list(SECONDARY)},
        "hallucination_filter": {"phrase_filter": {"enable": True, "patterns": PHRASES}, "consecutive_duplicates": {"enable": True}, "timing_validation": {"enable": True}},
        "final_cleanup": {"global_word_filter": {"enable": True}},
    }
    return _cues(Pipeline(config).cues(adapters.dealt_with_words(lines(spark, sf_dir))))


def reindexed(spark, sf_dir):
    return reindex(events(spark, sf_dir).where("text <> 'view'")).select("media_id", "seg_idx", "text")


_NOT_QUERIES = {"lines", "turns", "events"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] not in "_QPS" and n not in _NOT_QUERIES and n not in ("queries", "oracle_sql")}


_LINES = """
raw AS (SELECT doc_id::VARCHAR AS media_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, (generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1)::INT AS seg_idx FROM documents),
ahead AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY media_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS a FROM raw),
seg AS (SELECT media_id, seg_idx, a / 15 AS s, (a + length(text)) / 15 AS e, text FROM ahead)"""
_TURNS = """
raw AS (SELECT conv_id::VARCHAR AS media_id, coalesce(text, '') AS text, turn::INT AS seg_idx FROM conversations),
ahead AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY media_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS a FROM raw),
seg AS (SELECT media_id, seg_idx, a / 15 AS s, (a + length(text)) / 15 AS e, text FROM ahead)"""
_EVENTS = """
raw AS (SELECT user_id::VARCHAR AS media_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS seg_idx, (epoch_us(ts::TIMESTAMP) - 1704067200000000)::DOUBLE / 1000000 AS s, event_type AS text, value FROM events),
seg AS (SELECT media_id, seg_idx, s, s + value AS e, text FROM raw)"""
_ONE_ITEM = """
seg AS (SELECT 'all' AS media_id, event_id::INT AS seg_idx, (epoch_us(ts::TIMESTAMP) - 1704067200000000)::DOUBLE / 1000000 AS s, (epoch_us(ts::TIMESTAMP) - 1704067200000000)::DOUBLE / 1000000 + value AS e, event_type AS text FROM events)"""
_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x0B\x{{85}}\p{{Z}}]+', ''), '[\s\x0B\x{{85}}\p{{Z}}]+$', '')"
_SPACE = r"\s\x0B\x{85}\p{Z}"
_OUT = "SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) - 1)::INT AS seg_idx, round(s, 6) AS start, round(e, 6) AS \"end\", text, {0} AS n_words FROM {1}"


def _strip(c: str) -> str:
    return _STRIP.format(c)


def _collapse(source: str, to: str, text: str | None = None) -> str:
    """CTEs that collapse runs of equal trimmed texts of ``source`` into ``to``."""
    text = text or _strip("text")
    return f"""
{to}_t AS (SELECT * REPLACE ({text} AS text) FROM {source}),
{to}_n AS (SELECT *, CASE WHEN text = lag(text) OVER (PARTITION BY media_id ORDER BY seg_idx) THEN 0 ELSE 1 END AS fresh FROM {to}_t),
{to}_g AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY seg_idx) AS island FROM {to}_n),
{to} AS (SELECT media_id, min(seg_idx) AS seg_idx, arg_min(s, seg_idx) AS s, arg_max(e, seg_idx) AS e, min(text) AS text FROM {to}_g GROUP BY media_id, island)"""


def _stamp(c: str) -> str:
    us = f"(((round_even({c} * 1000000, 0)::BIGINT % 86400000000) + 86400000000) % 86400000000)"
    return f"printf('%02d:%02d:%02d.%03d', {us} // 3600000000, ({us} // 60000000) % 60, ({us} // 1000000) % 60, ({us} // 1000) % 1000)"


def _cue(source: str) -> str:
    return f"""
shown AS (SELECT media_id, seg_idx, s, e, {_strip('text')} AS text FROM {source} WHERE {_strip('text')} <> ''),
cued AS (SELECT media_id, row_number() OVER w AS cue, coalesce(lag(e) OVER w, s) AS s, e, text FROM shown WINDOW w AS (PARTITION BY media_id ORDER BY seg_idx))"""


_CUED = f"SELECT media_id, cue::INT AS cue, round(s, 6) AS start, round(e, 6) AS \"end\", text, {_stamp('s')} || ' --> ' || {_stamp('e')} AS timing FROM cued"
_RATE = "NOT coalesce(length(text) / (e - s) > {0} OR (length(text) / (e - s) < 1.0 AND length(text) > 5), true) AND e > s"
_TOKENS = rf"list_filter(regexp_split_to_array({_strip('text')}, '[、{_SPACE}]+'), lambda x: x <> '')"
_ONE = f"CASE WHEN len(list_distinct({_TOKENS})) = 1 THEN ({_TOKENS})[1] END"
_SOUND = "CASE WHEN contains({0}, '{1}') THEN '{1}' WHEN contains({0}, '{2}') THEN '{2}' WHEN contains({0}, '{3}') THEN '{3}' ELSE '{1}' END"


def _sounds(text: str, a: str, b: str, c: str) -> str:
    one = _SOUND.format(text, a, b, c)
    return f"array_to_string(list_transform(range(CASE WHEN e - s < 20.0 THEN 1 WHEN e - s < 60.0 THEN 2 ELSE 3 END), lambda i: {one}), '、')"


def _merged(gap: float, most: int, ends: str, words: str, n_words: str) -> str:
    """Incomplete segments: islands of neighbours, then their texts and the number of their words."""
    return f"""
t AS (SELECT *, {_strip('text')} AS own, {words} AS n FROM seg),
n AS (SELECT *, CASE WHEN regexp_matches(lag(own) OVER w, '{ends}') AND s - lag(e) OVER w < {gap} AND length(lag(own) OVER w) + length(own) <= {most} THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY media_id ORDER BY seg_idx)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY seg_idx) AS island FROM n),
m AS (SELECT media_id, min(seg_idx) AS seg_idx, arg_min(s, seg_idx) AS s, arg_max(e, seg_idx) AS e, CASE WHEN count(*) = 1 THEN min(text) ELSE string_agg(own, '' ORDER BY seg_idx) END AS text, {n_words} AS k FROM g GROUP BY media_id, island)
{_OUT.format('k::INT', 'm')}"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_WHEN = lambda names: "CASE text " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " ELSE text END"
_SHORT = f"short AS (SELECT * REPLACE ({_WHEN(TOKENS)} AS text) FROM seg)"
_TOKEN = f"tok AS (SELECT *, {_ONE} AS token FROM short)"
_GLOBAL = "hits AS (SELECT media_id, token FROM tok WHERE length(token) <= 3 GROUP BY media_id, token HAVING count(*) >= 14)"
_WORD_COUNT = "(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text[:-2], ' ', '')) - length(text) + length(text[:-2]) + 1 END)"


def _edges(source: str, most: int, hard: str, soft: str, far: int, slack: int) -> str:
    """A recursive CTE over the long texts of ``source``: ``pos``, the first end that a piece may have, moves on until one is cut; then
    ``piece`` lists each piece's number, first character and length."""
    ahead = lambda n, marks: f"length(regexp_extract(substr(text, pos::BIGINT, {n}), '^[^{marks}]*'))"
    found = lambda n, marks: f"CASE WHEN {ahead(n, marks)} < length(substr(text, pos::BIGINT, {n})) THEN pos + {ahead(n, marks)} END"
    return f"""
walk AS (
  SELECT media_id, seg_idx, text, 0 AS b, {most} AS pos, NULL::INT AS cut FROM {source} WHERE length(text) > {most}
  UNION ALL
  SELECT media_id, seg_idx, text, coalesce(e, b) AS b, coalesce(e + {most}, pos + 1) AS pos, e AS cut FROM (
    SELECT *, coalesce({found(5, hard)}, {found(far, soft)}, CASE WHEN pos - b >= {most + slack} THEN pos END)::INT AS e
    FROM (SELECT media_id, seg_idx, text, b, pos FROM walk WHERE pos <= length(text)))),
edge AS (SELECT DISTINCT media_id, seg_idx, text, p FROM (
  SELECT media_id, seg_idx, text, unnest([0, length(text)::INT, cut]) AS p FROM walk) WHERE p IS NOT NULL),
piece AS (SELECT media_id, seg_idx, text, p, lead(p) OVER (PARTITION BY media_id, seg_idx ORDER BY p) AS q FROM edge QUALIFY q IS NOT NULL)"""


#: Words of ``seg``: the text up to and with each space, timed by characters.
_WORDED = """
cutw AS (SELECT media_id, seg_idx, s, e, text, unnest(regexp_extract_all(text, '[^ ]* |[^ ]+$')) AS word, generate_subscripts(regexp_extract_all(text, '[^ ]* |[^ ]+$'), 1) AS i FROM seg),
offw AS (SELECT *, sum(length(word)) OVER (PARTITION BY media_id, seg_idx ORDER BY i) AS k FROM cutw),
word AS (SELECT media_id, seg_idx, i, word, s + (e - s) * ((k - length(word))::DOUBLE / length(text)) AS a, s + (e - s) * (k::DOUBLE / length(text)) AS b FROM offw)"""


def _word_pieces(most: int) -> str:
    """Recursive CTEs that cut the turns by their words: ``word`` has the words, ``out`` the pieces."""
    return "WITH RECURSIVE " + ",".join([_TURNS, _WORDED]) + f""",
long AS (SELECT media_id, seg_idx FROM seg WHERE length({_strip('text')}) > {most}),
hw AS (SELECT *, regexp_matches(word, '[.?!]') AS hard, contains(word, ',') AS soft FROM word SEMI JOIN long USING (media_id, seg_idx)),
nw AS (SELECT *, coalesce(bool_or(hard) OVER (PARTITION BY media_id, seg_idx ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), false) AS ahead FROM hw),
walk AS (
  SELECT media_id, seg_idx, 0::BIGINT AS i, 0::BIGINT AS size, 0 AS piece, 0 AS next FROM long
  UNION ALL
  SELECT w.media_id, w.seg_idx, w.i, CASE WHEN cut THEN 0 ELSE w.size END, w.next, w.next + cut::INT FROM (
    SELECT n.*, walk.size + length(n.word) AS size, walk.next, n.hard OR (walk.size + length(n.word) >= {most} AND NOT n.ahead AND n.soft) AS cut
    FROM walk JOIN nw n ON n.media_id = walk.media_id AND n.seg_idx = walk.seg_idx AND n.i = walk.i + 1) w),
out AS (
  SELECT media_id, seg_idx, piece, arg_min(a, i) AS s, arg_max(b, i) AS e, string_agg(word, '' ORDER BY i) AS text, count(*) AS n FROM walk JOIN word USING (media_id, seg_idx, i) GROUP BY media_id, seg_idx, piece
  UNION ALL
  SELECT media_id, seg_idx, 0, s, e, {_strip('text')}, len(regexp_extract_all(text, '[^ ]* |[^ ]+$')) FROM seg ANTI JOIN long USING (media_id, seg_idx))"""


def oracle_sql() -> dict[str, str]:
    """By name of the query. Queries with back-references, model calls or sequential repairs have none."""
    clean = lambda c, p: f"regexp_replace({c}, '{p}', '', 'g')"
    clean_stammer = clean("text", rf"[、。？！{_SPACE}…]")
    similar = lambda c: clean(c, rf"[、。！？{_SPACE}]")
    norm = clean("text", rf"[{_SPACE}、。！？…\.,!?]+")
    chars = f"string_split({clean_stammer}, '')"
    words = rf"list_filter(regexp_split_to_array({_strip('text')}, '[、。？！{_SPACE}…]+'), lambda x: x <> '')"
    top = lambda xs: f"list_max(list_transform(list_distinct({xs}), lambda x: len(list_filter({xs}, lambda y: y = x))))"
    struck = lambda *patterns: " OR ".join(f"regexp_matches({norm}, '{p}')" for p in patterns)
    bound_len = f"length({similar('text')})", f"length({similar('before')})"
    return {
        "segment_cues": _with(_LINES, _collapse("seg", "c"), f"kept AS (SELECT * FROM c WHERE {_RATE.format('14.0')})", _cue("kept")) + _CUED,
        "dup_collapse_lines": _with(_LINES, _collapse("seg", "c")) + _OUT.format("0", "c"),
        "dup_collapse_events": _with(_EVENTS, _collapse("seg", "c")) + _OUT.format("0", "c"),
        "dup_collapse_long": _with(_ONE_ITEM, _collapse("seg", "c")) + _OUT.format("0", "c"),
        "merge_incomplete_long": _with(_ONE_ITEM, _merged(30.0, 12, "[ek]$", "0", "0")),
        "gap_fill_long": _with(_ONE_ITEM, _cue("seg")) + _CUED,
        "merge_incomplete_turns": _with(_TURNS, _merged(0.5, 600, r"\.$", "0", "0")),
        "merge_incomplete_lines": _with(_LINES, _merged(0.5, 200, "[.,]$", _WORD_COUNT, "CASE WHEN count(*) = 1 OR min(n) > 0 THEN sum(n) ELSE 0 END")),
        "single_char_merge": _with(
            _EVENTS,
            f"one AS (SELECT * REPLACE ({_WHEN(LETTERS)} AS text) FROM seg)",
            "n AS (SELECT *, CASE WHEN text = lag(text) OVER (PARTITION BY media_id ORDER BY seg_idx) THEN 0 ELSE 1 END AS fresh FROM one)",
            "g AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY seg_idx) AS island FROM n)",
            "m AS (SELECT media_id, min(seg_idx) AS seg_idx, arg_min(s, seg_idx) AS s, arg_max(e, seg_idx) AS e, string_agg(text, '、' ORDER BY seg_idx) AS text FROM g GROUP BY media_id, island)",
        )
        + _OUT.format("0", "m"),
        "phrase_filter": _with(_LINES, f"k AS (SELECT * FROM seg WHERE NOT ({struck('(?i)all ?rights', '^[0-9]+$', '[0-9]{12,}')}))") + _OUT.format("0", "k"),
        "phrase_filter_legacy": _with(_LINES, f"k AS (SELECT * FROM seg WHERE NOT ({struck('^Allrightsreserved$', '^Licensed')}))") + _OUT.format("0", "k"),
        "timing_filter": _with(_EVENTS, f"k AS (SELECT * FROM seg WHERE {_RATE.format('0.5')})") + _OUT.format("0", "k"),
        "filter_chain": _with(
            _EVENTS,
            f"p AS (SELECT * FROM seg WHERE NOT ({struck('^cl')}))",
            _collapse("p", "c"),
            f"d AS (SELECT *, {_RATE.format('0.5')} AS ok FROM c)",
            "q AS (SELECT *, bool_or(NOT ok) OVER (PARTITION BY media_id) AS lost FROM d)",
            f"r AS (SELECT * FROM q WHERE ok AND NOT (lost AND ({struck('^cl')})))",
            "rn AS (SELECT *, CASE WHEN lost AND text = lag(text) OVER (PARTITION BY media_id ORDER BY seg_idx) THEN 0 ELSE 1 END AS fresh FROM r)",
            "rg AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY seg_idx) AS island FROM rn)",
            "f AS (SELECT media_id, min(seg_idx) AS seg_idx, arg_min(s, seg_idx) AS s, arg_max(e, seg_idx) AS e, min(text) AS text FROM rg GROUP BY media_id, island)",
        )
        + _OUT.format("0", "f"),
        "global_words": _with(_EVENTS, _SHORT, _TOKEN, _GLOBAL) + "SELECT * FROM hits",
        "cluster_words": _with(
            _EVENTS,
            _SHORT,
            _TOKEN,
            "k AS (SELECT media_id, token, s, count(*) OVER (PARTITION BY media_id, token) AS n FROM tok WHERE length(token) <= 3)",
            "w AS (SELECT *, count(*) OVER (PARTITION BY media_id, token ORDER BY s RANGE BETWEEN CURRENT ROW AND 40000 FOLLOWING) AS near FROM k)",
        )
        + "SELECT DISTINCT media_id, token FROM w WHERE n >= 5 AND near >= 3",
        "global_word_rewrite": _with(
            _EVENTS, _SHORT, _TOKEN, _GLOBAL, f"j AS (SELECT tok.media_id, seg_idx, s, e, CASE WHEN hits.token IS NOT NULL THEN {_sounds('text', 'u', 'c', 'v')} ELSE text END AS text FROM tok LEFT JOIN hits ON tok.media_id = hits.media_id AND tok.token = hits.token)"
        )
        + _OUT.format("0", "j"),
        "interval_anti_merge": _with(
            _EVENTS,
            "o AS (SELECT *, CASE WHEN text = 'purchase' THEN 0 ELSE 1 END AS side FROM seg)",
            "k AS (SELECT * FROM o WHERE side = 0 OR NOT EXISTS (SELECT 1 FROM o c WHERE c.side = 0 AND c.media_id = o.media_id AND o.e > c.s AND o.s < c.e))",
        )
        + 'SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY s, side, seg_idx) - 1)::INT AS seg_idx, round(s, 6) AS start, round(e, 6) AS "end", text, 0 AS n_words FROM k',
        "gap_fill_cues": _with(_EVENTS, _cue("seg")) + _CUED,
        "vtt_file_text": _with(_TURNS, _cue("seg")) + f"SELECT media_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(cue || chr(10) || {_stamp('s')} || ' --> ' || {_stamp('e')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY cue) AS content FROM cued GROUP BY media_id",
        "format_timestamps": _with(_EVENTS) + f"SELECT media_id, seg_idx, {_stamp('s')} AS at, printf('%02d:%02d:%06.3f', floor(s / 3600)::BIGINT, floor(s % 3600 / 60)::BIGINT, round((s % 60)::VARCHAR::DECIMAL(38, 20), 3)::DOUBLE) AS shown FROM seg",
        "neighbour_overlap": _with(_EVENTS) + "SELECT media_id, seg_idx, coalesce(s < lag(e) OVER w + 0.1::DOUBLE, false) AS overlaps_prev, coalesce(e > lead(s) OVER w - 0.1::DOUBLE, false) AS overlaps_next FROM seg WINDOW w AS (PARTITION BY media_id ORDER BY seg_idx)",
        "batch_ids": _with(_TURNS, "n AS (SELECT media_id, seg_idx, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) - 1 AS k FROM seg)") + "SELECT media_id, seg_idx, (k // 10)::INT AS batch_id, (k % 10)::INT AS pos FROM n",
        "split_bypass": _with(_LINES) + f'SELECT media_id, seg_idx, round(s, 6) AS start, round(e, 6) AS "end", {_strip("text")} AS text, 0 AS n_words FROM seg',
        "text_cleaners": _with(_LINES)
        + f"SELECT media_id, seg_idx, {norm} AS normalized, {clean('text', rf'[、。？！{_SPACE}…「」『』【】（）()\[\]]+')} AS matching, {similar('text')} AS similar, {clean_stammer} AS stammer, regexp_matches(text, '[぀-ゟ゠-ヿ一-鿿]') AS japanese FROM seg",
        "stammer_flags": _with(_LINES, f"k AS (SELECT media_id, seg_idx, text, {clean_stammer} AS clean, {chars} AS c, {words} AS w FROM seg)")
        + f"""SELECT media_id, seg_idx,
  length(clean) = 0 OR (len(list_distinct(c)) <= 2 AND length(clean) >= 8) OR (length(clean) >= 50 AND {top('c')} >= 50 AND {top('c')}::DOUBLE / length(clean) >= 0.8::DOUBLE)
    OR (len(w) >= 5 AND {top('w')} >= 5 AND {top('w')}::DOUBLE / len(w) >= 0.8::DOUBLE) AS is_stammer,
  length({clean(_strip('text'), rf'[、。？！{_SPACE}]')}) >= 3 AND len(list_distinct(list_filter(string_split({clean(_strip('text'), rf'[、。？！{_SPACE}]')}, ''), lambda x: x <> ''))) <= 2 AS is_repetitive
FROM k""",
        "vocalizations": _with(_EVENTS) + f"SELECT media_id, seg_idx, {_sounds('text', 'u', 'cl', 'v')} AS sound FROM seg",
        "similarity_bounds": _with(
            _TURNS,
            "n AS (SELECT media_id, seg_idx, text, lag(text) OVER (PARTITION BY media_id ORDER BY seg_idx) AS before FROM seg)",
            f"b AS (SELECT media_id, seg_idx, CASE WHEN {bound_len[0]} > 0 AND {bound_len[1]} > 0 THEN round(2.0::DOUBLE * least({bound_len[0]}, {bound_len[1]}) / ({bound_len[0]} + {bound_len[1]}), 9) ELSE 0 END AS bound FROM n WHERE before IS NOT NULL)",
        )
        + "SELECT * FROM b WHERE bound >= 0.5",
        "response_fix": _with(_TURNS) + "SELECT media_id, seg_idx, text, NULL::VARCHAR AS error FROM seg",
        "polish_batches": _with(_TURNS) + r"SELECT media_id, seg_idx, '- ' || regexp_replace(text, '\s+', ' ', 'g') AS text, NULL::VARCHAR AS error FROM seg",
        "line_wrap": "WITH RECURSIVE " + ",".join([_LINES, "t AS (SELECT media_id, seg_idx, translate(text, '.,', '。、') AS text FROM seg)", _edges("t", 20, "".join(T.PRIMARY_BREAKS), "".join(T.SECONDARY_BREAKS), 3, 0)])
        + """SELECT media_id, seg_idx, CASE WHEN length(text) <= 20 THEN text ELSE (SELECT string_agg(substr(p.text, p.p + 1, p.q - p.p), chr(10) ORDER BY p.p) FROM piece p WHERE p.media_id = t.media_id AND p.seg_idx = t.seg_idx) END AS wrapped FROM t""",
        "char_split": "WITH RECURSIVE " + ",".join([_LINES, f"t AS (SELECT * REPLACE ({_strip('text')} AS text) FROM seg)", _edges("t", 30, "".join(PRIMARY), ", ", 10, 5)])
        + """,
out AS (
  SELECT media_id, seg_idx, 0 AS p, s, e, text FROM t WHERE length(text) <= 30
  UNION ALL
  SELECT media_id, seg_idx, p, s + (e - s) * (p::DOUBLE / length(t.text)), least(s + (e - s) * (q::DOUBLE / length(t.text)), e), substr(t.text, p + 1, q - p) FROM piece JOIN t USING (media_id, seg_idx))
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY seg_idx, p) - 1)::INT AS seg_idx, round(s, 6) AS start, round(e, 6) AS "end", text, 0 AS n_words FROM out""",
        "word_split": _word_pieces(60) + """
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY seg_idx, piece) - 1)::INT AS seg_idx, round(s, 6) AS start, round(e, 6) AS "end", text, n::INT AS n_words FROM out""",
        "revalidate_timing": _word_pieces(40)
        + f""",
cutp AS (SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY seg_idx, piece) - 1)::INT AS seg_idx, s, e, text FROM out),
late AS (SELECT media_id, seg_idx, greatest(0::DOUBLE, s + (seg_idx % 5 - 2) * 0.6::DOUBLE) AS s, e + (seg_idx % 5 - 2) * 0.6::DOUBLE AS e, text FROM cutp),
flag AS (SELECT *, coalesce(length(text) / nullif(e - s, 0) > 14 OR (length(text) / nullif(e - s, 0) < 1 AND length(text) > 5), false) AS again FROM late WHERE e > s),
heard AS (SELECT f.media_id, f.seg_idx, {_strip("string_agg(word, '' ORDER BY w.a, w.b, word)")} AS new, count(*) AS n FROM flag f JOIN word w ON w.media_id = f.media_id AND w.a < f.e AND w.b > f.s WHERE f.again AND f.e - f.s >= 0.1 GROUP BY f.media_id, f.seg_idx),
kept AS (SELECT f.media_id, f.seg_idx, s, e, CASE WHEN NOT again OR e - s < 0.1 THEN text ELSE new END AS text, CASE WHEN again AND e - s >= 0.1 THEN h.n ELSE 0 END AS k FROM flag f LEFT JOIN heard h ON h.media_id = f.media_id AND h.seg_idx = f.seg_idx WHERE NOT again OR e - s < 0.1 OR new <> '')
"""
        + _OUT.format("k::INT", "kept"),
        "gap_fill_worded": _with(
            _TURNS,
            f"shown AS (SELECT media_id, seg_idx, s + 0.25::DOUBLE AS s, e, {_strip('text')} AS text, seg_idx % 2 = 1 AS worded FROM seg WHERE {_strip('text')} <> '')",
            "cued AS (SELECT media_id, row_number() OVER w AS cue, CASE WHEN worded THEN s ELSE coalesce(lag(e) OVER w, s) END AS s, e, text FROM shown WINDOW w AS (PARTITION BY media_id ORDER BY seg_idx))",
        )
        + _CUED,
        "second_look": _with(
            _TURNS,
            _WORDED,
            "late AS (SELECT media_id, seg_idx, greatest(0::DOUBLE, s + (seg_idx % 5 - 2) * 0.6::DOUBLE) AS s, e + (seg_idx % 5 - 2) * 0.6::DOUBLE AS e, text, CASE WHEN seg_idx % 2 = 0 THEN len(regexp_extract_all(text, '[^ ]* |[^ ]+$')) ELSE 0 END AS n FROM seg)",
            "flag AS (SELECT *, coalesce(length(text) / nullif(e - s, 0) > 14, false) OR (e - s < 0.3 AND length(text) > 5) OR (n = 0 AND length(text) > 10) AS again FROM late)",
            f"heard AS (SELECT f.media_id, f.seg_idx, {_strip('string_agg(word, chr(0) ORDER BY w.a, w.b, word)')} AS new, count(*) AS n FROM flag f JOIN word w ON w.media_id = f.media_id AND w.a < f.e AND w.b > f.s WHERE f.again AND f.e - f.s >= 0.1 GROUP BY f.media_id, f.seg_idx)".replace("chr(0)", "''"),
            "out AS (SELECT f.media_id, f.seg_idx, s, e, CASE WHEN NOT again OR e - s < 0.1 THEN text ELSE new END AS text, CASE WHEN NOT again THEN f.n WHEN e - s < 0.1 THEN 0 ELSE h.n END AS k FROM flag f LEFT JOIN heard h ON h.media_id = f.media_id AND h.seg_idx = f.seg_idx WHERE NOT again OR e - s < 0.1 OR new <> '')",
        )
        + _OUT.format("k::INT", "out"),
        "reindexed": _with(_EVENTS) + "SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) - 1)::INT AS seg_idx, text FROM seg WHERE text <> 'view'",
    }
