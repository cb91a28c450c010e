import json
import os

import pytest
from pyspark.sql import functions as F

from cuewise.config import DEFAULTS, deep_merge, load_config, stage_llm, validate_llm_requirements
from cuewise.operators import models
from cuewise.plans.pipeline import Pipeline
from cuewise.sources import media, vtt
from cuewise.streaming import segments as streams


def test_deep_merge():
    assert deep_merge({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": [2]}, "d": {"e": 1}}) == {"a": {"b": 1, "c": [2]}, "d": {"e": 1}}


def test_load_config(tmp_path, monkeypatch):
    base, local = tmp_path / "c.json", tmp_path / "l.json"
    base.write_text('{"segment_merging": {"max_merge_gap": 1.5}, "llm": {"anthropic": {"api_key": "placeholder"}}}')
    local.write_text('{"segment_merging": {"enable": false}}')
    monkeypatch.setenv("ANTHROPIC_API_KEY", "secret")
    config = load_config(str(base), str(local))
    assert config["segment_merging"]["max_merge_gap"] == 1.5 and config["segment_merging"]["enable"] is False
    assert config["llm"]["anthropic"]["api_key"] == "secret"
    local.write_text("{")
    with pytest.raises(ValueError):
        load_config(str(base), str(local))
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.json"))


def test_stage_llm_and_requirements():
    config = deep_merge(DEFAULTS, {"text_polishing": {"llm_provider": "openai", "llm_timeout": 5}})
    assert stage_llm(config, "text_polishing")["provider"] == "openai" and config["llm"]["provider"] == "none"
    assert validate_llm_requirements(DEFAULTS)
    local = deep_merge(DEFAULTS, {"text_polishing": {"enable": True}, "llm": {"provider": "ollama", "ollama": {"base_url": "http://x"}}})
    assert validate_llm_requirements(local)


def test_pipeline(segments):
    df = segments((0, 1, "行って"), (1.1, 2, "きた"), (2.1, 3, "同じ"), (3.1, 4, "同じ"), (4.1, 5, "やめて" * 6))
    plan = Pipeline({"hallucination_filter": {"consecutive_duplicates": {"enable": True}}})
    assert [r["text"] for r in plan.cues(df).orderBy("cue").collect()] == ["行ってきた", "同じ", "やめて、やめて、やめて..."]
    assert dict(plan.describe())["realign timing"] is False


def test_vtt_round_trip(spark, segments, tmp_path):
    path = str(tmp_path / "out")
    vtt.write_vtt(segments((0, 1, "一行"), (2, 3, ""), (4, 5.5, "二行\nつづき"), media="clip").unionByName(segments((0, 1, "x"), media="other")), path)
    with open(os.path.join(path, "clip.vtt"), encoding="utf-8") as file:
        assert file.read() == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.000\n一行\n\n2\n00:00:01.000 --> 00:00:05.500\n二行\nつづき\n\n"
    vtt.register(spark)
    back = spark.read.format("webvtt").load(path).orderBy("media_id", "cue").collect()
    assert [(r["media_id"], r["cue"], r["start"], r["end"], r["text"]) for r in back] == [("clip", 1, 0.0, 1.0, "一行"), ("clip", 2, 1.0, 5.5, "二行\nつづき"), ("other", 1, 0.0, 1.0, "x")]
    with pytest.raises(Exception, match="FileExists"):
        vtt.write_vtt(segments((0, 1, "x"), media="other"), path, overwrite=False)


def test_discover_media(spark, tmp_path):
    for name in ("b.mp3", "a.wav", "c.txt"):
        (tmp_path / name).write_bytes(b"sound")
    assert [r["media_id"] for r in media.discover_media(spark, str(tmp_path)).collect()] == ["a", "b"]
    listed = media.media_files(spark, [str(tmp_path / "b.mp3"), str(tmp_path / "b.mp3"), str(tmp_path / "none.mp3")])
    assert [r["media_id"] for r in listed.collect()] == ["b"]


def test_prepare_sound_falls_back(spark, tmp_path):
    path = tmp_path / "a.wav"
    path.write_bytes(b"no sound")
    assert media.normalise(str(path), -6.0, str(tmp_path)) == str(path) and os.listdir(tmp_path) == ["a.wav"]


def test_read_transcripts(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"media_id": "m", "segments": [{"start": 0, "end": 1.5, "text": "a", "words": None}, {"start": 2, "end": 3, "text": "b", "words": [{"word": "b", "start": 2, "end": 3}]}]}]))
    rows = media.read_transcripts(spark, str(tmp_path)).orderBy("seg_idx").collect()
    assert [(r["seg_idx"], r["start"], r["text"], len(r["words"])) for r in rows] == [(0, 0.0, "a", 0), (1, 2.0, "b", 1)]


class Tape:
    def __init__(self, rows):
        pass

    def transcribe(self, name, start, end, words, params):
        if "bad" in name:
            raise OSError(name)
        return {"text": name, "segments": [{"start": 0.0, "end": 1.0, "text": name}]}


def test_transcribe_isolates_failures(spark):
    items = spark.createDataFrame([("a", "/x/a.wav"), ("b", "/x/bad.wav")], "media_id string, path string")
    assert sorted((r["media_id"], r["text"]) for r in media.transcribe(items, Tape, {}).collect()) == [("a", "/x/a.wav"), ("b", "")]


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [{"media_id": "m", "ts": f"2024-01-01T00:00:{i:02d}Z", "start": float(i), "end": i + 1.0, "text": t} for i, t in enumerate(["あ", "あ", "い", "い", "い", "う"])]
    (source / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    stream = spark.readStream.schema("media_id string, ts timestamp, start double, end double, text string").json(str(source))
    query = streams.collapse_duplicates(stream).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["text"], r["end"], r["n"]) for r in spark.table("runs").orderBy("start").collect()] == [("あ", 2.0, 2), ("い", 5.0, 3)]
    batch = spark.read.schema(stream.schema).json(str(source))
    assert {r["token"] for r in streams.recurring_words(batch, window="10 seconds", slide="10 seconds", least=3).collect()} == {"い"}


@pytest.mark.parametrize("name", ["dup_collapse_events", "merge_incomplete_lines", "cluster_words", "stammer_flags", "subtitle_pipeline", "word_split", "revalidate_timing", "model_split"])
def test_queries_run(spark, name):
    from cuewise.plans.queries import queries

    out = queries()[name](spark, "/root/testdata/sf0.001")
    assert out.where(F.lit(True)).count() >= 0 and len(out.columns) >= 2


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_spoken_turns_are_whole(spark):
    from cuewise.plans import queries

    sf = "/root/testdata/sf0.001"
    letters = lambda df: {r["media_id"]: r["n"] for r in df.groupBy("media_id").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("n")).collect()}
    rows, truth = queries._spoken(spark, sf)
    want = letters(queries.turns(spark, sf))
    assert letters(rows) == want == letters(truth.select("media_id", F.col("word").alias("text")))


def test_command_line(spark, tmp_path, capsys):
    import json

    from cuewise.__main__ import main

    rows = [{"media_id": m, "segments": [{"start": 0.0, "end": 2.0, "text": "hello there", "words": [{"word": "hello", "start": 0.0, "end": 1.0}]}]} for m in ("a", "b")]
    (tmp_path / "in.json").write_text(json.dumps(rows))
    (tmp_path / "config.json").write_text(json.dumps({"whisper": {"beam_size": 2}, "segment_merging": {"enable": False}}))
    out = tmp_path / "out"
    status = main([str(tmp_path / "none.json"), str(tmp_path / "in.json"), "--config", str(tmp_path / "config.json"), "--output-dir", str(out)])
    assert status == 1 and sorted(p.name for p in out.iterdir()) == ["a.vtt", "b.vtt"] and "hello there" in (out / "a.vtt").read_text()
    assert "off merge incomplete segments" in capsys.readouterr().out
    assert main([str(tmp_path / "in.json"), "--config", str(tmp_path / "absent.json")]) == 1


def test_configuration_takes_the_other_name_of_the_recogniser():
    from cuewise.plans.pipeline import Pipeline

    assert Pipeline({"whisper": {"beam_size": 2}}).config["recogniser"]["beam_size"] == 2
    assert "whisper" not in Pipeline({"whisper": {"beam_size": 2}}).config


def test_each_pair_is_compared_once(spark):
    from cuewise.plans.queries import queries

    plan = queries()["similarity_neighbours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_counters_are_recounts(segments):
    from cuewise.plans.counters import Counters

    df = segments(*[(i, i + 0.5, t) for i, t in enumerate(["行って", "きた", "同じ", "同じ", "ああ", "悪い文", "僕", "僕", "x" * 90, "終わり"])])
    config = {"hallucination_filter": {"phrase_filter": {"enable": True, "patterns": ["悪い"]}, "consecutive_duplicates": {"enable": True}, "timing_validation": {"enable": True}}, "segment_splitting": {"enable": False}}
    counters = Counters()
    out = Pipeline(config, counters=counters).transform(df).collect()
    steps = {r["step"]: r for r in counters.summary()}
    assert list(steps) == ["input", "merge", "split", "phrases", "duplicates", "single characters", "timing", "again", "stammers"]
    assert steps["input"]["rows"] == 10 and steps["input"]["seconds"] == 5.0 and steps["stammers"]["rows"] == len(out)
    assert steps["phrases"]["removed"] == 1 and steps["duplicates"]["removed"] == 2 and steps["timing"]["removed"] == 1
    assert steps["timing"]["characters_changed"] == -90 and steps["input"]["rows"] - sum(r.get("removed", 0) for r in steps.values()) == len(out)
    assert steps["stammers"]["characters"] == sum(len(r["text"]) for r in out)


class Mute:
    """Answers batches with prose, and counts its questions in a folder."""

    def __init__(self, folder):
        self.folder = folder

    def generate(self, prompt, max_tokens=0, temperature=0.0):
        import uuid

        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        return "no idea" if "\n2. " in prompt else models.StubTextModel().generate(prompt)


def test_broken_answers_can_be_read_back(spark, segments, tmp_path):
    from cuewise.sources.details import read_errors

    asked = tmp_path / "asked"
    asked.mkdir()
    df = segments((0, 1, "aa"), (2, 3, "bb"), (4, 5, "cc"))
    config = {"text_polishing": {"enable": True, "batch_size": 2}, "segment_merging": {"enable": False}, "hallucination_filter": {"timing_validation": {"enable": False}}}
    out = Pipeline(config, model=lambda: Mute(str(asked)), details=str(tmp_path / "d")).transform(df)
    assert sorted(r["text"] for r in out.collect()) == ["AA", "BB", "CC"] and out.count() == 3
    errors = read_errors(spark, str(tmp_path / "d")).collect()
    assert [(r["media_id"], r["stage"], r["item"], r["raw"]) for r in errors] == [("m", "text_polishing", 0, "no idea")]
    assert "1. aa\n2. bb" in errors[0]["prompt"] and "no list" in errors[0]["error"]
    assert len(os.listdir(asked)) == 4  # two batches, and two texts by themselves: no second run


def test_one_model_a_task_and_batches_over_frames(spark, segments):
    from cuewise.operators import polish

    made = spark.sparkContext.accumulator(0)

    def model():
        made.add(1)
        return models.StubTextModel()

    df = segments(*[(i, i + 1, f"t{i}") for i in range(95)]).unionByName(segments((0, 1, "z"), media="n"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = sorted(polish.polish_segments(df, model, 10).collect(), key=lambda r: (r["media_id"], r["seg_idx"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["text"] for r in rows] == [f"T{i}" for i in range(95)] + ["Z"] and made.value <= 4
    assert all(r["error"] is None and r["details"] == [] for r in rows)


def test_recurring_words_in_one_pass(spark, segments):
    import random

    from cuewise.operators import cleanup

    rng = random.Random(3)
    df = segments(*[(t := rng.randrange(400), t + 1, rng.choice(["僕", "あ", "うん うん", "long token", "僕 あ", "", "ねえ", None])) for _ in range(160)])
    for total, close in ((12, None), (None, 4), (20, 6), (None, 2)):
        config = {"vocalization_replacement": {}}
        two = cleanup.rewrite_recurring_words(df, cleanup.recurring_words(df, total, close, 30.0), config)
        one = cleanup.rewrite_recurring(df, config, total, close, 30.0)
        get = lambda d: sorted((r["seg_idx"], r["text"]) for r in d.collect())
        assert get(one) == get(two)
    final = cleanup.final_cleanup(df, {"global_word_filter": {"enable": True}, "cluster_filter": {"enable": True}})
    plan = final._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan


def test_files_through_hadoop(spark, segments, tmp_path):
    path = f"file://{tmp_path}/out"
    df = segments((0, 1, "a"), media="x/y=1:2 %").unionByName(segments((0, 1, "b\n"), media="z"))
    vtt.write_vtt(df, path)
    assert sorted(os.listdir(tmp_path / "out")) == ["x_y=1:2 %.vtt", "z.vtt"]
    vtt.write_vtt(df, str(tmp_path / "local"))
    for name in ("x_y=1:2 %.vtt", "z.vtt"):
        assert (tmp_path / "out" / name).read_bytes() == (tmp_path / "local" / name).read_bytes()
    vtt.write_vtt(segments((0, 1, "c"), media="z"), path)
    assert "\nc\n" in (tmp_path / "out" / "z.vtt").read_text()
    with pytest.raises(FileExistsError):
        vtt.write_vtt(segments((0, 1, "d"), media="z"), path, overwrite=False)
    assert sorted(os.listdir(tmp_path / "out")) == ["x_y=1:2 %.vtt", "z.vtt"]
    assert "\nc\n" in (tmp_path / "out" / "z.vtt").read_text() and not [n for n in os.listdir(tmp_path / "out") if n.startswith(".stage")]
    with pytest.raises(Exception, match="broken"):
        vtt.write_vtt(df.withColumn("text", F.raise_error(F.lit("broken"))), path)
    assert not [n for n in os.listdir(tmp_path / "out") if n.startswith(".stage")]


def test_failed_attempts_leave_no_files(tmp_path):
    def rows():
        yield {"media_id": "a", "content": "x"}
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        vtt._Writer(str(tmp_path), True).write(rows())
    assert os.listdir(tmp_path) == []


def test_runs_are_taken_up_again(spark, segments, tmp_path, monkeypatch):
    from functools import reduce

    from cuewise.plans import runs

    path = f"file://{tmp_path}/out"
    df = reduce(lambda a, b: a.unionByName(b), [segments((0, 1, f"text {i}"), media=f"m{i}") for i in range(9)])
    own, calls = runs.write_files, []

    def dying(rows, at):
        calls.append(sorted(r["media_id"] for r in rows.select("media_id").collect()))
        if len(calls) == 3:
            raise KeyboardInterrupt
        return own(rows, at)

    monkeypatch.setattr(runs, "write_files", dying)
    with pytest.raises(KeyboardInterrupt):
        runs.run(Pipeline({}), df, path, 4)
    written = {n for n in os.listdir(tmp_path / "out") if n.endswith(".vtt")}
    first = {r["media_id"] for r in runs.statuses(spark, path).collect()}
    assert {f"{m}.vtt" for m in first} == written and 0 < len(written) < 9
    status = runs.run(Pipeline({}), df, path, 4).collect()
    assert {r["media_id"]: r["status"] for r in status} == {f"m{i}": "done" for i in range(9)}
    again = [m for c in calls[3:] for m in c]
    assert not first & set(again) and len(again) + len(first) == 9
    assert {n for n in os.listdir(tmp_path / "out") if n.endswith(".vtt")} == {f"m{i}.vtt" for i in range(9)}


def test_media_from_the_command_line(spark, tmp_path, capsys):
    from cuewise.__main__ import main

    for name in ("a/clip.wav", "a/clip.mp3", "a/deep/other.wav", "a/bad.wav", "a/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"sound")
    out = tmp_path / "out"
    given = [str(tmp_path / "a"), "--recogniser", "test_plans:Tape", "--recursive", "--output-dir", f"file://{out}", "--portions", "2"]
    assert main(given) == 1
    names = sorted(n for n in os.listdir(out) if n.endswith(".vtt"))
    assert len(names) == 3 and names[2] == "other.vtt" and all(n.startswith("clip-") for n in names[:2])
    shown = capsys.readouterr().out
    assert "3 done" in shown and "1 failed" in shown
    assert main([str(tmp_path / "none"), "--recogniser", "test_plans:Tape", "--output-dir", f"file://{out}"]) == 1
    assert main([]) == 1 and main(["x", "--recogniser", "no.such:thing"]) == 1
