"""Streams: order, lateness and restarts."""

import json
import os

import pytest

from cuewise.sources import vtt
from cuewise.streaming import segments as streams

SCHEMA = "media_id string, ts timestamp, start double, end double, text string"


def second(media, i, text):
    return {"media_id": media, "ts": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "start": float(i), "end": i + 1.0, "text": text}


def put(folder, number, *rows):
    path = folder / f"{number:03d}.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def runs(spark, folder, state, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    query = streams.collapse_in_order(stream, "5 seconds", "60 seconds").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return sorted((r["media_id"], r["start"], r["end"], r["text"], r["n"]) for r in spark.read.schema(streams.RUN).parquet(str(out)).collect())


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_runs_of_rows_in_any_order_over_a_restart(spark, tmp_path, store):
    folder, state, out = tmp_path / "in", tmp_path / "state", tmp_path / "out"
    folder.mkdir()
    put(folder, 1, second("m", 1, "a"), second("m", 0, "a"), second("m", 3, "b"))
    put(folder, 2, second("m", 2, "a"), second("m", 12, "b"))  # 2 comes after 3, but in time
    put(folder, 3, second("m", 4, "late"), second("n", 20, "x"))  # 4 is later than the watermark allows
    got = runs(spark, folder, state, out)
    assert got == [("m", 0.0, 3.0, "a", 3)]
    put(folder, 4, second("m", 30, "b"), second("m", 31, "c"))
    put(folder, 5, second("z", 200, "end"))
    put(folder, 6, second("z", 201, "end"))
    got = runs(spark, folder, state, out)
    assert [r for r in got if r[0] != "z"] == [("m", 0.0, 3.0, "a", 3), ("m", 3.0, 31.0, "b", 3), ("m", 31.0, 32.0, "c", 1), ("n", 20.0, 21.0, "x", 1)]


def test_files_are_streamed_once(spark, segments, tmp_path):
    folder, state, out = str(tmp_path / "vtt"), str(tmp_path / "state"), str(tmp_path / "out")
    vtt.write_vtt(segments((0, 1, "one"), (1, 2, "two"), media="a"), folder)

    def read():
        query = spark.readStream.format("webvtt").load(folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r["media_id"], r["cue"], r["text"]) for r in spark.read.schema(vtt.CUES).parquet(out).collect())

    assert read() == [("a", 1, "one"), ("a", 2, "two")]
    assert read() == [("a", 1, "one"), ("a", 2, "two")]
    vtt.write_vtt(segments((0, 1, "three"), media="b"), folder)
    assert read() == [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "three")]
