"""Media items and their transcripts: discovery, preparation of sound, and recognition as a scan."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewise.operators.models import RecogniserFactory
from cuewise.schema import SEGMENT, as_segments, reindex

#: File endings of sound and video.
ENDINGS = ("wav", "mp3", "m4a", "flac", "ogg", "aac", "wma", "opus", "mp4", "avi", "mkv", "mov", "wmv", "flv", "webm", "m4v")


def discover_media(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(media_id, path) of the media files of a folder, each once, by path; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").option("recursiveFileLookup", recursive).load(folder)
    return _named(files.select("path")).orderBy("path")


def media_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same for a list of paths, without those that don't exist."""
    rows = [(p,) for p in sorted({*paths}) if os.path.exists(p)]
    return _named(spark.createDataFrame(rows, "path string")).orderBy("path")


def _named(paths: DataFrame) -> DataFrame:
    """Items go by the name of their file without its ending; those that share one by it and a hash of their path."""
    stem = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    named = paths.distinct().withColumn("stem", stem)
    shared = F.count("*").over(Window.partitionBy("stem")) > 1
    return named.select(F.when(shared, F.concat("stem", F.lit("-"), F.lower(F.hex(F.xxhash64("path"))))).otherwise(F.col("stem")).alias("media_id"), "path")


def prepare_sound(media: DataFrame, loudness: float = -6.0, folder: str | None = None) -> DataFrame:
    """``media`` with ``prepared``: a normalised 16 kHz mono copy made by ffmpeg, or the path itself if that fails.

    ``folder`` is one that all executors see; on a cluster it must be given, as other tasks open the copies.
    """
    if folder is None and not media.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(prepared=[normalise(p, loudness, folder) for p in frame["path"]])

    return media.mapInPandas(run, "media_id string, path string, prepared string")


def normalise(path: str, loudness: float, folder: str | None = None) -> str:
    handle, out = tempfile.mkstemp(suffix=".wav", dir=folder)
    os.close(handle)
    command = ["ffmpeg", "-y", "-i", path, "-af", f"loudnorm=I={loudness}:LRA=11:TP=-1.5", "-ar", "16000", "-ac", "1", "-c:a", "pcm_s16le", out]
    try:
        subprocess.run(command, check=True, capture_output=True)
        return out
    except (OSError, subprocess.CalledProcessError):
        os.remove(out)
        return path


def transcribe(media: DataFrame, recogniser: RecogniserFactory, params: dict) -> DataFrame:
    """Segments of each media item (media_id, path); the recogniser gets its path and hears all of it.

    An item that fails gives one row without times whose text is empty, which no later stage writes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = recogniser(None)
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                try:
                    heard = own.transcribe(r.path, 0.0, float("inf"), True, params)["segments"]
                except Exception:  # one broken file must not end the others
                    heard = [{"start": None, "end": None, "text": ""}]
                rows += [(r.media_id, i, s["start"], s["end"], s["text"], list(s.get("words") or [])) for i, s in enumerate(heard)]
            yield pd.DataFrame(rows, columns=["media_id", "seg_idx", "start", "end", "text", "words"])

    return media.mapInPandas(run, SEGMENT)


def read_transcripts(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Segments from a table of transcripts: rows (media_id, segments: array<struct<start, end, text, words>>)."""
    raw = spark.read.format(kind).option("multiLine", True).load(path) if kind == "json" else spark.read.format(kind).load(path)
    rows = raw.select("media_id", F.posexplode("segments").alias("seg_idx", "s")).select("media_id", "seg_idx", "s.*")
    return reindex(as_segments(rows))
