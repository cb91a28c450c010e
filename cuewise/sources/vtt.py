"""WebVTT as a Spark data source: one file for each media item, and back.

``register(spark)`` makes ``df.write.format("webvtt")``, ``spark.read.format("webvtt")`` and ``spark.readStream.format("webvtt")`` known. Paths are
local or mounted ones, as seen by the executors; ``write_vtt`` writes to any file system that Spark knows.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cuewise.operators.cues import vtt_cues, vtt_files
from cuewise.sources.hadoop import file_name, write_files

CUES = "media_id string, cue int, start double, end double, text string"
_TIMING = re.compile(r"^(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3}) --> (?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})")


def seconds(hours: str | None, minutes: str, secs: str, millis: str) -> float:
    return int(hours or 0) * 3600 + int(minutes) * 60 + int(secs) + int(millis) / 1000


def parse_vtt(content: str) -> Iterator[tuple[int, float, float, str]]:
    """(cue, start, end, text) of each cue; cues without a number are counted."""
    number = 0
    for block in re.split(r"\n\s*\n", content.replace("\r\n", "\n")):
        lines = block.strip("\n").split("\n")
        at = next((i for i, line in enumerate(lines) if _TIMING.match(line)), None)
        if at is None:
            continue
        number = int(lines[at - 1]) if at and lines[at - 1].strip().isdigit() else number + 1
        found = _TIMING.match(lines[at]).groups()
        yield number, seconds(*found[:4]), seconds(*found[4:]), "\n".join(lines[at + 1 :])


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.endswith(".vtt")]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as file:
            content = file.read()
        name = os.path.splitext(os.path.basename(partition.path))[0]
        for cue in parse_vtt(content):
            yield (name, *cue)


class _StreamReader(DataSourceStreamReader):
    """Files in order of their time of change and name; an offset is the last file read. Contents are read in tasks."""

    def __init__(self, path: str) -> None:
        self.files = _Reader(path)

    def _listed(self) -> list[tuple[int, str]]:
        return sorted((os.stat(f.path).st_mtime_ns, f.path) for f in self.files.partitions())

    def initialOffset(self) -> dict:
        return {"at": 0, "path": ""}

    def latestOffset(self) -> dict:
        listed = self._listed()
        return {"at": listed[-1][0], "path": listed[-1][1]} if listed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_File]:
        after, last = (start["at"], start["path"]), (end["at"], end["path"])
        return [_File(path) for at, path in self._listed() if after < (at, path) <= last]

    def read(self, partition: _File) -> Iterator[tuple]:
        return self.files.read(partition)


class _Writer(DataSourceWriter):
    """Rows are (media_id, content). Files appear under their names, or replace earlier ones, only in ``commit``."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> _Written:
        os.makedirs(self.path, exist_ok=True)
        done: list[str] = []
        try:
            self._stage(rows, done)
        except BaseException:
            _remove(done)  # no one else hears of a failed attempt's files
            raise
        return _Written(done)

    def _stage(self, rows: Iterator, done: list[str]) -> None:
        for row in rows:
            final = os.path.join(self.path, f"{file_name(row['media_id'])}.vtt")
            if os.path.exists(final) and not self.overwrite:
                raise FileExistsError(final)
            part = f"{final}.{uuid.uuid4().hex}.part"
            done.append(part)
            with open(part, "w", encoding="utf-8", newline="\n") as file:
                file.write(row["content"])

    def commit(self, messages: list) -> None:
        for message in messages:
            for part in message.files if message else []:
                os.utime(part)  # streams read files in order of their time
                os.replace(part, re.sub(r"\.[0-9a-f]{32}\.part$", "", part))

    def abort(self, messages: list) -> None:
        for message in messages:
            _remove(message.files if message else [])


def _remove(names: list[str]) -> None:
    for name in names:
        if os.path.exists(name):
            os.remove(name)


class VttSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webvtt"

    def schema(self) -> str:
        return CUES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VttSource)


def write_vtt(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """Segments to ``path``/<media_id>.vtt; a path with a scheme goes through Hadoop's file systems."""
    if "://" in path:
        write_files(vtt_files(vtt_cues(df)), path, overwrite=overwrite)
        return
    register(df.sparkSession)
    vtt_files(vtt_cues(df)).write.format("webvtt").mode("overwrite" if overwrite else "append").save(path)
