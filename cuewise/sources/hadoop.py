"""Files of a chosen name through Hadoop's file systems: object stores and whatever else Spark can write to."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_name(media_id: str) -> str:
    return re.sub(r"[/\\\0]", "_", media_id)


class Folder:
    """A folder of any file system that the session knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.at = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.at = self.fs.makeQualified(self.at)
        if self.fs.getScheme() == "file":
            self.fs = self.fs.getRawFileSystem()  # leaves no checksum files beside the others

    def child(self, name: str):
        """Of parts, as a name with a colon would be taken for a scheme."""
        uri = self.at.toUri()
        return self.jvm.org.apache.hadoop.fs.Path(uri.getScheme(), uri.getAuthority(), f"{uri.getPath().rstrip('/')}/{name}")

    def names(self, below: str = "") -> list[str]:
        where = self.child(below) if below else self.at
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def move(self, old, new) -> None:
        if self.fs.exists(new):
            self.fs.delete(new, False)
        if not self.fs.rename(old, new):
            raise OSError(f"{old} could not be moved to {new}")


def write_files(rows: DataFrame, path: str, ending: str = ".vtt", overwrite: bool = True) -> int:
    """Rows (media_id, content) to ``path``/<media_id><ending>; how many there were.

    Spark's own writer stages one file a row, so what failed or doubled attempts leave is its committer's to clear; only
    when all tasks are done do the files get their names, one rename each, and the stage goes. Without ``overwrite`` nothing is
    written if a file is there already.
    """
    folder = Folder(rows.sparkSession, path)
    stage = f".stage-{uuid.uuid4().hex}"
    # The writer ends each row with a line feed.
    body = F.regexp_replace("content", r"\n\z", "")
    named = rows.select(F.regexp_replace("media_id", r"[/\\\x00]", "_").alias("name"), body.alias("value"))
    try:
        named.repartition("name").write.partitionBy("name").option("compression", "none").text(f"{folder.path}/{stage}")
        staged = [n for n in folder.names(stage) if n.startswith("name=")]
        spark_name = folder.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        finals = {n: folder.child(spark_name(n.removeprefix("name=")) + ending) for n in staged}
        if not overwrite and (there := next((f for f in finals.values() if folder.fs.exists(f)), None)):
            raise FileExistsError(str(there))
        for n, final in finals.items():
            files = [x for x in folder.names(f"{stage}/{n}") if x.startswith("part-")]
            if len(files) != 1:
                raise ValueError(f"{len(files)} rows for {n}")
            folder.move(folder.child(f"{stage}/{n}/{files[0]}"), final)
        return len(finals)
    finally:
        folder.fs.delete(folder.child(stage), True)
