"""Runs that can be taken up again: media items in portions, with a log of what is done."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.operators.cues import vtt_files
from cuewise.plans.pipeline import Pipeline
from cuewise.sources.hadoop import Folder, write_files

STATUS = "media_id string, status string, error string, at double"
PORTIONS = 8


def log_of(path: str) -> str:
    """The log of the runs that write below ``path``: a folder beside it."""
    return f"{path.rstrip('/')}.status"


def statuses(spark, path: str) -> DataFrame:
    """(media_id, status, error, at): the last word on each media item that a run below ``path`` has met; status is done or failed."""
    if not Folder(spark, log_of(path)).names():
        return spark.createDataFrame([], STATUS)
    last = F.max_by(F.struct("status", "error", "at"), "at").alias("s")
    return spark.read.schema(STATUS).json(log_of(path)).groupBy("media_id").agg(last).select("media_id", "s.*")


def run(pipeline: Pipeline, segments: DataFrame, path: str, portions: int = PORTIONS) -> DataFrame:
    """Writes each media item's file below ``path`` and returns ``statuses``. Items that are done already are left out.

    Items are dealt out to ``portions`` by a hash of their id. A portion's files appear together, then its lines in the log; a
    run that is killed loses the portion at hand alone. An item whose recognition failed (a row without times) is logged
    as failed and tried again next time. If a portion fails as a whole, its items are logged as failed and the next one begins.
    """
    spark = segments.sparkSession
    done = statuses(spark, path).where("status = 'done'").select("media_id")
    todo = segments.join(done, "media_id", "left_anti")
    for k in range(portions):
        own = todo.where(F.pmod(F.xxhash64("media_id"), F.lit(portions)) == k)
        heard = F.count_if(F.col("start").isNotNull()) > 0
        items = own.groupBy("media_id").agg(heard.alias("heard"))
        error = None
        try:
            write_files(vtt_files(pipeline.cues(own.where("start is not null"))), path)
        except Exception as failure:  # one portion must not keep the others from being written
            error = f"{type(failure).__name__}: {failure}"[:2000]
        why = F.lit(error) if error else F.when(~F.col("heard"), "nothing was recognised")
        log = items.select("media_id", F.when(why.isNull(), "done").otherwise("failed").alias("status"), why.cast("string").alias("error"), F.lit(time.time()).alias("at"))
        log.write.mode("append").json(log_of(path))
    return statuses(spark, path)
