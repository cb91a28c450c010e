"""Details of failures that a pass leaves in its rows, written aside without a second pass."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: stage, and the number of the batch or segment; what was asked, what came back, and why it was no good.
DETAILS = "array<struct<stage:string,item:int,prompt:string,raw:string,error:string>>"


def set_aside(df: DataFrame, folder: str, column: str = "details") -> DataFrame:
    """``df`` without ``column``, whose entries go to ``folder``/errors as JSON lines (media_id, stage, item, prompt, raw, error).

    The rows are written once, below ``folder``, and both come from there: whatever made them does not run again, so a model
    is not asked twice. Any path that Spark can write to.
    """
    rows_at = f"{folder.rstrip('/')}/rows/{uuid.uuid4().hex}"
    df.write.parquet(rows_at)
    rows = df.sparkSession.read.schema(df.schema).parquet(rows_at)
    errors = rows.select("media_id", F.explode(column).alias("e")).select("media_id", "e.*")
    errors.write.mode("append").json(f"{folder.rstrip('/')}/errors")
    return rows.drop(column)


def read_errors(spark, folder: str) -> DataFrame:
    return spark.read.schema("media_id string, stage string, item int, prompt string, raw string, error string").json(f"{folder.rstrip('/')}/errors")
