"""Pieces that the operators of this subpackage share: durable tables, ordered bins, fixed conventions.

``ASCII_SPACE`` and ``fold_ascii`` state the word convention once: words are maximal runs of bytes
other than 0x20 and 0x09-0x0D after lower-casing A-Z only. On UTF-8 bytes, Python's
``bytes.lower().split()`` does just that.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.sources.tables import spread

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
LOWEST = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over all cores where the table comes in fewer partitions."""
    return spread(table(spark, sf_dir, "documents"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one where it is unset and Spark is local."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="cuewise-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held


def durable(df: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation of what stands above. The folder is removed when the
    application's file systems close; that of ``replaced``, a durable table that nothing but ``df`` is made from, at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(at)
    if replaced is not None:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(replaced.durable_path), True)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["durable_path"] = path
    return out


def order_key(column: str) -> Column:
    """A never-null ordering key of an integer column; null ranks lowest."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LOWEST))


#: The most bins that one table is cut into: what the driver holds of them is bounded, and beyond it bins get larger.
MAX_BINS = 1 << 14
#: A key with more than this share of all rows is hot: there are fewer than 1 / HOT_SHARE of them, so a table of them is small.
HOT_SHARE = 1 / 2048


def range_bins(df: DataFrame, column: str, rows_per_bin: int, tie: Column) -> DataFrame:
    """Adds ``bin`` (int): consecutive ranges of (``column``, ``tie``) of about ``rows_per_bin`` rows.

    ``column`` is a long; ``tie`` a double in [0, 1) that is spread evenly, as of a hash, and orders equal values. The bounds are quantiles of
    the column, so the bins are even whatever its distribution; a value that fills bins by itself (as null ids do) is cut
    by ``tie`` into even parts. Bounds are literals, MAX_BINS at most, so a recomputed task finds the same bins.
    Rows that are equal in both stay in one bin.
    """
    from pyspark.ml.feature import Bucketizer

    n = df.count()
    bins = min(MAX_BINS, max(1, math.ceil(n / rows_per_bin)))
    bounds = sorted(set(df.approxQuantile(column, [i / bins for i in range(1, bins)], min(0.05, 0.2 / bins)))) if bins > 1 else []
    at = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__at", outputCol="__bin") if bounds else None
    rows = df.withColumn("__at", F.col(column).cast("double"))
    rows = (at.transform(rows) if at else rows.withColumn("__bin", F.lit(0.0))).withColumn("__tie", tie)
    # The values that fill a bin are its lowest: quantiles repeat them.
    own = F.min("__at")
    counts = rows.groupBy("__bin").agg(own.alias("low"), F.count("*").alias("c")).toPandas().sort_values("__bin")
    share, first, parts = max(1, math.ceil(n / bins)), 0, []
    for r in counts.itertuples():
        k = max(1, min(bins, round(r.c / share)))
        parts.append((float(r[1]), float(r.low), k, first))
        first += k + (k > 1)
    if not parts:
        return df.withColumn("bin", F.lit(0))
    cut = df.sparkSession.createDataFrame(parts, "__bin double, __low double, __k int, __first int")
    within = F.floor(F.col("__tie") * F.col("__k")).cast("int")
    sub = F.when(F.col("__k") == 1, 0).when(F.col("__at") == F.col("__low"), F.least(F.greatest(within, F.lit(0)), F.col("__k") - 1)).otherwise(F.col("__k"))
    return rows.join(F.broadcast(cut), "__bin").withColumn("bin", F.col("__first") + sub).select(*df.columns, "bin")


def even(hashed: Column) -> Column:
    """A hash (long) as a double in [0, 1], in the same order."""
    return hashed.cast("double") / 2.0**64 + 0.5


def first_rows(df: DataFrame, n: int, *order: Column | str) -> list:
    """The first ``n`` rows of ``df`` in an order, and no others, at the driver.

    An ordered limit would send the first n of every partition. Here a range sort is written, and rows are taken by their number.
    """
    ranked = durable(df.orderBy(*order).withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright("__row", 33)
    sizes = sorted((r["p"], r["c"]) for r in ranked.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
    bound = -1
    for p, c in sizes:
        if n <= 0:
            break
        bound = (p << 33) + min(c, n) - 1
        n -= c
    found = ranked.where(F.col("__row") <= bound).collect()
    return sorted(found, key=lambda r: r["__row"])


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group in ``groups`` (one row a ``key``, with its number of rows in ``size``).

    Groups of more than HOT_SHARE of ``total`` rows, fewer than 1 / HOT_SHARE, are broadcast, so that their rows stay where
    they are; the others are joined by key, and no task gets more than that share of one.
    """
    hot = groups.where(F.col(size) > total * HOT_SHARE)
    keys = hot.select(key)
    many = rows.join(F.broadcast(hot), key)
    few = rows.join(F.broadcast(keys), key, "left_anti").join(groups.where(F.col(size) <= total * HOT_SHARE), key)
    return many.unionByName(few)


def fold_ascii(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(buckets: int, doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text leaves 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % buckets == 2
