"""The corpus pipeline: five stages over the documents of a folder, each an operator of cuewise.llm.

Each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuewise.llm import decontamination, language_id, mixing, near_copies, sharding
from cuewise.llm.common import durable, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language hyperdimensional profiles can tell; those without letters go.

    Null and empty texts have no letters; a null doc_id and repeated rows stay or go by their texts; very long texts are read
    whole; with nothing to learn from only texts without letters go; an empty table stays empty; other columns pass through.
    """
    return language_id.identified_documents(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a five-word Jaccard similarity of 0.8 or more stays, that with the smallest doc_id.

    Texts without words (null, empty) are one group; null doc_ids rank last; of repeated rows one stays; very long texts have all
    their shingles; an empty table stays empty; other columns pass through.
    """
    return near_copies.one_of_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Null and empty texts hold none; a null doc_id and repeated rows stay or go by their texts; very long texts are searched
    whole; with an empty benchmark all stay; an empty table stays empty; other columns pass through.
    """
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it whole.

    A text without words (null, empty) is never taken; a null source is one of its own; null doc_ids hash as the empty text;
    rows that tie with a source's boundary are all taken; very long texts count whole; an empty table stays empty; other
    columns pass through.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row.

    Null and empty texts are one group; null doc_ids rank first; repeated rows, which the mix makes, are rows of one group; very
    long texts count whole; an empty table gives an empty result; other columns are ignored.
    """
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_identified),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: SQL expresses neither the language profiles nor the latent semantic search: brute-force tests stand in.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
