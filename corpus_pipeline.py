"""The corpus pipeline: quality, near-duplicates, privacy, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each one's result as
Parquet in the shared folder and reads it back as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import mixing, packing, privacy, quality, simhash
from strandgraph.llm.common import cut, small_batches, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade of at least 1 is high enough; trained on `labels`."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    small_batches(spark)
    return simhash.keep_one(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    small_batches(spark)
    done = privacy.replace(docs, privacy.release_key(spark))
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("privacy", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Trained weights and token ids have no SQL form; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
