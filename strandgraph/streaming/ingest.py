"""Incremental ingestion: extraction files as a stream, each batch merged into the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandgraph.operators import incremental
from strandgraph.sources.catalog import Catalog
from strandgraph.sources.durable import stored
from strandgraph.sources.files import mentions
from strandgraph.sources.schemas import EXTRACTION


def extraction_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files {id}.json that hold an extraction and its references."""
    rows = spark.readStream.schema(EXTRACTION + ", builds_on array<string>").json(folder, multiLine=True)
    arrived = F.col("_metadata.file_modification_time")
    return rows.withColumns({"paper_id": F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1), "arrived": arrived})


def ingest(stream: DataFrame, catalog: Catalog, checkpoint: str) -> StreamingQuery:
    """Carry each batch's papers into the stored graph, in one state a batch.

    A replayed batch changes nothing: mentions are keyed by paper and position, and a paper's later
    extraction (by arrival) replaces its earlier one. A batch is read once. The result equals a build
    over all papers in id order; only what the batch changes is resolved anew (operators.incremental).
    """

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        rest = [c for c in batch.columns if c not in ("paper_id", "arrived")]
        last = batch.groupBy("paper_id").agg(F.max_by(F.struct(*rest), F.struct("arrived", F.xxhash64(F.to_json(F.struct(*rest))))).alias("x"))
        batch = stored(last.select("paper_id", "x.*"))
        found = stored(mentions(batch).select(*incremental.RAW))
        incremental.ingest_batch(catalog, found, batch.select("paper_id", "title", "problem", "domain", "paper_type"))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_usage(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls and seconds by stage and window of a (streaming or static) call log (ts, stage, seconds)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("calls"), F.sum("seconds").alias("seconds")).select(F.col("window.start").alias("start"), "stage", "calls", "seconds")
