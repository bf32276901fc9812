"""Shared helpers: reading tables, cutting lineage in the shared folder, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.sources.durable import stored

#: What separates words in every operator here: ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    """The column of just that name, also where it holds dots or quotes."""
    return F.col(f"`{name.replace('`', '``')}`")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are large rows: pass at most so many at a time between the JVM and Python workers.

    A setting of the session, so applications (the registered queries, the pipeline) make it and
    operators don't.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


#: Write as Parquet to the shared folder and read back (see strandgraph.sources.durable).
cut = stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: (node, component), component the least node.

    Alternating large-star and small-star rounds. Every round is two joins on a pre-aggregated
    minimum and is written to the shared folder; a round count near the logarithm of the
    component's diameter suffices. Nodes without edges don't appear; null ends are ignored.
    """
    x, y = F.col(a), F.col(b)
    now = cut(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    last = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        last = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
