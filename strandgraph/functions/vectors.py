"""Vectors as arrays of double: norms, similarity and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The unit vector; null for a zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(store: DataFrame, query: DataFrame, k: int = 8, floor: float = 0.30, model: str | None = None) -> DataFrame:
    """The k nearest rows of store (node_id, vector) to the one row of query (vector), by cosine.

    The query is a single row and is sent to every task; each task keeps k rows, so the store is
    read once and nothing else is shuffled. Ties go to the lesser id. With a model name, both sides
    must have been embedded by it (column model).
    """
    if model is not None:
        store = store.where(F.col("model") == model)
    one = query.limit(1).select(F.col("vector").alias("query_vector"))
    scored = store.crossJoin(F.broadcast(one)).withColumn("score", cosine(F.col("vector"), F.col("query_vector")))
    return scored.where(F.col("score") >= floor).orderBy(F.desc("score"), "node_id").limit(k).drop("vector", "query_vector")
