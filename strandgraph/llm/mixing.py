"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. A source with budget target T and size S takes every document
floor(T / S) times, and the documents whose hash lies below a threshold once more. The threshold
is found from histograms: sizes are summed by (source, hash bucket), the bucket in which the
running sum meets the budget is the boundary, and only that bucket is summed again with finer
buckets, until a bucket is one hash value. Thresholds are nested: a larger budget takes a
superset. Nothing is sorted by document, and every aggregate is combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.llm.common import WORD, column, cut, fresh, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
HASH_BITS, LEVEL_BITS = 60, 10
#: Plans of at most this many sources are broadcast (one row of some 60 bytes a source).
BROADCAST_SOURCES = 100_000


def _hash(id_col: str, text_col: str) -> Column:
    """60 bits of the md5 of the id, or of the text where the id is null."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))), 1, 15), 16, 10).cast("long")


def _source_key(source_col: str) -> Column:
    """The source as a key that isn't null and keeps the order, null last."""
    return F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))


def _small(plan: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan


def targets(sizes: DataFrame) -> DataFrame:
    """(skey, source_size) -> with target: shares by weight, at most MAX_REPEATS times the size.

    The level to which all shares are filled solves sum(min(cap, weight * level)) = total. With
    sources in order of cap / weight it is the largest of (total - caps before) / (weights from
    here on). One row a source goes through the windows, in one task: sources number a fraction of
    what a task sorts, whatever the number of documents.
    """
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = sizes.withColumn("w", F.element_at(weights, ((F.row_number().over(Window.orderBy("skey")) - 1) % len(WEIGHTS) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    caps = ranked.withColumn("cap", MAX_REPEATS * F.col("source_size"))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = caps.withColumn("x", (total - before).cast("double") / onward).withColumn("level", F.max("x").over(Window.partitionBy()))
    return level.select("skey", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))


def plan(sized: DataFrame) -> tuple[DataFrame, int]:
    """Per source (skey): source_size, target, whole repeats q and hash threshold; and how many.

    sized has skey, size and hash. Sources whose documents are all empty take nothing. Documents
    that share a hash (repeated ids) are taken together: the source misses its target by at most
    half of the boundary hash's size.
    """
    state = cut(targets(sized.groupBy("skey").agg(F.sum("size").alias("source_size"))))
    n = state.count()
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(MAX_REPEATS), F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))))).otherwise(0)
    state = state.withColumn("q", whole.cast("long")).withColumn("budget", F.col("target") - F.col("q") * F.col("source_size"))
    state = state.withColumns({"low": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "own": F.col("source_size")})
    known = ["skey", "source_size", "target", "q", "budget"]
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = F.shiftright("hash", shift + LEVEL_BITS) == F.shiftright("low", shift + LEVEL_BITS)
        sums = sized.join(_small(state.select("skey", "low").where("budget > 0"), n), "skey").where(inside).groupBy("skey", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("inner"))
        running = F.sum("inner").over(Window.partitionBy("skey").orderBy("bucket"))
        found = sums.withColumn("run", running).join(_small(state, n), "skey").where("below + run >= budget").groupBy("skey").agg(F.min(F.struct("bucket", "run", "inner")).alias("x"))
        next_state = state.join(_small(found, n), "skey", "left")
        state = cut(next_state.select(*known, F.coalesce(F.shiftleft("x.bucket", shift), F.lit(0)).alias("low"), (F.col("below") + F.coalesce(F.col("x.run") - F.col("x.inner"), F.lit(0))).alias("below"), F.coalesce("x.inner", F.lit(0)).alias("own")))
    closer = (F.col("below") + F.col("own") - F.col("budget")) < (F.col("budget") - F.col("below"))
    return state.select("skey", "source_size", "target", "q", F.when(F.col("budget") <= 0, 0).otherwise(F.col("low") + closer.cast("long")).alias("threshold")), n


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    size counts the words of the text (null: 0), taken is size times the repeats. A null source is
    a source of its own, last in order. Null ids hash by their text, repeated rows are repeated.
    Other columns aren't read. An empty table gives an empty result.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), _source_key(source_col).alias("skey"), words.alias("size"), _hash(id_col, text_col).alias("hash")))
    found, n = plan(sized)
    repeats = F.col("q") + (F.col("hash") < F.col("threshold")).cast("long")
    return sized.join(_small(found, n), "skey").select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (not at all, or up to three times).

    Columns are unchanged, whatever their names; nulls, repeated rows and empty tables as in `mixed`.
    """
    skey, hashed, q, threshold = (fresh(docs, x) for x in ("skey", "hash", "q", "threshold"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(_source_key("source").alias("skey"), words.alias("size"), _hash("doc_id", "text").alias("hash")))
    found, n = plan(sized)
    found = found.select(F.col("skey").alias(skey), F.col("q").alias(q), F.col("threshold").alias(threshold))
    keyed = docs.withColumns({skey: _source_key("source"), hashed: _hash("doc_id", "text")}).join(_small(found, n), skey)
    repeats = (F.col(q) + (F.col(hashed) < F.col(threshold)).cast("long")).cast("int")
    return keyed.select(*map(column, docs.columns), F.explode(F.array_repeat(F.lit(0), repeats)).alias(q)).drop(q)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


QUERIES = {"op10_mixing": _query}

ORACLE_SQL = {
    "op10_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT source, source_size, w, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x
  FROM sources),
aims AS (SELECT source, source_size, least(cap::DOUBLE, w * (SELECT max(x) FROM levels)) AS target FROM levels),
whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS q FROM aims),
placed AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.q, w.target - w.q * w.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.hash) AS own
  FROM sized d JOIN whole w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
       (size * (q + CASE WHEN budget <= 0 THEN 0
                         WHEN upto < budget THEN 1
                         WHEN upto - own < budget AND upto - budget < budget - (upto - own) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
}
