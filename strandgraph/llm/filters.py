"""Filter interaction audit: what each of five filters removes in every order, from one polynomial.

A document fails a set of filters, its mask. With filter i on with probability x_i, the documents
removed number R(x) = sum over non-empty sets T of a(T) * prod(x_i, i in T), a multilinear
polynomial whose coefficients follow from the mask counts alone: a(T) = (-1)^(|T|+1) * (documents
whose mask contains T). Everything asked for is read from R:

- survivors of the filters S: all documents minus R at the corner 1_S, the sum of a(T) over T in S;
- removed at a step: the difference of two corners;
- Shapley value of filter i: the integral of dR/dx_i along the diagonal, the sum over T with i of
  a(T) / |T|; times the 120 orders that is an integer, as 120 / |T| is one for |T| up to 5.

One pass over the texts gives 4 bits and a digest a document; the copies filter compares a
document's id with the least id of its digest; masks are counted by part with partial aggregation,
so that what follows has at most 32 rows a part.

Null texts are empty. A null source and an empty one are one part. A null doc_id is neither smaller
nor larger than another: such a row never fails the copies filter and makes no other row fail.
Rows repeated with their id don't make each other fail. Labels of one id are joined by "any";
documents without labels are neither good nor toxic. Other columns aren't read. An empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.common import WORD, cut, table

NAMES = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORDERS = 120
SETS = range(1, 1 << len(NAMES))


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: which of A to D the text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, chars = F.size(words), F.length(text)
    upper = chars - F.length(F.translate(text, UPPER, ""))
    fails = [n < 50, F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * F.lit(65).cast("long"), upper * F.lit(100).cast("long") > chars * F.lit(5).cast("long"), text.rlike(r"[#$%&*|]")]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    seen = cut(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), text_mask(text).alias("mask")))
    # stored, so that the join below has a shuffle on either side and a frequent digest's rows can be split
    least = cut(seen.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least"))
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("doc_id is not null")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * (1 << 4)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return seen.join(least, "digest", "left").join(marked, "doc_id", "left").select("part", (F.col("mask") + copy).alias("mask"), zero("good"), zero("toxic"))


def polynomials(counted: DataFrame) -> DataFrame:
    """part, n_docs and the coefficients of three removal polynomials (all, good, toxic documents).

    counted has part, mask and the counts n_all, n_good, n_toxic. Coefficient k - 1 is that of set k.
    """
    def coefficient(k: int, name: str) -> Column:
        inside = F.sum(F.when(F.col("mask").bitwiseAND(F.lit(k)) == k, F.col(name)).otherwise(0))
        return inside if k.bit_count() % 2 else -inside

    return counted.groupBy("part").agg(F.sum("n_all").alias("n_docs"), *[F.array(*[coefficient(k, f"n_{x}") for k in SETS]).alias(x) for x in ("all", "good", "toxic")])


def _corner(name: str, chosen: Column) -> Column:
    """R with exactly the filters of the set `chosen` on."""
    parts = [F.when(chosen.bitwiseAND(F.lit(k)) == k, F.get(name, F.lit(k - 1))).otherwise(0) for k in SETS]
    return sum(parts[1:], parts[0])


def _shapley(name: str, own: Column) -> Column:
    """120 times the integral of the partial derivative along the diagonal."""
    parts = [F.when(own.bitwiseAND(F.lit(k)) != 0, F.get(name, F.lit(k - 1)) * (ORDERS // k.bit_count())).otherwise(0) for k in SETS]
    return sum(parts[1:], parts[0])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; see the module's text."""
    counts = masks(docs, labels).groupBy("part", "mask").agg(F.count("*").alias("n_all"), F.sum("good").cast("long").alias("n_good"), F.sum("toxic").cast("long").alias("n_toxic"))
    full = (1 << len(NAMES)) - 1
    poly = cut(polynomials(counts))
    sets = F.explode(F.sequence(F.lit(0), F.lit(full))).alias("set")
    corners = poly.select("part", "n_docs", "all", "good", "toxic", sets)
    corners = cut(corners.select("part", "n_docs", "set", *[_corner(x, F.col("set")).alias(x) for x in ("all", "good", "toxic")], _shapley("all", F.col("set")).alias("shapley")))
    maps = corners.groupBy("part", "n_docs").agg(*[F.map_from_entries(F.collect_list(F.struct("set", x))).alias(x) for x in ("all", "good", "toxic", "shapley")])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(NAMES)])
    each = maps.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(NAMES)))))
    bit = lambda letter: F.pow(F.lit(2), F.ascii(letter) - ord("A")).cast("int")
    upto = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(len(NAMES))), F.lit(0), lambda s, i: s + F.when(i <= n, bit(F.substr(F.col("filter_order"), i, F.lit(1)))).otherwise(0))
    each = each.withColumns({"after": upto(F.col("step")), "before": upto(F.col("step") - 1)}).withColumn("own", F.col("after") - F.col("before"))
    of = lambda name, key: F.element_at(name, key)
    gone = lambda name: of(name, F.col("after")) - of(name, F.col("before"))
    return each.select(
        "part", "filter_order", "step", (F.col("n_docs") - of("all", F.col("after"))).alias("kept"), gone("all").alias("removed"),
        (of("all", F.col("own")) - gone("all")).alias("redundant"), (of("all", F.lit(full)) - of("all", F.lit(full) - F.col("own"))).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), of("shapley", F.col("own")).alias("shapley"))


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_filters": _query}

ORACLE_SQL = {
    "op13_filters": r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) AS upper
  FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
                CASE WHEN 100 * upper > 5 * length(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
grouped AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
played AS (
  SELECT part, filter_order, step, filter_order[step] AS own, fails, n, n_good, n_toxic,
         len(list_filter(range(1, 6), lambda p: contains(fails, filter_order[p]) AND p <= step)) > 0 AS gone,
         len(list_filter(range(1, 6), lambda p: contains(fails, filter_order[p]) AND p < step)) > 0 AS gone_before
  FROM grouped, steps),
told AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (gone AND NOT gone_before), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (contains(fails, own) AND gone_before), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(n_good) FILTER (gone AND NOT gone_before), 0)::BIGINT AS good_lost,
         coalesce(sum(n_toxic) FILTER (gone AND NOT gone_before), 0)::BIGINT AS toxic_lost
  FROM played GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told
"""
}
