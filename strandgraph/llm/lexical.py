"""Ranked lexical search: integer-scored postings, the best k documents of every item.

Postings are a stored table of (term, doc, impact): a term's rows lie together in one bucket, and a
frequent term is dealt over as many buckets as its rows need, so no bucket grows with a term's
frequency. An item's score of a document is the sum of impacts over the terms they share; impacts
are integers and don't depend on the item. Items' terms are joined to the postings, the matches are
summed by (item, document), and a window keeps the k best.

Every shared word makes a match, so summing all of them would shuffle nearly all pairs of items and
documents. Three exact steps sum only what can reach the first k:

1. each item's rarest terms give partial scores; the k-th best of these is a floor of its k-th best
   score, as impacts aren't negative;
2. an item's terms, least possible gain first, are optional as long as their greatest gains together
   stay below the floor: a document that has only optional terms can't be among the first k. The
   required terms are summed, which also raises the floor, and a pair goes on only if its sum and all
   optional gains reach the floor;
3. the pairs left get the optional terms' impacts.

Every comparison keeps ties. Each row of docs is a document of its own, whatever its id; ties of
score and id can't be told apart in the result. Null and empty texts have no terms, count in no
number and are never found. Items without terms, or whose terms are in no document, have no rows.
Items that share an id are one item with the terms of all. An empty table gives an empty result.
Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.llm.common import cut, table

K = 10
#: Terms of all items that are sent to the tasks as a set, at most; beyond, all terms are kept and joined.
VOCABULARY, VOCABULARY_BYTES = 1_000_000, 64_000_000
#: Rows of a term in one bucket of postings, at most about; fewer where that is more than half a partition.
BUCKET_ROWS = 1_000_000
#: Postings of an item that give the first floor, about.
SEEDS = 5_000
#: Rows of items' terms that are broadcast, at most (some 60 bytes each).
BROADCAST_ROWS = 500_000


def _table() -> bytes:
    """Translation of bytes: A-Z to lower case, other ASCII but letters and digits to a space."""
    def of(b: int) -> int:
        c = chr(b)
        if "A" <= c <= "Z":
            return b + 32
        return b if b >= 128 or c.isalnum() else 32

    return bytes(map(of, range(256)))


LOWERED = _table()


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8. All that parts terms is ASCII, so bytes of other letters stay together."""
    return text.translate(LOWERED).split()


def _counter(known: frozenset[bytes] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (row, doc_id, text) -> (row, doc_id, n, term, tf), and one with a null term for each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, n, term, tf = [], [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                found = terms(text or b"")
                if not found:
                    continue
                counts = Counter(found)
                mine = counts.keys() if known is None else counts.keys() & known
                place += [i] * (len(mine) + 1)
                n += [len(found)] * (len(mine) + 1)
                term.append(None)
                tf.append(None)
                for t in mine:
                    term.append(t)
                    tf.append(counts[t])
            at = pa.array(place, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(n, pa.int64()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "term", "tf"])

    return run


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times) of all items."""
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select(F.col(id_col).alias("item_id"), F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _vocabulary(wanted: DataFrame) -> frozenset[bytes] | None:
    """The distinct terms, if they are few and small enough to send to every task."""
    distinct = wanted.select("term").distinct()
    n, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if n > VOCABULARY or size > VOCABULARY_BYTES:
        return None
    return frozenset(r.term.encode() for r in distinct.collect())


def postings(docs: DataFrame, wanted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(term, row, doc_id, impact): the index, in buckets of terms, stored. With wanted, only of its terms.

    Terms of weight zero add nothing to a score and have no rows. `row` tells the rows of docs apart.
    """
    known = None if wanted is None else _vocabulary(wanted)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    raw = cut(rows.mapInArrow(_counter(known), f"row long, doc_id {kind}, n long, term string, tf long"))
    total = raw.where("term is null").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    found = raw.where("term is not null")
    if wanted is not None and known is None:
        found = found.join(wanted.select("term").distinct(), "term", "left_semi")
    weight = F.floor(F.lit(1000) * F.log((2.0 * total.n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = cut(found.groupBy("term").agg(F.count("*").alias("df")).withColumn("w", weight).where("w > 0"))
    n_terms, n_rows = weights.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket_rows = max(1, min(bucket_rows, n_rows // (2 * parts)))
    m = F.lit(100 - 75) + F.expr(f"(75 * n * {total.n}L) div {max(total.l, 1)}L")
    gain = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    dealt = found.withColumn("m", m).join(F.broadcast(weights) if n_terms <= BROADCAST_ROWS else weights, "term").withColumn("impact", F.col("w") * gain)
    share = F.pmod(F.xxhash64("row"), F.ceil(F.col("df") / bucket_rows))
    dealt = dealt.withColumn("share", share).select("term", "share", "row", "doc_id", "impact", "df")
    return cut(dealt.repartition("term", "share").sortWithinPartitions("term").select("term", "row", "doc_id", "impact", "df"))


def _small(wanted: DataFrame) -> DataFrame:
    """Items' terms, stored; broadcast where they are few."""
    wanted = cut(wanted)
    return F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted


def _best(scores: DataFrame, k: int, *order: Column) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), *order))).where(F.col("rank") <= k)


def _floor(scores: DataFrame, k: int) -> DataFrame:
    """(item_id, floor): the k-th best score of items that have so many."""
    return _best(scores, k).where(F.col("rank") == k).select("item_id", F.col("score").alias("floor"))


def _summed(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Matches of the items' terms, summed by item and document."""
    met = index.select("term", "row", "doc_id", "impact").join(_small(wanted.select("item_id", "term", "times")), "term")
    return met.groupBy("item_id", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("impact") * F.col("times")).alias("score"))


def ranked(docs: DataFrame, items: DataFrame, k: int = K, seeds: int = SEEDS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, ties by doc_id."""
    wanted = cut(item_terms(items).where("item_id is not null"))
    index = postings(docs, wanted)
    facts = index.groupBy("term").agg(F.max("impact").alias("most"), F.first("df").alias("df"))
    by_rarity = Window.partitionBy("item_id").orderBy("df", "term")
    known = wanted.join(facts, "term").withColumn("gain", F.col("most") * F.col("times"))
    known = cut(known.withColumn("upto", F.sum("df").over(by_rarity.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(by_rarity)))

    first = _floor(_summed(index, known.where((F.col("upto") <= seeds) | (F.col("nth") == 1))), k)
    by_gain = Window.partitionBy("item_id").orderBy("gain", "term")
    known = known.join(first, "item_id", "left").fillna(0, ["floor"])
    known = cut(known.withColumn("optional", F.sum("gain").over(by_gain.rowsBetween(Window.unboundedPreceding, 0)) < F.col("floor")))
    required, optional = known.where("not optional"), known.where("optional")

    scores = cut(_summed(index, required))
    slack = known.groupBy("item_id").agg(F.sum(F.when(F.col("optional"), F.col("gain")).otherwise(0)).alias("slack"), F.max("floor").alias("before"))
    slack = _small(slack.join(_floor(scores, k), "item_id", "left").select("item_id", "slack", F.greatest("before", F.coalesce("floor", F.lit(0))).alias("floor")))
    left = cut(scores.join(slack, "item_id").where("score + slack >= floor").select("item_id", "row", "doc_id", "score"))

    more = index.join(optional.select("term").distinct(), "term", "left_semi").join(left.select("row").distinct(), "row", "left_semi").select("row", "term", "impact")
    more = left.select("item_id", "row").join(more, "row").join(_small(optional.select("item_id", "term", "times")), ["item_id", "term"])
    more = more.select("item_id", "row", F.lit(None).cast(left.schema["doc_id"].dataType).alias("doc_id"), (F.col("impact") * F.col("times")).alias("score"))
    final = left.unionByName(more).groupBy("item_id", "row").agg(F.max("doc_id").alias("doc_id"), F.sum("score").alias("score")).where("score > 0")
    return _best(final, k, F.col("doc_id").asc_nulls_last(), F.col("row")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_search": _query}

ORACLE_SQL = {
    "op12_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
sized AS (SELECT rid, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
wanted AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE item_id IS NOT NULL)
  GROUP BY item_id, term),
held AS (
  SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM wanted) GROUP BY rid, term),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), total),
parts AS (
  SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))) AS impact
  FROM held JOIN sized USING (rid) JOIN weights USING (term), total),
scores AS (
  SELECT item_id, rid, doc_id, sum(times * impact)::BIGINT AS score FROM parts JOIN wanted USING (term) GROUP BY item_id, rid, doc_id),
placed AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid)::INT AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
}
