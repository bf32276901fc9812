"""Benchmark decontamination: a broadcast hash set of test n-grams against every window of the corpus.

An item's windows are its runs of `size` words; an item of fewer words is one window. Their 64-bit
hashes, with the text and the items that hold it, are broadcast in blocks whose rows and bytes are
checked, and the corpus is scanned once a block: each window is hashed, looked up, and a hit is
verified by comparing texts. All of it is column expressions: explode, hash join and a partial
aggregate run in one stage of generated code, so only one row a document and its hits are shuffled.

A document is told by its id and the digest of its text, so nulls and repeated rows are kept apart
or counted, whatever the partitioning. Null and empty texts have no words and aren't hit. An empty
benchmark hits nothing. A null item_id counts as an item with an empty name. Columns other than
those named aren't read by `contaminated`, and `clean` returns them as they are.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.common import column, cut, fresh, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, inside a character class; letters, digits and all beyond ASCII are words.
APART = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
SIZE = 10
#: Rows and bytes of one broadcast block of windows, at most.
BLOCK_ROWS, BLOCK_BYTES = 400_000, 64_000_000


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased, as an array; null: none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"[^{APART}]+"), F.lit(0))


def windows(items: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, gram, len, named): the distinct windows of all items, `named` the sorted ids as strings."""
    split = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    split = split.withColumn("len", F.least(F.size("w"), F.lit(size)))
    each = split.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    grams = each.select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("w")).groupBy("w", "len").agg(F.array_sort(F.collect_set("item")).alias("named"))
    return grams.select(F.xxhash64("w").alias("h"), F.array_join("w", " ").alias("gram"), "len", "named")


def blocks(grams: DataFrame, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> list[DataFrame]:
    """The stored windows in blocks that each stay within the rows and bytes given.

    A block is a share of the hashes; the shares are halved until the largest fits. A window that is
    larger than the bound by itself ends the halving.
    """
    total, longest = grams.agg(F.sum(_bytes()), F.max(_bytes())).first()
    if total is None:
        return []
    n = max(1, ceil(total / size))
    while True:
        worst = grams.groupBy(F.pmod("h", F.lit(n))).agg(F.count("*").alias("n"), F.sum(_bytes()).alias("b")).agg(F.max("n"), F.max("b")).first()
        if (worst[0] <= rows and worst[1] <= max(size, longest)) or n > 2**20:
            return [grams.where(F.pmod("h", F.lit(n)) == k) for k in range(n)]
        n *= 2


def _bytes() -> Column:
    return F.octet_length("gram") + F.lit(64)


def hits(docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each distinct (doc_id, digest): n_words, copies, at (words hit), found (item ids, sorted).

    copies counts the equal rows of docs. A word is in `at` if any occurrence of a window covers it.
    """
    named = F.md5(F.to_json(F.struct("named")))
    grams = cut(windows(items, size).withColumn("named_key", named))
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect()) or [size]  # at most `size` values
    parts = blocks(grams, rows) or [grams]
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), F.md5(text).alias("digest"), words(F.col(text_col)).alias("w"))
    found = None
    for k, part in enumerate(parts):
        one = _scan(split, part.select("h", "gram", F.col("len").alias("gram_len"), "named_key"), lengths, header=k == 0)
        found = one if found is None else found.unionByName(one)
    span = F.when(F.col("named_key").isNotNull(), F.struct("at", "len"))
    doc = found.groupBy("doc_id", "digest").agg(F.max("n_words").alias("n_words"), F.sum("head").alias("copies"), F.collect_set(span).alias("spans"), F.collect_set("named_key").alias("keys"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1))))
    doc = doc.select("doc_id", "digest", "n_words", "copies", covered.alias("at"), F.explode_outer("keys").alias("named_key"))
    lists = cut(grams.groupBy("named_key").agg(F.first("named").alias("named")))
    doc = doc.join(lists, "named_key", "left")
    return doc.groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.max("at").alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("named")))).alias("found"))


def _scan(split: DataFrame, grams: DataFrame, lengths: list[int], header: bool) -> DataFrame:
    """Every window of every document looked up in one block; with header, also a row a document."""
    k = F.lit(len(lengths))
    first = F.lit(-1 if header else 0)
    at = F.sequence(first, F.size("w") * k - 1) if header else F.when(F.size("w") > 0, F.sequence(first, F.size("w") * k - 1))
    each = split.select("doc_id", "digest", "w", F.explode(at).alias("i"))
    length = F.lit(lengths[0]) if len(lengths) == 1 else F.get(F.array(*map(F.lit, lengths)), F.pmod("i", k))
    place = F.col("i") if len(lengths) == 1 else F.floor(F.col("i") / k).cast("int")
    each = each.select("doc_id", "digest", "w", "i", place.alias("at"), length.alias("len"))
    window = F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("len"))  # a row a document has no window, but ANSI checks its start
    hashed = F.when((F.col("i") >= 0) & (F.col("at") + F.col("len") <= F.size("w")), F.xxhash64(window))
    each = each.withColumn("wh", hashed)
    same = (F.col("wh") == F.col("h")) & (F.col("len") == F.col("gram_len")) & (F.array_join(window, " ") == F.col("gram"))
    found = each.join(F.broadcast(grams), same, "left").where((F.col("i") < 0) | F.col("gram").isNotNull())
    return found.select("doc_id", "digest", F.when(F.col("i") < 0, F.size("w")).alias("n_words"), (F.col("i") < 0).cast("long").alias("head"), "at", "len", "named_key")


def contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE, rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    Repeated rows are repeated; rows of one id with different texts are judged apart.
    """
    each = hits(docs, items, size, rows=rows).select("doc_id", "n_words", "at", "found", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_"))
    n_hit = F.coalesce(F.size("at"), F.lit(0)).cast("long")
    return each.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("found").cast("long").alias("n_items"),
        F.sha2(F.array_join("found", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, how: str = "spans", size: int = SIZE) -> DataFrame:
    """docs without the benchmark's passages: `spans` removes the words hit with what follows each up
    to the next word, `documents` removes documents that are hit at all. Columns are unchanged.
    """
    if how not in ("spans", "documents"):
        raise ValueError("how is 'spans' or 'documents'")
    digest, at, own = (fresh(docs, x) for x in ("digest", "at", "own"))
    found = hits(docs, items, size).where(F.size("at") > 0).select(F.col("doc_id").alias(own), F.col("digest").alias(digest), F.col("at").alias(at))
    keyed = docs.withColumn(digest, F.md5(F.coalesce(column("text"), F.lit(""))))
    same = (keyed[digest] == found[digest]) & column("doc_id").eqNullSafe(column(own))
    if how == "documents":
        return keyed.join(found, same, "left_anti").select(*map(column, docs.columns))
    pieces = F.regexp_extract_all(column("text"), F.lit(f"[^{APART}]+[{APART}]*"), F.lit(0))
    # the pieces are bound to a name, so that they aren't cut again for each of them
    kept = lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), column(at)), lambda i: F.get(p, i)), "")
    lead = F.regexp_extract(column("text"), f"^[{APART}]*", 0)
    text = F.when(column(at).isNull(), column("text")).otherwise(F.concat(lead, F.get(F.transform(F.array(pieces), kept), F.lit(0))))
    return keyed.join(found, same, "left").select(*[text.alias(c) if c == "text" else column(c) for c in docs.columns])


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_contamination": _query}

ORACLE_SQL = {
    "op11_contamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS p
        FROM (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0))),
spots AS (
  SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p
        FROM d, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)),
met AS (SELECT rid, p, k, item FROM spots JOIN grams USING (k, gram)),
cover AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM met) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN named USING (rid)
"""
}
