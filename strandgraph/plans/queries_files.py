"""Queries over files, rejected rows, model calls and a client's edits, with their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.engine import Engine
from strandgraph.functions import annotators, prompts
from strandgraph.operators import views, workflow
from strandgraph.plans import encoding as enc
from strandgraph.plans.queries_graph import ORACLE_SQL as GRAPH_SQL
from strandgraph.sources import files, rejects
from strandgraph.sources.catalog import Catalog
from strandgraph.sources.durable import scratch

QUERIES, ORACLE_SQL = {}, {}


def _q(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


# Extractions as lines: every seventh is cut off, others have no title, a strange type, a name missing.
@_q("rejected_json", """SELECT CASE WHEN doc_id % 7 <> 3 THEN doc_id::VARCHAR END AS paper_id, CASE WHEN doc_id % 7 = 3 THEN 'not readable' ELSE
 concat_ws(', ', CASE WHEN doc_id % 5 = 0 THEN 'no title' END, CASE WHEN doc_id % 11 = 0 THEN 'unknown paper_type' END, CASE WHEN doc_id % 13 = 0 THEN 'a definition without a name' END) END AS reasons FROM documents""")
def rejected_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    name = F.when(n % 13 != 0, F.col("source")).otherwise("")
    row = F.struct(n.cast("string").alias("paper_id"), F.when(n % 5 != 0, F.col("lang")).alias("title"), F.col("text").alias("problem"), F.when(n % 11 == 0, "poem").otherwise("survey").alias("paper_type"), F.array(F.struct(name.alias("name"), F.lit("d").alias("definition"))).alias("defines"))
    line = F.to_json(row)
    path = scratch(spark)
    enc.table(spark, sf_dir, "documents").select(F.when(n % 7 == 3, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line).alias("value")).write.text(path)
    done = rejects.json_rows(spark, path, "paper_id string, title string, problem string, paper_type string, defines array<struct<name string, definition string>>", rejects.extraction_rules())
    bad = done.rejected.select(F.get_json_object("row", "$.paper_id").alias("paper_id"), F.array_join("reasons", ", ").alias("reasons"))
    unread = F.when(F.col("reasons") != rejects.NOT_READABLE, F.col("paper_id"))
    return bad.withColumn("paper_id", unread).unionByName(done.good.select("paper_id", F.lit("").alias("reasons")))


@_q("rejected_csv", """SELECT event_id % 9 = 4 OR event_id % 10 = 7 AS is_rejected, event_type, count(*) AS n, sum(CASE WHEN event_id % 9 = 4 THEN NULL ELSE event_id END)::BIGINT AS total
FROM events GROUP BY ALL""")
def rejected_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = enc.table(spark, sf_dir, "events"), F.col("event_id")
    path = scratch(spark)
    files.write_csv(e.select(F.when(n % 9 == 4, F.concat(F.lit("no number "), n)).otherwise(n.cast("string")).alias("event_id"), F.when(n % 10 != 7, F.col("props")).alias("props"), "event_type"), path)
    done = rejects.csv_rows(spark, path, "event_id long, props string, event_type string", {"no props": F.col("props").isNull()})
    kind = F.coalesce(F.get_json_object("row", "$.event_type"), F.regexp_extract("row", r"([^,]*)$", 1))
    bad = done.rejected.select(F.lit(True).alias("is_rejected"), kind.alias("event_type"), F.get_json_object("row", "$.event_id").cast("long").alias("event_id"))
    both = bad.unionByName(done.good.select(F.lit(False).alias("is_rejected"), "event_type", "event_id"))
    return both.groupBy("is_rejected", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


# Stored feeds: every document is an entry that two queries find; the second half is stored after the first is read.
@_q("feed_search", """SELECT doc_id::VARCHAR AS paper_id, 'q' || doc_id % 5 AS first_seen_query, lang || ' ' || source AS title FROM documents WHERE 2000 + doc_id % 25 >= 2010""")
def feed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    entry = lambda d, k: d.select((n % 5 + 5 * k).alias("query_ord"), n.alias("entry_ord"), F.concat(F.lit("q"), n % 5 + 5 * k).alias("query"), F.concat(F.lit("http://x.org/abs/"), n, F.lit(f"v{k + 1}")).alias("id"), F.concat("lang", F.lit("\n  "), "source").alias("title"), F.lit("s").alias("summary"), F.concat((2000 + n % 25).cast("string"), F.lit("-03-01")).alias("published"))
    docs, given, out, checkpoint = enc.table(spark, sf_dir, "documents"), *[scratch(spark) for _ in range(3)]
    for k in (0, 1):
        entry(docs, k).write.format("xml").option("rootTag", "feed").option("rowTag", "entry").mode("append").save(given)
        stream = files.feed_stream(spark, given, "query_ord long, entry_ord long, query string, id string, title string, summary string, published string")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return workflow.feed_entries(spark.read.parquet(out), "2010-01").select("paper_id", "first_seen_query", "title")


@_q("turtle_round_trip", GRAPH_SQL["triples"])
def turtle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements as they are read back from what the sink wrote."""
    path = scratch(spark)
    files.write_triples(views.triples(enc.graph(spark, sf_dir)), path)
    return files.read_triples(spark, path)


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"


@_q("extract_calls", rf"""WITH d AS (SELECT doc_id, text, lower('x' || chr(10) || text) AS low, {_LINES} AS lines, regexp_extract_all(text, '\b(?:propose|introduce|present)\s+([A-Z][\w-]*(?: [A-Z][\w-]*)*)', 1) AS names FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'We introduce Graph Net' || doc_id || ' here. We introduce Deep-Walk.' || chr(10) ELSE '' END || text AS text FROM documents))
SELECT doc_id AS id, coalesce(left(lines[1], 300), '') AS title, coalesce(left(lines[-1], 300), '') AS problem, len(list_distinct(names)) AS n_defines, names[1] AS first,
 CASE WHEN regexp_matches(low, 'survey|review of') THEN 'survey' WHEN regexp_matches(low, 'benchmark|dataset') THEN 'benchmark' WHEN regexp_matches(low, 'analysis|we study') THEN 'analysis' ELSE 'technique' END AS paper_type FROM d""")
def extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.concat(F.when(n % 3 == 0, F.concat(F.lit("We introduce Graph Net"), n, F.lit(" here. We introduce Deep-Walk.\n"))).otherwise(""), "text")
    told = annotators.ask(enc.table(spark, sf_dir, "documents"), prompts.EXTRACT, text, id_col="doc_id", concurrent=2, retries=1).where("ok")
    return told.select("id", "title", "problem", F.size("defines").cast("long").alias("n_defines"), F.get("defines", F.lit(0))["name"].alias("first"), "paper_type")


@_q("relate_calls", r"""SELECT doc_id AS id, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), '|') AS builds_on FROM (
 SELECT doc_id, regexp_extract_all('It builds upon Deep Walk' || doc_id % 9 || ', extending Old Net. Based on deep words. It is based on Deep Walk' || doc_id % 4 || '. ' || text, '\b(?:build(?:s|ing)? (?:up)?on|extend(?:s|ing)?|based on)\s+([A-Z][\w-]*(?: [A-Z][\w-]*)*)', 1) AS n FROM documents)""")
def relate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.concat(F.lit("It builds upon Deep Walk"), n % 9, F.lit(", extending Old Net. Based on deep words. It is based on Deep Walk"), n % 4, F.lit(". "), "text")
    told = annotators.ask(enc.table(spark, sf_dir, "documents"), prompts.RELATE, text, id_col="doc_id").where("ok")
    return told.select("id", F.array_join("builds_on", "|").alias("builds_on"))


@_q("intent_calls", """SELECT o_orderkey AS id, 'graph memory ' || lower(o_orderpriority[3:]) AS topic, strftime(o_orderdate, '%Y') || '-01' AS period_from, CASE WHEN o_orderkey % 2 = 0 THEN '2031-12' ELSE '' END AS period_to, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 END AS count FROM orders""")
def intent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = enc.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F.concat(F.lit("find "), F.when(n % 3 == 0, F.concat(n % 50, F.lit(" "))).otherwise(""), F.lit("papers about graph memory "), F.lower(F.substring("o_orderpriority", 3, 99)), F.lit(" since "), F.year("o_orderdate"), F.when(n % 2 == 0, " until 2031").otherwise(""))
    told = annotators.ask(o, prompts.INTENT, text, id_col="o_orderkey").where("ok")
    return told.select("id", "topic", "period_from", "period_to", "count")


# A client's session on the graph: reject one concept, merge another into a third, mark two as reviewed and one not.
@_q("engine_edits", enc.with_graph(f""", k AS (SELECT label, {enc.canon_sql('label')} AS rk, row_number() OVER (ORDER BY {enc.canon_sql('label')}) AS o FROM lex WHERE status = 'approved' AND {enc.canon_sql('label')} IN (SELECT rk FROM node)),
moved AS (SELECT DISTINCT paper_id, CASE WHEN rk = (SELECT rk FROM k WHERE o = 2) THEN (SELECT rk FROM k WHERE o = 3) ELSE rk END AS rk, type FROM rel WHERE rk <> (SELECT rk FROM k WHERE o = 1))
SELECT n.rk, count(m.type) AS n_relations, n.rk = (SELECT rk FROM k WHERE o = 4) AS reviewed FROM node n LEFT JOIN moved m ON m.rk = n.rk WHERE n.rk NOT IN (SELECT rk FROM k WHERE o <= 2) GROUP BY n.rk"""))
def engine_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, scratch(spark))
    catalog.transact(lambda d: [d.write(name, rows) for name, rows in (("mentions", enc.mentions(spark, sf_dir).drop("l_returnflag")), ("papers", enc.papers(spark, sf_dir)), ("lexicon", enc.lexicon(spark, sf_dir)))])
    engine = Engine(spark, catalog)
    engine.rebuild()
    nodes = catalog.read("nodes").select("rk", F.col("canonical").alias("label"))
    four = [(r["label"], r["rk"]) for r in catalog.read("lexicon").where("status = 'approved'").select("label").join(nodes, "label").orderBy("rk").limit(4).collect()]
    engine.patch_concept(four[0][0], status="rejected")
    engine.merge_concepts(four[1][0], four[2][0])
    for rk, flag in ((four[3][1], True), (four[2][1], True), (four[2][1], False)):
        engine.set_reviewed(rk, flag)
    count = catalog.read("relations").groupBy("rk").agg(F.count("*").alias("n_relations"))
    seen = engine.reviewed().withColumn("reviewed", F.lit(True))
    return catalog.read("nodes").select("rk").join(count, "rk", "left").join(seen, "rk", "left").select("rk", F.coalesce("n_relations", F.lit(0)).alias("n_relations"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"))
