"""Queries over states of many tables: incremental builds, snapshots, rules, upserts by bucket, with their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions.text import canon
from strandgraph.operators import dml, incremental
from strandgraph.plans import encoding as enc
from strandgraph.sources.catalog import Broken, Catalog
from strandgraph.sources.durable import scratch, stored

QUERIES, ORACLE_SQL = {}, {}


def _q(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


@_q("incremental_build", enc.with_graph("""SELECT n.rk, canonical, definition, def_status, status, count(type) AS n_relations
FROM node n LEFT JOIN rel USING (rk) GROUP BY ALL"""))
def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build over nine tenths of the papers and a batch of new and replaced ones equal a build over all."""
    catalog = Catalog(spark, scratch(spark))
    mentions, papers = stored(enc.mentions(spark, sf_dir).select(*incremental.RAW)), stored(enc.papers(spark, sf_dir))
    late, changed = F.col("paper_id") % 10 == 3, F.col("paper_id") % 100 == 7
    first = mentions.where(~late).withColumns({"name": F.when(changed, F.concat(F.lit("Draft of "), "name")).otherwise(F.col("name"))})
    catalog.write("lexicon", enc.lexicon(spark, sf_dir))
    incremental.ingest_batch(catalog, first, papers.where(~late), buckets=16)
    state = incremental.ingest_batch(catalog, mentions.where(late | changed), papers.where(late | changed))
    count = state.read("relations").groupBy("rk").agg(F.count("*").alias("n_relations"))
    return state.read("nodes").join(count, "rk", "left").withColumn("n_relations", F.coalesce("n_relations", F.lit(0)))


@_q("snapshot_read", enc.with_graph(f""", gone AS (SELECT {enc.canon_sql('label')} AS rk FROM lex WHERE ord % 5 = 0),
views AS (SELECT 'snapshot' AS view, rk, type FROM rel UNION ALL SELECT 'live', rk, type FROM rel WHERE rk NOT IN (SELECT rk FROM gone) UNION ALL SELECT 'restored', rk, type FROM rel)
SELECT view, type, count(*) AS n_relations, count(DISTINCT rk) AS n_concepts FROM views GROUP BY view, type"""))
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read API over the live tables and a snapshot: an edit of two tables at once, seen by neither or both."""
    graph = enc.graph(spark, sf_dir)
    catalog = Catalog(spark, scratch(spark))
    catalog.transact(lambda d: (d.write("nodes", graph.nodes, "rk", 16), d.write("relations", graph.relations, "rk", 16)))
    catalog.snapshot("before")
    rejected = stored(enc.lexicon(spark, sf_dir).where("ord % 5 = 0").select(canon(F.col("label")).alias("rk")).distinct())
    catalog.transact(lambda d: [d.change(t, rejected, d.read(t).limit(0)) for t in ("nodes", "relations")])
    views = {"snapshot": catalog.at("before"), "live": catalog.at()}
    views["restored"] = catalog.restore_all(views["snapshot"].number)
    out = None
    for name, state in views.items():
        pairs = state.read("relations").join(state.read("nodes").select("rk"), "rk", "left_semi")
        one = pairs.groupBy("type").agg(F.count("*").alias("n_relations"), F.count_distinct("rk").alias("n_concepts")).withColumn("view", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@_q("broken_rules", """SELECT 'key lineitem(l_orderkey, l_linenumber)' AS rule, l_orderkey || ', ' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'reference lineitem.l_partkey to good.p_partkey', l_partkey::VARCHAR, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 48) GROUP BY l_partkey""")
def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys at fault of a version that is kept out: declared keys and references are checked before a commit."""
    catalog = Catalog(spark, scratch(spark))

    def load(draft):
        draft.write("good", enc.table(spark, sf_dir, "part").where("p_size <= 48").select("p_partkey"), "p_partkey", 16)
        draft.write("lineitem", enc.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", 16)
        draft.declare_key("good", "p_partkey")
        draft.declare_key("lineitem", "l_orderkey", "l_linenumber")
        draft.declare_reference("lineitem", "l_partkey", "good", "p_partkey")

    try:
        catalog.transact(load)
    except Broken as found:
        return found.rows
    return spark.createDataFrame([], "rule string, key string, n long")


@_q("bucket_upsert", enc.with_graph(""", n AS (SELECT rk, 'new ' || canonical AS name, 'live' AS definition FROM node WHERE length(rk) % 8 = 0 UNION ALL SELECT 'zz ' || rk, canonical, definition FROM node WHERE length(rk) % 8 = 1)
SELECT coalesce(n.rk, o.rk) AS rk, coalesce(n.name, o.canonical) AS name, CASE WHEN n.rk IS NOT NULL AND coalesce(o.definition, '') = '' THEN n.definition ELSE o.definition END AS definition FROM node o FULL JOIN n ON n.rk = o.rk"""))
def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert that rewrites the buckets of its keys only equals the full outer join."""
    catalog = Catalog(spark, scratch(spark))
    old = stored(enc.graph(spark, sf_dir).nodes.withColumnRenamed("canonical", "name").select("rk", "name", "status", "definition", "def_status"))
    catalog.write("concepts", old, "rk", 64)
    new = old.where(F.length("rk") % 8 == 0).withColumns({"name": F.concat(F.lit("new "), "name"), "definition": F.lit("live")})
    more = old.where(F.length("rk") % 8 == 1).withColumn("rk", F.concat(F.lit("zz "), "rk"))
    state = catalog.transact(lambda d: d.upsert("concepts", new.unionByName(more), dml.upsert_concepts))
    return state.read("concepts").select("rk", "name", "definition")
