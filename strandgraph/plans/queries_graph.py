"""Queries over the normalized graph, each with its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions import text as T
from strandgraph.functions import vectors as V
from strandgraph.operators import audit, dml, explore, normalize, review, score, views
from strandgraph.plans import encoding as enc
from strandgraph.plans.encoding import canon_sql, table, with_graph
from strandgraph.sources import files, schemas
from strandgraph.sources.catalog import Catalog
from strandgraph.sources.durable import scratch, stored

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def g(name: str, sql: str):
    """A query of the encoded graph: the function takes the Graph."""
    def add(f):
        QUERIES[name] = lambda spark, sf: f(enc.graph(spark, sf))
        ORACLE_SQL[name] = with_graph(sql)
        return f

    return add


def _extraction(spark, sf) -> DataFrame:
    m = enc.mentions(spark, sf)
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("phase") == c, F.struct("idx", "name", "definition")))), lambda x: F.struct(x["name"].alias("name"), x["definition"].alias("definition")))
    both = m.groupBy("paper_id").agg(order(0).alias("defines"), F.transform(order(1), lambda x: x["name"]).alias("builds_on"))
    return both.join(enc.papers(spark, sf), "paper_id", "right")


def _written(spark, write) -> str:
    """A new folder in the shared one, filled by write(path)."""
    path = scratch(spark)
    write(path)
    return path


@query("scan_extractions", with_graph("SELECT p.paper_id::VARCHAR AS paper_id, p.title, p.domain, count(ment.t) FILTER (WHERE phase = 0) AS n_defines FROM rawpaper p LEFT JOIN ment USING (paper_id) GROUP BY ALL"))
def scan_extractions(spark, sf):
    rows = _extraction(spark, sf).select(F.col("paper_id").cast("string").alias("paper_id"), "title", "domain", "paper_type", "defines")
    back = files.extraction_lines(spark, _written(spark, lambda path: rows.write.json(path)))
    return back.select("paper_id", "title", "domain", F.coalesce(F.size("defines"), F.lit(0)).cast("long").alias("n_defines"))


@query("scan_relations", with_graph("SELECT p.paper_id::VARCHAR AS paper_id, count(ment.t) FILTER (WHERE phase = 1) AS n_builds_on FROM rawpaper p LEFT JOIN ment USING (paper_id) GROUP BY ALL"))
def scan_relations(spark, sf):
    rows = _extraction(spark, sf).where(F.size("builds_on") > 0).select(F.col("paper_id").cast("string").alias("paper_id"), "builds_on")
    back = files.relation_lines(spark, _written(spark, lambda path: rows.write.json(path)))
    papers = enc.papers(spark, sf).select(F.col("paper_id").cast("string").alias("paper_id"))
    return files.with_relations(papers, back).select("paper_id", F.size("builds_on").cast("long").alias("n_builds_on"))


@query("scan_mentions", with_graph("SELECT paper_id::VARCHAR AS paper_id, phase::INT AS phase, (idx - 1)::INT AS idx, name, definition FROM ment"))
def scan_mentions(spark, sf):
    rows = _extraction(spark, sf).withColumn("paper_id", F.col("paper_id").cast("string"))
    concepts = files.extraction_lines(spark, _written(spark, lambda path: rows.drop("builds_on", "month").write.json(path)))
    builds = files.relation_lines(spark, _written(spark, lambda path: rows.select("paper_id", "builds_on").write.json(path)))
    return files.mentions(files.with_relations(concepts, builds)).withColumn("definition", F.when(F.col("phase") == 0, F.col("definition")).otherwise(""))


@query("lexicon_state", with_graph("SELECT key, rk FROM amap"))
def lexicon_state(spark, sf):
    return normalize.alias_map(enc.lexicon(spark, sf))


@query("canon", with_graph(f"SELECT name, {canon_sql('name')} AS key FROM (SELECT DISTINCT name FROM ment)"))
def canon(spark, sf):
    return enc.mentions(spark, sf).select("name").distinct().withColumn("key", T.canon(F.col("name")))


@query("paren_parts", with_graph("SELECT DISTINCT name, inner_k, outer_k FROM m WHERE paren"))
def paren_parts(spark, sf):
    names = enc.mentions(spark, sf).select("name").distinct().where(T.has_paren(F.col("name")))
    return names.select("name", T.paren_inner(F.col("name")).alias("inner_k"), T.paren_outer(F.col("name")).alias("outer_k"))


@g("resolve", "SELECT paper_id, phase::INT AS phase, idx::INT AS idx, rk FROM res WHERE NOT regexp_matches(name, '\\([^()]*\\)')")
def resolve(x):
    return x.resolved.where(~T.has_paren(F.col("name"))).select("paper_id", "phase", "idx", "rk")


@g("resolve_paren", "SELECT paper_id, phase::INT AS phase, idx::INT AS idx, name, rk FROM res WHERE regexp_matches(name, '\\([^()]*\\)')")
def resolve_paren(x):
    return x.resolved.where(T.has_paren(F.col("name"))).select("paper_id", "phase", "idx", "name", "rk")


@g("register", "SELECT rk, label, status, is_new FROM conc")
def register(x):
    return x.concepts


@g("node_ok", "SELECT rk, status FROM conc WHERE status IN ('approved', 'unreviewed')")
def node_ok(x):
    return x.concepts.where(F.col("status").isin(*T.NODE_OK)).select("rk", "status")


@query("validate_extraction", with_graph("SELECT coalesce(paper_type, 'none') AS kind, count(*) FILTER (WHERE paper_type IS NOT NULL AND title IS NOT NULL) AS n_valid, count(*) AS n FROM rawpaper GROUP BY 1"))
def validate_extraction(spark, sf):
    rows = _extraction(spark, sf)
    ok = T.valid_extraction(F.col("paper_type"), F.col("title"), F.coalesce("defines", F.array().cast("array<struct<name string, definition string>>")))
    return rows.groupBy(F.coalesce("paper_type", F.lit("none")).alias("kind")).agg(F.count_if(ok).alias("n_valid"), F.count("*").alias("n"))


@g("first_definition", "SELECT rk, definition, def_status FROM node")
def first_definition(x):
    return x.nodes.select("rk", "definition", "def_status")


@g("home_concept", "SELECT paper_id, home_concept FROM home")
def home_concept(x):
    return x.homes


@g("home_paper", "SELECT rk, home_paper FROM homep")
def home_paper(x):
    return x.home_papers


@g("lineage", "SELECT src, dst FROM pairs")
def lineage(x):
    return views.lineage(x)


@g("concept_nodes", """SELECT n.rk, canonical, definition, def_status, status, ptype, n.domain,
  (SELECT string_agg(paper_id::VARCHAR, ',' ORDER BY paper_id) FROM (SELECT DISTINCT paper_id FROM rel WHERE rel.rk = n.rk)) AS papers FROM cview n""")
def concept_nodes(x):
    return views.concept_view(x).select("rk", "canonical", "definition", "def_status", "status", "ptype", "domain", F.array_join(F.col("papers").cast("array<string>"), ",").alias("papers"))


@g("defines_edges", "SELECT paper_id, rk FROM rel WHERE type = 'defines'")
def defines_edges(x):
    return views.defines_view(x)


@g("paper_builds_on", "SELECT paper_id, rk FROM rel WHERE type = 'builds_on' AND paper_id NOT IN (SELECT paper_id FROM home)")
def paper_builds_on(x):
    return views.paper_builds_on(x)


ALL_EDGES = """SELECT 'builds_on' AS kind, src, dst FROM pairs UNION ALL SELECT 'defines', 'paper:' || paper_id, rk FROM rel WHERE type = 'defines'
UNION ALL SELECT 'paper_builds_on', 'paper:' || paper_id, rk FROM rel WHERE type = 'builds_on' AND paper_id NOT IN (SELECT paper_id FROM home)"""


@g("all_edges", ALL_EDGES)
def all_edges(x):
    return views.all_edges(x)


@g("dangling_edges", f", e AS ({ALL_EDGES}) SELECT kind, src, dst FROM e WHERE src NOT IN (SELECT rk FROM node) OR dst NOT IN (SELECT rk FROM node WHERE status = 'approved')")
def dangling_edges(x):
    e = views.all_edges(x)
    have = x.nodes.select(F.col("rk").alias("id"), "status")
    return views.not_whole(e, have, have.where("status = 'approved'"))


@g("property_chain", "SELECT DISTINCT d.rk AS src, b.rk AS dst, d.rk = b.rk AS self_loop FROM rel d JOIN rel b USING (paper_id) WHERE d.type = 'defines' AND b.type = 'builds_on'")
def property_chain(x):
    return views.property_chain(x)


SEED = ", seed AS (SELECT dst AS s FROM pairs GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def _seed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(1).select(F.col("dst").alias("rk"))


@g("subgraph", SEED + """, f AS (SELECT DISTINCT src FROM pairs JOIN seed ON dst = s ORDER BY src LIMIT 10)
SELECT DISTINCT src, dst FROM pairs WHERE src IN (SELECT src FROM f) OR src IN (SELECT s FROM seed)""")
def subgraph(x):
    pairs = views.lineage(x)
    return views.subgraph(pairs, _seed(pairs).first()["rk"])


@g("graph_stats", """SELECT (SELECT count(*) FROM paper) AS n_papers, (SELECT count(*) FROM node) AS n_concepts, (SELECT count(*) FROM node WHERE def_status = 'placeholder') AS n_placeholders,
(SELECT count(*) FROM edge WHERE type = 'defines') AS n_defines, (SELECT count(*) FROM edge WHERE type = 'builds_on') AS n_builds_on""")
def graph_stats(x):
    return views.summary(x)


@g("dropped_by_status", "SELECT c.status, count(*) AS n FROM res JOIN conc c USING (rk) WHERE phase = 1 AND c.status NOT IN ('approved', 'unreviewed') GROUP BY 1")
def dropped_by_status(x):
    return x.dropped.groupBy("status").agg(F.count("*").alias("n"))


@g("new_by_status", "SELECT status, count(*) AS n FROM conc WHERE is_new GROUP BY 1")
def new_by_status(x):
    return x.concepts.where("is_new").groupBy("status").agg(F.count("*").alias("n"))


@query("id_unique_check", "SELECT l_orderkey * 100 + l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def id_unique_check(spark, sf):
    lines = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"))
    return views.not_unique(lines, "id")


@g("graph_load", "SELECT rk, type, count(*) AS n FROM rel GROUP BY ALL")
def graph_load(x):
    spark = x.mentions.sparkSession
    catalog = Catalog(spark, scratch(spark))
    relations = x.relations
    catalog.write("relations", relations.where("type = 'defines'"))
    catalog.write("relations", relations)  # a full load replaces what was there
    return catalog.read("relations").groupBy("rk", "type").agg(F.count("*").alias("n"))


@query("embedding_store", "SELECT CASE WHEN vec_id % 2 = 0 THEN 'concept' ELSE 'paper' END AS kind, vec_id::VARCHAR AS id, round(embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def embedding_store(spark, sf):
    """Append twice to a store of two models, read one model's unit vectors back."""
    node = F.concat(F.when(F.col("vec_id") % 2 == 0, "concept:").otherwise("paper:"), "vec_id")
    rows = table(spark, sf, "embeddings").select(node.alias("node_id"), F.lit("m1").alias("model"), F.col("embedding").alias("vector"))
    path = scratch(spark)
    files.append_embeddings(rows.where("abs(hash(node_id)) % 2 = 0"), rows.limit(0), path)
    have = spark.read.schema(schemas.EMBEDDINGS).parquet(path)
    files.append_embeddings(rows.unionByName(rows.withColumn("model", F.lit("m2"))), have, path)
    back = files.embedding_store(spark.read.schema(schemas.EMBEDDINGS).parquet(path), "m1")
    return back.select("kind", "id", F.round(F.col("vector")[0], 6).alias("first"))


EMB = "SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'concept' ELSE 'paper' END AS kind, embedding::DOUBLE[] AS v FROM embeddings"


def _store(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, "concept").otherwise("paper").alias("kind"), F.col("embedding").alias("vector"))


@query("load_counts", f"SELECT kind, count(*) AS n, count(v) AS n_embedded FROM ({EMB}) GROUP BY 1")
def load_counts(spark, sf):
    return _store(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count("vector").alias("n_embedded"))


@query("load_embeddings", with_graph("SELECT n.rk, e.vec_id FROM (SELECT rk, try_cast(regexp_extract(rk, '(\\d+)$', 1) AS BIGINT) AS num FROM node) n LEFT JOIN embeddings e ON e.vec_id = n.num"))
def load_embeddings(spark, sf):
    nodes = enc.graph(spark, sf).nodes.select("rk", F.expr(r"try_cast(regexp_extract(rk, '(\\d+)$', 1) AS BIGINT)").alias("node_id"))
    store = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))
    return views.with_embeddings(nodes, store).select("rk", F.when(F.col("vector").isNotNull(), F.col("node_id")).alias("vec_id"))


VIEW = ", v AS (SELECT c.*, (SELECT min(month) FROM rel JOIN paper USING (paper_id) WHERE rel.rk = c.rk) AS month, CASE WHEN length(c.rk) % 3 = 0 THEN true ELSE false END AS reviewed FROM cview c)"


def _view(x) -> DataFrame:
    month = views.node_months(x.relations, x.told_papers)
    reviewed = x.nodes.where(F.length("rk") % 3 == 0).select("rk")
    return explore.with_reviewed(views.concept_view(x).join(month, "rk", "left"), reviewed)


@g("filter_concepts", VIEW + " SELECT rk, canonical, month FROM v WHERE ptype = 'technique' AND domain = 'building' AND month >= '1992-02' AND NOT reviewed")
def filter_concepts(x):
    return explore.filter_concepts(_view(x), "technique", "building", "1992-02", True).select("rk", "canonical", "month")


@g("filter_options", VIEW + " SELECT DISTINCT 'ptype' AS kind, ptype AS value FROM v UNION ALL SELECT DISTINCT 'domain', domain FROM v UNION ALL SELECT DISTINCT 'year', substr(month, 1, 4) FROM v WHERE month IS NOT NULL")
def filter_options(x):
    return explore.filter_options(_view(x))


@g("reviewed_flag", VIEW + " SELECT rk, reviewed FROM v")
def reviewed_flag(x):
    return explore.with_reviewed(x.nodes.select("rk"), x.nodes.where(F.length("rk") % 3 == 0).select("rk"))


@g("node_month", VIEW + " SELECT rk, month FROM v")
def node_month(x):
    return _view(x).select("rk", "month")


@g("name_search", "SELECT rk, canonical FROM node WHERE contains(lower(canonical), 'red w')")
def name_search(x):
    return explore.name_search(x.nodes, " Red W").select("rk", "canonical")


@g("concept_names", "SELECT canonical, row_number() OVER (ORDER BY canonical, rk) AS pos FROM node")
def concept_names(x):
    return views.sorted_names(x.nodes).select("canonical", "pos")


@g("resolve_node", """, asked AS (SELECT DISTINCT CASE WHEN length(rk) % 3 = 0 THEN rk WHEN length(rk) % 3 = 1 THEN upper(rk) ELSE canonical END AS name FROM node)
SELECT name, arg_min(rk, (r, rk)) AS rk FROM (SELECT name, n.rk, 0 AS r FROM asked JOIN node n ON n.rk = name UNION ALL SELECT name, n.rk, 1 FROM asked JOIN node n ON n.rk = lower(name)
UNION ALL SELECT name, n.rk, 2 FROM asked JOIN node n ON lower(n.canonical) = lower(name)) GROUP BY name""")
def resolve_node(x):
    kind = F.length("rk") % 3
    asked = x.nodes.select(F.when(kind == 0, F.col("rk")).when(kind == 1, F.upper("rk")).otherwise(F.col("canonical")).alias("name"))
    return explore.resolve_node(x.nodes, asked)


TOP = SEED.replace("SELECT dst AS s FROM pairs GROUP BY dst ORDER BY count(*) DESC, dst", "SELECT src AS s FROM pairs GROUP BY src ORDER BY count(*) DESC, src")


def _closure_sql(step: str, seed: str = SEED) -> str:
    return seed + f", walk AS (SELECT s AS rk FROM seed UNION SELECT {step})"


UP, DOWN = "p.dst FROM walk JOIN pairs p ON p.src = walk.rk", "p.src FROM walk JOIN pairs p ON p.dst = walk.rk"


@g("lineage_ancestors", _closure_sql(UP, TOP) + " SELECT rk FROM walk WHERE rk NOT IN (SELECT s FROM seed)")
def lineage_ancestors(x):
    pairs = stored(views.lineage(x))
    start = pairs.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).select(F.col("src").alias("rk"))
    return explore.closure(pairs, start).select("rk")


@g("lineage_descendants", _closure_sql(DOWN) + " SELECT rk FROM walk WHERE rk NOT IN (SELECT s FROM seed)")
def lineage_descendants(x):
    pairs = stored(views.lineage(x))
    return explore.closure(pairs, _seed(pairs), "descendants").select("rk")


@g("lineage_both", SEED + f", up AS (SELECT s AS rk FROM seed UNION SELECT {UP.replace('walk', 'up')}), down AS (SELECT s AS rk FROM seed UNION SELECT {DOWN.replace('walk', 'down')}) SELECT rk FROM (SELECT rk FROM up UNION SELECT rk FROM down) WHERE rk NOT IN (SELECT s FROM seed)")
def lineage_both(x):
    pairs = stored(views.lineage(x))
    return explore.closure(pairs, _seed(pairs), "both").select("rk")


@g("lineage_counts", "SELECT coalesce(a.src, d.dst) AS rk, coalesce(a.n, 0) AS n_parents, coalesce(d.n, 0) AS n_children FROM (SELECT src, count(*) AS n FROM pairs GROUP BY 1) a FULL JOIN (SELECT dst, count(*) AS n FROM pairs GROUP BY 1) d ON a.src = d.dst")
def lineage_counts(x):
    pairs = views.lineage(x)
    ends = F.array(F.struct(F.col("src").alias("rk"), F.lit(True).alias("is_src")), F.struct(F.col("dst").alias("rk"), F.lit(False).alias("is_src")))
    each = pairs.select(F.explode(ends).alias("x")).select("x.*")
    return each.groupBy("rk").agg(F.count_if("is_src").alias("n_parents"), F.count_if(~F.col("is_src")).alias("n_children"))


@g("lineage_closure_counts", f"""{TOP.replace('LIMIT 1', 'LIMIT 5')}, up AS (SELECT s AS start, s AS rk FROM seed UNION SELECT up.start, p.dst FROM up JOIN pairs p ON p.src = up.rk),
down AS (SELECT s AS start, s AS rk FROM seed UNION SELECT down.start, p.src FROM down JOIN pairs p ON p.dst = down.rk)
SELECT s AS rk, (SELECT count(*) FROM up WHERE up.start = s AND up.rk <> s) AS n_ancestors, (SELECT count(*) FROM down WHERE down.start = s AND down.rk <> s) AS n_descendants FROM seed""")
def lineage_closure_counts(x):
    pairs = stored(views.lineage(x))
    starts = pairs.groupBy("src").count().orderBy(F.desc("count"), "src").limit(5).select(F.col("src").alias("rk"))
    return explore.closure_counts(pairs, starts)


@g("embed_text", "SELECT 'concept' AS kind, rk AS id, nullif(trim(definition), '') AS said FROM node UNION ALL SELECT 'paper', paper_id::VARCHAR, nullif(trim(problem), '') FROM paper")
def embed_text(x):
    c = x.nodes.select(F.lit("concept").alias("kind"), F.col("rk").alias("id"), "definition", F.lit(None).cast("string").alias("problem"))
    p = x.told_papers.select(F.lit("paper").alias("kind"), F.col("paper_id").cast("string").alias("id"), F.lit(None).cast("string").alias("definition"), "problem")
    return c.unionByName(p).select("kind", "id", T.embed_text(F.col("kind"), F.col("definition"), F.col("problem")).alias("said"))


@query("embed_normalize", f"SELECT vec_id, kind, round(list_sum(list_transform(v, lambda x: x * x)) / list_dot_product(v, v), 6) AS norm FROM ({EMB})")
def embed_normalize(spark, sf):
    unit = _store(spark, sf).withColumn("u", V.normalized(F.col("vector")))
    return unit.select("vec_id", "kind", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("norm"))


COS = f", c AS (SELECT e.vec_id, e.kind, list_dot_product(e.v, q.v) / sqrt(list_dot_product(e.v, e.v) * list_dot_product(q.v, q.v)) AS s FROM ({EMB}) e, (SELECT v FROM ({EMB}) WHERE vec_id = 0) q)"


def _cosines(spark, sf) -> DataFrame:
    s = _store(spark, sf)
    q = s.where("vec_id = 0").select(F.col("vector").alias("q"))
    return s.crossJoin(F.broadcast(q)).withColumn("s", V.cosine(F.col("vector"), F.col("q"))).drop("vector", "q")


@query("cosine", f"WITH a AS (SELECT 1){COS} SELECT vec_id, round(s, 6) AS score FROM c")
def cosine(spark, sf):
    return _cosines(spark, sf).select("vec_id", F.round("s", 6).alias("score"))


@query("vector_topk", f"WITH a AS (SELECT 1){COS} SELECT vec_id AS node_id, round(s, 6) AS score FROM c WHERE s >= 0.3 ORDER BY s DESC, vec_id LIMIT 8")
def vector_topk(spark, sf):
    store = _store(spark, sf).select(F.col("vec_id").alias("node_id"), "vector")
    hits = V.top_k(store, store.where("node_id = 0"))
    return hits.select("node_id", F.round("score", 6).alias("score"))


@query("semantic_live", f"WITH a AS (SELECT 1){COS} SELECT vec_id, round_even(s, 3) AS score FROM c WHERE kind = 'concept' AND vec_id IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')")
def semantic_live(spark, sf):
    live = table(spark, sf, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("vec_id"))
    return _cosines(spark, sf).where("kind = 'concept'").join(live, "vec_id", "left_semi").select("vec_id", F.bround("s", 3).alias("score"))


@query("semantic_split", f"WITH a AS (SELECT 1){COS} SELECT vec_id::VARCHAR AS node_id, kind, kind = 'concept' AND vec_id % 3 = 0 AS seen FROM c WHERE s >= 0")
def semantic_split(spark, sf):
    hits = _cosines(spark, sf).where("s >= 0").select(F.col("vec_id").cast("string").alias("node_id"), "kind", F.col("s").alias("score"))
    reviewed = table(spark, sf, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").cast("string").alias("rk"))
    return explore.split_hits(hits, reviewed).select("node_id", "kind", "seen")


@g("related_terms", "SELECT term FROM (SELECT canonical AS term, 0 AS o FROM node WHERE canonical <> '' UNION ALL SELECT title, 1 FROM paper WHERE title <> '') ORDER BY o, term LIMIT 10")
def related_terms(x):
    return explore.related_terms(x.nodes, x.told_papers)


@query("hit_lines", f"WITH a AS (SELECT 1){COS} SELECT '- ' || vec_id || ' (' || kind || ')' AS line FROM c WHERE s >= 0.1")
def hit_lines(spark, sf):
    return _cosines(spark, sf).where("s >= 0.1").select(F.format_string("- %s (%s)", "vec_id", "kind").alias("line"))


@g("node_paper", "SELECT rk, (SELECT min(paper_id) FROM rel WHERE rel.rk = n.rk) AS paper_id FROM node n")
def node_paper(x):
    return views.node_paper(x)


@g("merge_concept", """, k AS (SELECT 'Def' AS d, min(rk) AS a, max(rk) AS b FROM node) SELECT DISTINCT paper_id, CASE WHEN rk = (SELECT a FROM k) THEN (SELECT b FROM k) ELSE rk END AS rk, type FROM rel""")
def merge_concept(x):
    ends = x.nodes.agg(F.min("rk").alias("a"), F.max("rk").alias("b")).first()
    return dml.merge_concept(x.relations, x.nodes, x.papers, ends["a"], ends["b"])[0]


@g("merge_concept_nodes", """, k AS (SELECT min(rk) AS a, max(rk) AS b FROM node), s AS (SELECT definition AS d, def_status AS st FROM node, k WHERE rk = a)
SELECT rk, CASE WHEN rk = b AND definition = '' THEN d ELSE definition END AS definition, CASE WHEN rk = b AND definition = '' THEN st ELSE def_status END AS def_status FROM node, k, s WHERE rk <> a""")
def merge_concept_nodes(x):
    ends = x.nodes.agg(F.min("rk").alias("a"), F.max("rk").alias("b")).first()
    return dml.merge_concept(x.relations, x.nodes, x.papers, ends["a"], ends["b"])[1].select("rk", "definition", "def_status")


@g("reject_concept", "SELECT paper_id, rk, type FROM rel WHERE rk <> (SELECT min(rk) FROM node)")
def reject_concept(x):
    return dml.reject_concept(x.relations, x.nodes, x.nodes.agg(F.min("rk").alias("a")).first()["a"])[0]


@g("definition_overlay", "SELECT rk, CASE WHEN length(rk) % 5 = 0 THEN 'live ' || rk ELSE definition END AS definition, CASE WHEN length(rk) % 5 = 0 THEN 'ok' ELSE def_status END AS def_status FROM node")
def definition_overlay(x):
    top = x.nodes.where(F.length("rk") % 5 == 0).select("rk", F.concat(F.lit(" live "), "rk").alias("definition"))
    return dml.overlay_definitions(x.nodes, top).select("rk", "definition", "def_status")


@g("upsert_concept", """, n AS (SELECT rk, 'new ' || canonical AS name, status, 'new' AS definition, 'ok' AS def_status, CASE WHEN length(rk) % 4 = 0 THEN '1,2' END AS embedding FROM node WHERE length(rk) % 2 = 0 UNION ALL SELECT 'zz ' || rk, canonical, status, definition, def_status, NULL FROM node WHERE length(rk) % 7 = 0)
SELECT coalesce(n.rk, o.rk) AS rk, CASE WHEN n.rk IS NULL THEN o.canonical ELSE n.name END AS name, CASE WHEN n.rk IS NOT NULL AND coalesce(o.definition, '') = '' THEN n.definition ELSE o.definition END AS definition,
coalesce(n.embedding, CASE WHEN o.rk IS NOT NULL THEN '0,0' END) AS embedding FROM node o FULL JOIN n ON n.rk = o.rk""")
def upsert_concept(x):
    vector = lambda a, b: F.array(F.lit(a), F.lit(b))
    old = stored(x.nodes).withColumnRenamed("canonical", "name").withColumn("embedding", vector(0, 0))
    new = old.where(F.length("rk") % 2 == 0).withColumns({"name": F.concat(F.lit("new "), "name"), "definition": F.lit("new"), "def_status": F.lit("ok"), "embedding": F.when(F.length("rk") % 4 == 0, vector(1, 2))})
    more = old.where(F.length("rk") % 7 == 0).withColumns({"rk": F.concat(F.lit("zz "), "rk"), "embedding": F.lit(None).cast("array<int>")})
    return dml.upsert_concepts(old, new.unionByName(more)).select("rk", "name", "definition", F.array_join(F.col("embedding").cast("array<string>"), ",").alias("embedding"))


@g("upsert_paper", """, n AS (SELECT paper_id, 'new ' || title AS title, domain FROM paper WHERE paper_id % 4 = 0 UNION ALL SELECT -paper_id - 1, title, domain FROM paper WHERE paper_id % 9 = 0)
SELECT coalesce(n.paper_id, o.paper_id) AS paper_id, coalesce(n.title, o.title) AS title, coalesce(n.domain, o.domain) AS domain FROM paper o FULL JOIN n ON n.paper_id = o.paper_id""")
def upsert_paper(x):
    old = stored(x.told_papers.select("paper_id", "title", "domain"))
    new = old.where("paper_id % 4 = 0").withColumn("title", F.concat(F.lit("new "), "title"))
    more = old.where("paper_id % 9 = 0").withColumn("paper_id", -F.col("paper_id") - 1)
    return dml.upsert_papers(old, new.unionByName(more))


@g("edge_merge", "SELECT paper_id, rk, type FROM rel")
def edge_merge(x):
    return dml.add_edges(x.relations, x.relations.where("paper_id % 2 = 0"))


@g("evidence_index", "SELECT rk, count(*) FILTER (WHERE phase = 0) AS n_defs, count(*) FILTER (WHERE phase = 1) AS n_cites FROM res GROUP BY rk")
def evidence_index(x):
    return review.evidence(x.resolved)


@g("evidence_rows", "SELECT rk, 'defined' AS kind, paper_id, definition FROM res WHERE phase = 0 UNION ALL SELECT DISTINCT rk, 'cited', paper_id, NULL FROM res WHERE phase = 1")
def evidence_rows(x):
    return review.evidence_rows(x.resolved).drop("t")


@g("evidence_card", """, ti AS (SELECT paper_id, coalesce(title, paper_id::VARCHAR) AS title FROM rawpaper),
d AS (SELECT rk, paper_id, definition, row_number() OVER (PARTITION BY rk ORDER BY t) AS rn FROM res WHERE phase = 0),
c AS (SELECT rk, paper_id, row_number() OVER (PARTITION BY rk ORDER BY t) AS rn FROM (SELECT rk, paper_id, min(t) AS t FROM res WHERE phase = 1 GROUP BY ALL)),
a AS (SELECT rk, string_agg(title || '|' || definition, ';' ORDER BY rn) AS s FROM d JOIN ti USING (paper_id) WHERE rn <= 3 GROUP BY rk), b AS (SELECT rk, string_agg(title, ';' ORDER BY rn) AS s FROM c JOIN ti USING (paper_id) WHERE rn <= 6 GROUP BY rk)
SELECT rk, coalesce(nullif(reps.definition, ''), (SELECT definition FROM d WHERE d.rk = reps.rk AND rn = 1), '') AS definition, coalesce(a.s, '') AS defined_in, coalesce(b.s, '') AS cited_in FROM reps LEFT JOIN a USING (rk) LEFT JOIN b USING (rk)""")
def evidence_card(x):
    cards = review.evidence_cards(x.resolved, x.raw_papers, x.reps)
    defined = F.array_join(F.transform("defined_in", lambda p: F.concat(p["title"], F.lit("|"), p["definition"])), ";")
    return cards.select("rk", "definition", defined.alias("defined_in"), F.array_join(F.transform("cited_in", lambda p: p["title"]), ";").alias("cited_in"))


@g("card_evidence", "SELECT rk, coalesce(nullif(definition, ''), '(none)') AS shown, NOT EXISTS (SELECT 1 FROM res WHERE res.rk = n.rk AND phase = 0) AS no_evidence FROM node n")
def card_evidence(x):
    return review.card_evidence(x.nodes, x.resolved)


SCORED = """, gold AS (SELECT DISTINCT paper_id, rk FROM res WHERE l_returnflag IN ('R', 'A')), pr AS (SELECT DISTINCT res.paper_id, res.rk, c.status IN ('approved', 'unreviewed') AS ok FROM res JOIN conc c ON c.rk = res.rk WHERE phase = 1),
item AS (SELECT coalesce(g.paper_id, p.paper_id) AS paper_id, coalesce(g.rk, p.rk) AS rk, CASE WHEN g.rk IS NOT NULL AND coalesce(ok, false) THEN 'TP' WHEN g.rk IS NOT NULL THEN 'FN' WHEN ok THEN 'FP' END AS verdict,
  CASE WHEN g.rk IS NOT NULL AND NOT coalesce(ok, false) THEN CASE WHEN p.rk IS NOT NULL THEN 'lexicon_dropped' ELSE 'not_extracted' END END AS diag FROM gold g FULL JOIN pr p ON g.paper_id = p.paper_id AND g.rk = p.rk),
items AS (SELECT * FROM item WHERE verdict IS NOT NULL),
bp AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM (SELECT paper_id, count(*) FILTER (WHERE verdict = 'TP') AS tp, count(*) FILTER (WHERE verdict = 'FP') AS fp, count(*) FILTER (WHERE verdict = 'FN') AS fn FROM items GROUP BY 1))"""


def scored(f):
    def run(spark, sf):
        x = enc.graph(spark, sf)
        gold = x.resolved.where("l_returnflag in ('R', 'A')")
        return f(score.items(gold, x.resolved.where("phase = 1"), x.concepts, T.NODE_OK), spark, sf)

    QUERIES[f.__name__] = run
    return f


@scored
def score_items(items, spark, sf):
    return items


@scored
def set_tp_fp_fn(items, spark, sf):
    return items.groupBy("verdict").agg(F.count("*").alias("n"))


def _rounded(d: DataFrame) -> DataFrame:
    return d.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in d.dtypes])


@scored
def score_paper(items, spark, sf):
    return _rounded(score.by_paper(items))


@scored
def score_micro(items, spark, sf):
    return _rounded(score.totals(score.by_paper(items))).select("tp", "fp", "fn", "micro_p", "micro_r")


@scored
def score_macro(items, spark, sf):
    return _rounded(score.totals(score.by_paper(items))).select("n_papers", "macro_p", "macro_r")


@scored
def score_groups(items, spark, sf):
    groups = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("grp"))
    return _rounded(score.by_group(score.by_paper(items), groups))


@scored
def fn_diag(items, spark, sf):
    return items.where("verdict = 'FN'").groupBy("diag").agg(F.count("*").alias("n"))


@scored
def fp_taxonomy(items, spark, sf):
    kind = score.fp_taxonomy(F.element_at(F.split("rk", " "), 1), ("red", "blue"), ("small",))
    return items.where("verdict = 'FP'").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


TOTALS = "count(*) AS n_papers, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 6) AS micro_p, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS micro_r, round(avg(p), 6) AS macro_p, round(avg(r), 6) AS macro_r"
for _name, _sql in {
    "score_items": "SELECT paper_id, rk, verdict, diag FROM items",
    "set_tp_fp_fn": "SELECT verdict, count(*) AS n FROM items GROUP BY 1",
    "score_paper": "SELECT paper_id, tp, fp, fn, round(p, 6) AS p, round(r, 6) AS r FROM bp",
    "score_micro": f"SELECT tp, fp, fn, micro_p, micro_r FROM (SELECT {TOTALS} FROM bp)",
    "score_macro": f"SELECT n_papers, macro_p, macro_r FROM (SELECT {TOTALS} FROM bp)",
    "score_groups": f"SELECT o_orderpriority AS grp, grouping(o_orderpriority) = 1 AS all_groups, {TOTALS} FROM bp JOIN orders ON o_orderkey = paper_id GROUP BY GROUPING SETS ((o_orderpriority), ())",
    "fn_diag": "SELECT diag, count(*) AS n FROM items WHERE verdict = 'FN' GROUP BY 1",
    "fp_taxonomy": "SELECT CASE WHEN split_part(rk, ' ', 1) IN ('red', 'blue') THEN 'component_tool' WHEN split_part(rk, ' ', 1) = 'small' THEN 'substrate' ELSE 'method_misjudged' END AS kind, count(*) AS n FROM items WHERE verdict = 'FP' GROUP BY 1",
}.items():
    ORACLE_SQL[_name] = with_graph(SCORED + " " + _sql)


@g("graph_diff", """SELECT 'paper' AS kind, paper_id::VARCHAR AS id FROM paper WHERE paper_id % 3 = 0 UNION ALL SELECT 'lineage', src || ' -> ' || dst FROM pairs WHERE length(src) % 2 = 0
UNION ALL SELECT 'concept', canonical FROM node WHERE length(rk) % 2 = 0 UNION ALL SELECT 'lexicon', label FROM reps WHERE length(rk) % 2 = 0
UNION ALL SELECT 'unreviewed', label FROM reps WHERE length(rk) % 2 = 0 AND status = 'unreviewed'""")
def graph_diff(x):
    """What the graph has that an earlier one without a third of the papers and without concepts, lineage and lexicon
    entries of even keys hasn't; both are compared whole."""
    after = {"concepts": stored(x.nodes.select("rk", "canonical")), "papers": stored(x.told_papers.select("paper_id")), "lineage": stored(views.lineage(x)), "lexicon": stored(x.reps.select("rk", "label", "status"))}
    later = {"papers": F.col("paper_id") % 3 == 0, "lineage": F.length("src") % 2 == 0} | dict.fromkeys(("concepts", "lexicon"), F.length("rk") % 2 == 0)
    return audit.added({t: rows.where(~F.coalesce(later[t], F.lit(False))) for t, rows in after.items()}, after)


@g("view_diff", "SELECT src, dst, 'b' AS side FROM pairs WHERE length(src) % 4 = 0")
def view_diff(x):
    pairs = stored(views.lineage(x))
    return audit.multiset_diff(pairs.where(F.length("src") % 4 != 0), pairs)


@g("audit", """, live AS (SELECT rk, definition FROM node WHERE length(rk) % 9 <> 0 UNION ALL SELECT rk, '' FROM reps WHERE status = 'rejected' AND length(rk) % 2 = 0 UNION ALL SELECT key, '' FROM amap WHERE key <> rk AND length(key) % 5 = 0)
SELECT 'A_rejected_node' AS finding, rk AS id FROM reps WHERE status = 'rejected' AND rk IN (SELECT rk FROM live) UNION ALL SELECT 'B_alias_node', key FROM amap WHERE key <> rk AND key IN (SELECT rk FROM live)
UNION ALL SELECT 'C_definition', live.rk FROM live JOIN reps USING (rk) WHERE trim(reps.definition) <> '' AND trim(live.definition) <> trim(reps.definition)
UNION ALL SELECT 'D_anchor', paper_id::VARCHAR FROM paper WHERE home_concept IS NOT NULL AND home_concept NOT IN (SELECT rk FROM live)
UNION ALL SELECT 'E_missing', rk FROM node WHERE rk NOT IN (SELECT rk FROM live) UNION ALL SELECT 'E_extra', rk FROM live WHERE rk NOT IN (SELECT rk FROM node)""")
def audit_query(x):
    live = x.nodes.where(F.length("rk") % 9 != 0).select("rk", "definition")
    live = live.unionByName(x.reps.where((F.col("status") == "rejected") & (F.length("rk") % 2 == 0)).select("rk", F.lit("").alias("definition")))
    live = live.unionByName(x.aliases.where((F.col("key") != F.col("rk")) & (F.length("key") % 5 == 0)).select(F.col("key").alias("rk"), F.lit("").alias("definition")))
    return audit.audit(live, x.papers, x.nodes, x.reps, x.aliases)


@g("ptype_dist", "SELECT paper_type, count(*) AS n, count(*) FILTER (WHERE home_concept IS NULL) AS n_without_home FROM paper GROUP BY 1")
def ptype_dist(x):
    return views.type_counts(x.papers)


@g("papers_without_home", "SELECT paper_id, paper_type FROM paper WHERE home_concept IS NULL")
def papers_without_home(x):
    return views.without_home(x.papers)


SLUG = r"regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '^_+|_+$', '', 'g')"


@g("triples", f"""SELECT ':' || {SLUG.format('rk')} AS s, 'a' AS p, 'skos:Concept' AS o FROM node UNION ALL SELECT ':' || {SLUG.format('rk')}, 'skos:prefLabel', '"' || canonical || '"' FROM node
UNION ALL SELECT ':' || {SLUG.format('src')}, ':buildsOn', ':' || {SLUG.format('dst')} FROM pairs""")
def triples(x):
    return views.triples(x)
