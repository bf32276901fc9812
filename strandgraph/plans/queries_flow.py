"""Queries of the workflow, text, review and candidate operators, each with its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions import annotators, prompts, sections
from strandgraph.functions import text as T
from strandgraph.operators import candidates, dml, explore, review, views, workflow
from strandgraph.plans import encoding as enc
from strandgraph.plans.encoding import table
from strandgraph.sources import files
from strandgraph.sources.catalog import Catalog
from strandgraph.sources.durable import scratch
from strandgraph.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Search results: documents as entries, three versions a paper, seven queries.
FEED = """feed AS (SELECT 'http://x.org/abs/' || lpad((doc_id // 3 % 2412)::VARCHAR, 4, '0') || '.' || lpad((doc_id // 3)::VARCHAR, 9, '0') || 'v' || (doc_id % 3 + 1) AS id, doc_id % 7 AS query_ord, doc_id AS entry_ord,
 'q' || (doc_id % 7) AS query, '  ' || text AS title, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE '20' || lpad((doc_id % 25)::VARCHAR, 2, '0') || '-0' || (doc_id % 9 + 1) || '-15' END AS published FROM documents)"""


def _feed(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    paper = F.floor(d / 3)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("http://x.org/abs/"), pad(paper % 2412, 4), F.lit("."), pad(paper, 9), F.lit("v"), (d % 3 + 1).cast("string")).alias("id"),
        (d % 7).alias("query_ord"), d.alias("entry_ord"), F.concat(F.lit("q"), d % 7).alias("query"), F.concat(F.lit("  "), "text").alias("title"), F.col("text").alias("summary"),
        F.when(d % 11 != 0, F.concat(F.lit("20"), pad(d % 25, 2), F.lit("-0"), (d % 9 + 1).cast("string"), F.lit("-15"))).alias("published"))


NORM = r"regexp_replace(split_part(rtrim(id, '/'), '/', -1), 'v\d+$', '')"


@query("norm_id", f"WITH {FEED} SELECT id, {NORM} AS paper_id FROM feed")
def norm_id(spark, sf):
    return _feed(spark, sf).select("id", T.norm_id(F.col("id")).alias("paper_id"))


@query("id_month", f"WITH {FEED} SELECT DISTINCT {NORM} AS paper_id, '20' || substr({NORM}, 1, 2) || '-' || substr({NORM}, 3, 2) AS month FROM feed UNION ALL SELECT DISTINCT source, NULL FROM documents")
def id_month(spark, sf):
    ids = _feed(spark, sf).select(T.norm_id(F.col("id")).alias("paper_id")).distinct()
    return ids.unionByName(table(spark, sf, "documents").select(F.col("source").alias("paper_id")).distinct()).select("paper_id", T.id_month(F.col("paper_id")).alias("month"))


@query("norm_title", r"SELECT doc_id, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[^a-z0-9 ]', '', 'g') AS title FROM documents")
def norm_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.norm_title(F.col("text")).alias("title"))


@query("url_id", r"SELECT page_id, regexp_extract(u, 'arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})', 1) AS paper_id FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://arxiv.org/pdf/' || lpad((page_id % 9999)::VARCHAR, 4, '0') || '.12345v2' ELSE url END AS u FROM pages)")
def url_id(spark, sf):
    pages = table(spark, sf, "pages")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://arxiv.org/pdf/"), F.lpad((F.col("page_id") % 9999).cast("string"), 4, "0"), F.lit(".12345v2"))).otherwise(F.col("url"))
    return pages.select("page_id", T.url_id(url).alias("paper_id"))


@query("graph_key", "SELECT page_id, regexp_replace(k, '^concept:', '') AS key, regexp_extract(k, '^[^:]*:(.*)$', 1) AS bare FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'concept:' ELSE 'paper:' END || url AS k FROM pages)")
def graph_key(spark, sf):
    k = F.concat(F.when(F.col("page_id") % 2 == 0, "concept:").otherwise("paper:"), "url")
    return table(spark, sf, "pages").select("page_id", T.graph_key(k).alias("key"), T.after_prefix(k).alias("bare"))


@query("period_filter", f"WITH {FEED} SELECT entry_ord, published FROM feed WHERE coalesce(substr(published, 1, 7), '') = '' OR substr(published, 1, 7) BETWEEN '2005-03' AND '2016-08'")
def period_filter(spark, sf):
    return _feed(spark, sf).where(T.month_in(F.substring("published", 1, 7), "2005-03", "2016-08")).select("entry_ord", "published")


FOUND = f"""{FEED}, found AS (SELECT paper_id, query AS first_seen_query, published FROM (SELECT {NORM} AS paper_id, query, coalesce(substr(published, 1, 10), '') AS published, row_number() OVER (PARTITION BY {NORM} ORDER BY query_ord, entry_ord) AS rn
 FROM feed WHERE coalesce(substr(published, 1, 7), '') = '' OR substr(published, 1, 7) >= '2005-03') WHERE rn = 1)"""


def _found(spark, sf) -> DataFrame:
    return workflow.feed_entries(_feed(spark, sf), "2005-03")


@query("feed_dedup", f"WITH {FOUND} SELECT paper_id, first_seen_query, published FROM found")
def feed_dedup(spark, sf):
    return _found(spark, sf).select("paper_id", "first_seen_query", "published")


# Owned papers and past verdicts by the last digits of the id.
REASONS = f"{FOUND}, reason AS (SELECT paper_id, CASE WHEN right(paper_id, 1) IN ('1', '2') THEN 'owned' WHEN right(paper_id, 1) IN ('2', '3', '4') THEN 'gate' ELSE 'new' END AS reason FROM found)"


def _reasons(spark, sf) -> DataFrame:
    found = _found(spark, sf)
    last = F.right("paper_id", F.lit(1))
    return workflow.candidate_reasons(found, found.where(last.isin("1", "2")), found.where(last.isin("2", "3", "4")).select("paper_id", F.lit("Rejected").alias("verdict")))


@query("dedup_candidates", f"WITH {REASONS} SELECT paper_id, reason FROM reason")
def dedup_candidates(spark, sf):
    return _reasons(spark, sf).select("paper_id", "reason")


@query("dedup_counts", f"WITH {REASONS} SELECT count(*) AS found, count(*) FILTER (WHERE reason = 'owned') AS owned_excluded, count(*) FILTER (WHERE reason = 'gate') AS gate_excluded, count(*) FILTER (WHERE reason = 'new') AS new FROM reason")
def dedup_counts(spark, sf):
    return workflow.dedup_counts(_reasons(spark, sf))


# The gate: one session a source, labelled documents by id, passed where the quality is 1 and the id allows.
GATE = """c AS (SELECT source, l.doc_id AS rank, l.quality = 1 AND l.doc_id % 4 = 0 AS passed FROM labels l JOIN documents USING (doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS rn FROM c QUALIFY rn <= 50),
b AS (SELECT *, (rn - 1) // 10 AS batch FROM n),
judged AS (SELECT source, rank, passed, batch::INT AS batch FROM b WHERE coalesce((SELECT count(*) FROM b x WHERE x.source = b.source AND x.batch < b.batch AND x.passed), 0) < 4)"""


def _judged(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    c = table(spark, sf, "labels").join(docs, "doc_id").select("source", F.col("doc_id").alias("rank"), ((F.col("quality") == 1) & (F.col("doc_id") % 4 == 0)).alias("passed"))
    return workflow.gate_batches(c, 4, ("source",))


@query("gate_batches", f"WITH {GATE} SELECT source, rank, passed, batch FROM judged")
def gate_batches(spark, sf):
    return _judged(spark, sf).select("source", "rank", "passed", "batch")


@query("to_extract", f"WITH {GATE} SELECT source, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS r FROM judged WHERE passed) WHERE r <= 4")
def to_extract(spark, sf):
    return workflow.to_extract(_judged(spark, sf), 4, ("source",)).select("source", "rank")


@query("gate_cache", "SELECT d.doc_id AS paper_id, l.doc_id IS NOT NULL AS cached, coalesce(l.quality = 1, false) AS passed FROM documents d LEFT JOIN (SELECT * FROM labels WHERE doc_id % 2 = 0) l USING (doc_id)")
def gate_cache(spark, sf):
    papers = table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"))
    gates = table(spark, sf, "labels").select(F.col("doc_id").alias("paper_id"), F.when(F.col("doc_id") % 2 == 0, "v2").otherwise("v1").alias("prompt_ver"), F.when(F.col("quality") == 1, "technique").otherwise("other").alias("verdict"), F.lit(0).alias("judged_at"))
    return workflow.gate_cached(papers, gates, "v2").select("paper_id", "cached", "passed")


@query("extract_target", "SELECT event_id, least(coalesce(nullif(k, 0), 2), 10)::INT AS target FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 17 END AS k FROM events)")
def extract_target(spark, sf):
    count = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 17)
    return table(spark, sf, "events").select("event_id", T.extract_target(count).cast("int").alias("target"))


# Proposed queries: every sentence of a turn.
_GUARDED = r"""q AS (SELECT conv_id, turn * 100000 + i - 1 AS ord, trim(part) AS query FROM (SELECT conv_id, turn, unnest(string_split(text, '.')) AS part, generate_subscripts(string_split(text, '.'), 1) AS i FROM conversations)),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(query) ORDER BY ord) AS rn FROM q WHERE query <> '' AND len(string_split(trim(regexp_replace(query, '\s+', ' ', 'g')), ' ')) <= 6), g AS (SELECT conv_id AS session, ord, query FROM f WHERE rn = 1)"""


def _proposed(spark, sf) -> DataFrame:
    parts = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\.", -1)).alias("i", "query"))
    return parts.select(F.col("conv_id").alias("session"), (F.col("turn") * 100000 + F.col("i")).alias("ord"), "query")


@query("query_guard", f"WITH {_GUARDED} SELECT session, ord, query FROM g")
def query_guard(spark, sf):
    return workflow.guard_queries(_proposed(spark, sf))


@query("query_guard_few", f"WITH {_GUARDED} SELECT c.conv_id AS session, count(g.ord) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.session = c.conv_id GROUP BY 1 HAVING count(g.ord) < 3")
def query_guard_few(spark, sf):
    asked = _proposed(spark, sf)
    return workflow.too_few_queries(asked, workflow.guard_queries(asked))


@query("upsert_ledger", """WITH o AS (SELECT event_id AS paper_id, event_type AS title, 'old' AS verdict FROM events WHERE event_id % 3 <> 0), n AS (SELECT event_id AS paper_id, upper(event_type) AS title, NULL AS verdict FROM events WHERE event_id % 2 = 0)
SELECT coalesce(n.paper_id, o.paper_id) AS paper_id, coalesce(n.title, o.title) AS title, o.verdict FROM o FULL JOIN n ON n.paper_id = o.paper_id""")
def upsert_ledger(spark, sf):
    e = table(spark, sf, "events")
    old = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("paper_id"), F.col("event_type").alias("title"), F.lit("old").alias("verdict"))
    new = e.where("event_id % 2 = 0").select(F.col("event_id").alias("paper_id"), F.upper("event_type").alias("title"), F.lit(None).cast("string").alias("verdict"))
    return dml.upsert_ledger(old, new)


LEX = "lex AS (SELECT p_partkey, p_name || ' ' || p_partkey AS label, p_brand || ' ' || p_partkey AS alias, CASE p_type WHEN 'PROMO' THEN 'approved' WHEN 'STANDARD' THEN 'approved' WHEN 'SMALL' THEN 'unreviewed' WHEN 'LARGE' THEN 'pending' ELSE 'rejected' END AS status, CASE WHEN p_size % 7 = 0 THEN 'Def of ' || p_name || ' ' || p_partkey ELSE '' END AS definition FROM part WHERE p_type <> 'ECONOMY')"


@query("lexicon_list", f"WITH {LEX} SELECT label, status, alias AS aliases, definition FROM lex")
def lexicon_list(spark, sf):
    return enc.lexicon(spark, sf).select("label", "status", F.array_join("aliases", ";").alias("aliases"), F.coalesce("definition", F.lit("")).alias("definition"))


@query("status_counts", f"WITH {LEX} SELECT status, count(*) AS n FROM lex GROUP BY 1")
def status_counts(spark, sf):
    return views.status_counts(enc.lexicon(spark, sf))


def _plan(spark, sf) -> DataFrame:
    x = enc.lexicon(spark, sf)
    known = x.where("ord % 2 = 0").select("label", F.when(F.col("ord") % 4 == 0, "approved").otherwise("rejected").alias("new_status"))
    return known.unionByName(x.where("ord % 50 = 0").select(F.concat(F.lit("ghost "), "label").alias("label"), F.lit("approved").alias("new_status")))


PLAN = "plan AS (SELECT label, CASE WHEN p_partkey % 4 = 0 THEN 'approved' ELSE 'rejected' END AS new_status FROM lex WHERE p_partkey % 2 = 0 UNION ALL SELECT 'ghost ' || label, 'approved' FROM lex WHERE p_partkey % 50 = 0)"


@query("apply_plan", f"WITH {LEX}, {PLAN} SELECT label, coalesce(new_status, status) AS status, coalesce(new_status <> status, false) AS changed FROM lex LEFT JOIN plan USING (label)")
def apply_plan(spark, sf):
    return dml.apply_plan(enc.lexicon(spark, sf).select("label", "status"), _plan(spark, sf))


@query("plan_check", f"""WITH {LEX}, {PLAN} SELECT 'missing' AS problem, label FROM lex WHERE status = 'pending' AND label NOT IN (SELECT label FROM plan) UNION ALL SELECT 'unplanned', label FROM plan WHERE label NOT IN (SELECT label FROM lex)
UNION ALL SELECT 'not_pending', label FROM plan WHERE label IN (SELECT label FROM lex WHERE status <> 'pending')""")
def plan_check(spark, sf):
    x = enc.lexicon(spark, sf).select("label", "status")
    return dml.plan_problems(x.where("status = 'pending'").select("label"), _plan(spark, sf).select("label"), x)


@query("alias_union", f"WITH {LEX} SELECT label, CASE WHEN p_partkey % 2 = 0 THEN alias || ';' || 'src ' || label ELSE alias || ';other;src ' || label END AS aliases FROM lex")
def alias_union(spark, sf):
    src = F.when(F.col("ord") % 2 == 0, F.array(F.col("aliases")[0], "label")).otherwise(F.array(F.col("aliases")[0], F.lit("other")))
    out = dml.alias_union(F.col("aliases"), src, F.concat(F.lit("src "), "label"), F.col("label"))
    return enc.lexicon(spark, sf).select("label", F.array_join(out, ";").alias("aliases"))


@query("alias_edit", f"WITH {LEX} SELECT label, alias || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ';extra' END AS added, '' AS removed FROM lex")
def alias_edit(spark, sf):
    new = F.when(F.col("ord") % 3 == 0, F.col("aliases")[0]).otherwise(F.lit(" extra "))
    return enc.lexicon(spark, sf).select("label", F.array_join(dml.add_alias(F.col("aliases"), new), ";").alias("added"), F.array_join(dml.remove_alias(F.col("aliases"), F.col("aliases")[0]), ";").alias("removed"))


# Review cards: suppliers, their confidence by the nation.
CARDS = """card AS (SELECT s_name AS label, CASE s_suppkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'med' WHEN 2 THEN 'high' ELSE 'sure' END AS confidence, CASE s_nationkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'merge_into:' || s_name END AS action, s_suppkey % 5 <> 0 AS has_card FROM supplier)"""


def _cards(spark, sf) -> DataFrame:
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey") % 3
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("label"), F.when(k == 0, "low").when(k == 1, "med").when(k == 2, "high").otherwise("sure").alias("confidence"),
        F.when(n == 0, "approve").when(n == 1, "reject").otherwise(F.concat(F.lit("merge_into:"), "s_name")).alias("action"), (F.col("s_suppkey") % 5 != 0).alias("has_card"))


RANK = "CASE WHEN NOT has_card THEN 9 ELSE CASE confidence WHEN 'low' THEN 0 WHEN 'med' THEN 1 WHEN 'high' THEN 2 ELSE 3 END END"


@query("review_queue", f"WITH {CARDS} SELECT label, status, CASE WHEN has_card AND status IN ('pending', 'unreviewed') THEN {RANK} ELSE 9 END AS rank FROM (SELECT *, ['pending', 'unreviewed', 'approved'][(s_suppkey % 3 + 1)::INT] AS status FROM card JOIN supplier ON s_name = label) WHERE contains(lower(label), '1')")
def review_queue(spark, sf):
    status = F.element_at(F.array(*map(F.lit, ("pending", "unreviewed", "approved"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    items = table(spark, sf, "supplier").select(F.col("s_name").alias("label"), status.alias("status"))
    return review.queue(items, _cards(spark, sf).where("has_card"), text=" 1")


@query("review_report", f"""WITH {CARDS} SELECT (confidence = 'high')::INT AS part, CASE WHEN confidence = 'high' THEN action ELSE '' END AS grp, CASE confidence WHEN 'low' THEN 0 WHEN 'med' THEN 1 ELSE 0 END AS rank, label,
CASE WHEN confidence = 'high' THEN '- **' || label || '** (' || action || ') - why' ELSE '### ' || label || ' `pending`: **' || action || '**, ' || action || ', ' || confidence || ': why' END AS line FROM card WHERE confidence IN ('low', 'med', 'high')""")
def review_report(spark, sf):
    return review.report(_cards(spark, sf).withColumns({"status": F.lit("pending"), "category": F.col("action"), "reason": F.lit("why")}))


@query("attach_cards", f"WITH {CARDS}, {LEX} SELECT lex.label, card.action, card.confidence FROM lex LEFT JOIN (SELECT card.*, s_suppkey AS k FROM card JOIN supplier ON s_name = label WHERE has_card) card ON lex.p_partkey = card.k")
def attach_cards(spark, sf):
    keys = table(spark, sf, "supplier").select(F.col("s_name").alias("label"), F.col("s_suppkey").alias("k"))
    cards = _cards(spark, sf).where("has_card").join(keys, "label")
    named = enc.lexicon(spark, sf).select(F.col("ord").alias("k"), F.col("label").alias("name"))
    return review.attach_cards(enc.lexicon(spark, sf).select("label"), cards.join(named, "k").select(F.col("name").alias("label"), "action", "confidence")).select("label", "card.action", "card.confidence")


@query("lexicon_filter", f"WITH {LEX} SELECT label, status FROM lex WHERE status = 'pending' AND contains(lower(label), 'red')")
def lexicon_filter(spark, sf):
    return explore.filter_lexicon(enc.lexicon(spark, sf), "pending", " Red ").select("label", "status")


@query("merge_targets", f"WITH {LEX} SELECT label FROM lex WHERE p_partkey <> 1 AND contains(lower(label), 'bolt') ORDER BY label LIMIT 50")
def merge_targets(spark, sf):
    x = enc.lexicon(spark, sf)
    own = x.where("ord = 1").select("label").first()
    return explore.merge_targets(x, own["label"] if own else "", "bolt").select("label")


@query("paginate", f"WITH {CARDS} SELECT label FROM card ORDER BY {RANK}, label LIMIT 20 OFFSET (SELECT 20 * least(1, greatest(0, (count(*) - 1) // 20)) FROM card)")
def paginate(spark, sf):
    cards = _cards(spark, sf).withColumn("rank", review.queue_rank(F.col("confidence"), F.col("has_card")))
    return review.paginate(cards, ["rank", "label"], 1, 20, cards.count()).select("label")


@query("parse_action", f"WITH {CARDS} SELECT label, CASE WHEN starts_with(action, 'merge') THEN 'merge' ELSE action END AS kind, CASE WHEN starts_with(action, 'merge') THEN label END AS target FROM card")
def parse_action(spark, sf):
    return _cards(spark, sf).select("label", T.parse_action(F.col("action")).alias("x")).select("label", "x.kind", "x.target")


@query("review_summary", f"WITH {CARDS} SELECT count(*) AS n, count(*) FILTER (WHERE action = 'approve') AS approve, count(*) FILTER (WHERE action = 'reject') AS reject, count(*) FILTER (WHERE action LIKE 'merge%') AS merge, count(*) FILTER (WHERE confidence = 'low') AS low FROM card")
def review_summary(spark, sf):
    return review.review_summary(_cards(spark, sf))


@query("review_incremental", f"WITH {CARDS}, pend AS (SELECT label FROM card WHERE action <> 'reject') SELECT label, CASE WHEN has_card THEN 'kept' ELSE 'todo' END AS what FROM card WHERE label IN (SELECT label FROM pend)")
def review_incremental(spark, sf):
    c = _cards(spark, sf)
    return review.incremental(c.where("has_card").select("label"), c.where("action <> 'reject'").select("label"))


# Similar names: short names of parts (their words and initials), against those of approved ones.
@query("find_similar", """WITH a AS (SELECT DISTINCT p_name || ' mark ' || p_size AS label FROM part WHERE p_type = 'LARGE' UNION SELECT 'rw' UNION SELECT 'blue bolt'),
b AS (SELECT min(p_partkey) AS ord, label FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' mark' END AS label FROM part WHERE p_type IN ('PROMO', 'STANDARD')) GROUP BY label),
t AS (SELECT a.label AS al, b.label AS bl, ord, string_split(a.label, ' ') AS ta, string_split(b.label, ' ') AS tb FROM a, b WHERE a.label <> b.label),
i AS (SELECT *, list_aggregate(list_transform(ta, lambda x: x[1]), 'string_agg', '') AS ia, list_aggregate(list_transform(tb, lambda x: x[1]), 'string_agg', '') AS ib, len(list_intersect(ta, tb)) AS shared FROM t),
s AS (SELECT *, greatest(CASE WHEN (len(tb) = 1 AND ia = bl) OR (len(ta) = 1 AND ib = al) THEN 0.95 ELSE 0 END::DOUBLE, CASE WHEN shared = len(list_distinct(ta)) OR shared = len(list_distinct(tb)) THEN 0.8 ELSE 0 END::DOUBLE,
 CASE WHEN shared / (len(list_distinct(ta)) + len(list_distinct(tb)) - shared) >= 0.6 THEN shared / (len(list_distinct(ta)) + len(list_distinct(tb)) - shared) ELSE 0 END::DOUBLE) AS score FROM i)
SELECT al AS label, arg_max(bl, (score, -ord)) AS similar, round(max(score), 6) AS score FROM s WHERE score > 0 GROUP BY al""")
def find_similar(spark, sf):
    part = table(spark, sf, "part")
    a = part.where("p_type = 'LARGE'").select(F.concat_ws(" ", "p_name", F.lit("mark"), "p_size").alias("label")).union(spark.createDataFrame([("rw",), ("blue bolt",)], "label string")).distinct()
    b = part.where("p_type in ('PROMO', 'STANDARD')").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" mark"))).alias("label"))
    return review.find_similar(a, b.groupBy("label").agg(F.min("p_partkey").alias("ord")))


def _calls(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("stage"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").cast("decimal(18,6)").alias("seconds"))


@query("usage_by_stage", "SELECT event_type AS stage, grouping(event_type) = 1 AS all_stages, count(*) AS calls, sum((props ->> '$.k')::BIGINT)::BIGINT AS tokens, round_even(sum(value::DECIMAL(18, 6)), 3)::DOUBLE AS seconds FROM events GROUP BY GROUPING SETS ((event_type), ())")
def usage_by_stage(spark, sf):
    return workflow.usage_by_stage(_calls(spark, sf)).withColumn("seconds", F.col("seconds").cast("double"))


@query("session_state", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS stage FROM events GROUP BY 1")
def session_state(spark, sf):
    log = _calls(spark, sf).select("user_id", "event_id", "ts", "stage")
    return workflow.latest_state(log, "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "stage")


@query("usage_windows", "SELECT date_trunc('hour', ts) AS start, event_type AS stage, count(*) AS calls FROM events GROUP BY ALL")
def usage_windows(spark, sf):
    return ingest.windowed_usage(_calls(spark, sf)).select("start", "stage", "calls")


# Pages of a paper: turns of a conversation.
@query("page_prefix", """WITH p AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id AS doc_id, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM p WHERE before < 20000 GROUP BY 1""")
def page_prefix(spark, sf):
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return workflow.pages_prefix(pages).select("doc_id", F.md5("text").alias("digest"))


def _last_sql(mark: str) -> str:
    return f"CASE WHEN instr(reverse(h), reverse({mark})) = 0 THEN -1 ELSE length(h) - instr(reverse(h), reverse({mark})) - length({mark}) + 1 END"


# Documents with a heading of section 2 planted at their end, and where it stands behind the text: a usual
# title; another title after a sentence; one in mid-sentence (no heading); one with a third item close by (a
# list); after many blanks, many closing marks, a no-break space; and with an abstract's heading before the text.
PLANTED = (
    ("", "\n2 Related Work\nx", 1), ("", ".\n\n2. Our Things\nx", 3), ("", " and\n2. Our Things\nx", None), ("", ".\n2. Our Things\nx\n3. Other\n", None), ("", "." + " " * 70 + "\n" * 10 + "2. Our Things\nx", 81),
    ("", "." + '"' * 12 + "\n2. Our Things\nx", 14), ("", ".\xa0\n2. Our Things\nx", 3), ("Notes\nAbstract\n", ".\n2. Our Things\nx", 2),
)


def _by_id(values) -> str:
    return f"CASE doc_id % {len(PLANTED)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _quoted(t: str) -> str:
    return "'" + t.replace("\n", "' || chr(10) || '").replace("\xa0", "' || chr(160) || '") + "'"


@query("section_cut", f"""WITH t AS (SELECT doc_id, {_by_id(len(p) + (x or 0) if x else 'NULL' for p, _, x in PLANTED)} + length(text) AS heading, {_by_id(6 if p else 0 for p, _, _ in PLANTED)} AS start,
 {_by_id(_quoted(p) for p, _, _ in PLANTED)} || text || {_by_id(_quoted(t) for _, t, _ in PLANTED)} AS text FROM documents), d AS (SELECT *, substr(text, 1, 6000) AS h FROM t),
p AS (SELECT *, {_last_sql("'.' || chr(10)")} AS a, {_last_sql("'. '")} AS b, {_last_sql("chr(10) || chr(10)")} AS c FROM d),
q AS (SELECT *, coalesce(heading >= start + 3000, false) AS found FROM p)
SELECT doc_id, CASE WHEN found THEN 'section' ELSE 'head6000' END AS cut_method, md5(CASE WHEN found THEN substr(text, start + 1, heading - start) WHEN a > 3000 THEN substr(text, 1, a + 1) WHEN b > 3000 THEN substr(text, 1, b + 1) WHEN c > 3000 THEN substr(text, 1, c + 1) ELSE h END) AS digest FROM q""")
def section_cut(spark, sf):
    planted = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in PLANTED]), (F.col("doc_id") % len(PLANTED) + 1).cast("int"))
    cut = table(spark, sf, "documents").select("doc_id", sections.section_cut(F.concat(planted(0), "text", planted(1))).alias("x"))
    return cut.select("doc_id", "x.cut_method", F.md5("x.text").alias("digest"))


@query("boundary_cut", f"""WITH d AS (SELECT doc_id, text, substr(text, 1, 6000) AS h FROM documents), p AS (SELECT *, {_last_sql("'.' || chr(10)")} AS a, {_last_sql("'. '")} AS b, {_last_sql("chr(10) || chr(10)")} AS c FROM d)
SELECT doc_id, md5(CASE WHEN a > 3000 THEN substr(text, 1, a + 1) WHEN b > 3000 THEN substr(text, 1, b + 1) WHEN c > 3000 THEN substr(text, 1, c + 1) ELSE h END) AS digest FROM p""")
def boundary_cut(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.boundary_cut(F.col("text"))).alias("digest"))


@query("cut_signals", r"""SELECT doc_id, concat_ws(' ', CASE WHEN right(rtrim(text, ' '), 1) NOT IN ('.', '!', '?', '"', ')') THEN 'MIDSENT' END, CASE WHEN doc_id % 2 = 0 THEN 'FALLBACK' END,
 CASE WHEN regexp_matches(text, '(?im)^[ \t]*(2[\.\)]?[ \t]+[A-Z]|related\s+work|background|preliminaries)[ \t]*$') THEN 'OVERCAP' END, CASE WHEN length(text) < 3500 THEN 'SHORT' END,
 CASE WHEN NOT regexp_matches(right(text, 1200), '(?i)(contribution|in this (paper|work)|we (propose|present|introduce)|organized as follows|summariz|the remainder)') THEN 'NO_TAIL_HINT' END,
 CASE WHEN length(text) / greatest(n_chars * (doc_id % 30 + 1), 1) < 0.08 THEN 'LOWFRAC:' || printf('%.2f', length(text) / greatest(n_chars * (doc_id % 30 + 1), 1)) END) AS signals FROM documents""")
def cut_signals(spark, sf):
    d = table(spark, sf, "documents")
    method = F.when(F.col("doc_id") % 2 == 0, "head6000").otherwise("section")
    return d.select("doc_id", F.array_join(T.cut_signals(F.col("text"), method, F.col("n_chars") * (F.col("doc_id") % 30 + 1)), " ").alias("signals"))


_LEAKY = "text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '2. Background' || chr(10) || 'x' ELSE '' END"


@query("leak_check", rf"SELECT doc_id, regexp_matches({_LEAKY}, '(?im)^[ \t]*(?:\d{{1,4}}[ \t]*\n[ \t]*)?2[.)]?[ \t]*\n?[ \t]*(related works?|background)[ \t]*$') AS leaks, right({_LEAKY}, 1) IN ('.', '!', '?', '\"', ')') AS clean FROM documents".replace('\\"', '"'))
def leak_check(spark, sf):
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\n2. Background\nx").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", T.leaks_section(t).alias("leaks"), T.ends_clean(t).alias("clean"))


@query("rw_signals", r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 2) ELSE text END AS text, CASE WHEN doc_id % 2 = 0 THEN 'Related Work' || chr(10) || '[' || doc_id || '] ' ELSE '' END || text AS s FROM documents)
SELECT doc_id, length(s)::INT AS char_count, round(coalesce(1000.0 * len(regexp_extract_all(s, '\[\d+(?:,\s*\d+)*\]|\([A-Z][^()]*\d{4}[a-z]?\)')) / nullif(length(s), 0), 0), 6)::DOUBLE AS citation_density, contains(text, s) AS verbatim_match, regexp_matches(s, '(?i)^\s*(?:\d+\.?\s*)?(related works?|background)') AS heading_found FROM d""")
def rw_signals(spark, sf):
    d = table(spark, sf, "documents")
    s = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Related Work\n["), "doc_id", F.lit("] "))).otherwise(""), "text")
    source = F.when(F.col("doc_id") % 3 == 0, F.expr("substring(text, 2)")).otherwise(F.col("text"))
    return d.select("doc_id", T.related_work_signals(s, source).alias("x")).select("doc_id", "x.*")


@query("batch_plan", "SELECT doc_id AS paper_id, source AS grp, CASE WHEN doc_id % 3 = 0 THEN 'exists' WHEN doc_id % 4 = 0 THEN 'missing_input' ELSE 'run' END AS action FROM documents WHERE source IN ('src1', 'src2')")
def batch_plan(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("grp"))
    return workflow.batch_plan(d.where("grp in ('src1', 'src2')"), d.where("paper_id % 4 <> 0"), d.where("paper_id % 3 = 0"))


@query("worksheet", "SELECT doc_id, '## ' || doc_id || ' ' || lang || chr(10) || quality || chr(10) AS sheet FROM documents JOIN labels USING (doc_id)")
def worksheet(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return workflow.worksheet(both, ["doc_id", "lang"], ["quality"]).select("doc_id", "sheet")


@query("paper_detail", r"SELECT doc_id, md5(trim(substr(text, 1, 1800), chr(32) || chr(10))) AS digest FROM documents")
def paper_detail(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.excerpt(F.col("text"))).alias("digest"))


# Markdown: documents as files of lines; every line is a heading, a bullet or a table row in turn.
def _lines(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    n = F.col("line_no")
    head = F.concat(F.repeat(F.lit("#"), n % 4 + 1), F.lit(" H"), n.cast("string"), F.lit(" "), "raw")
    bullet = F.concat(F.lit("- see [T"), n.cast("string"), F.lit("](http://x/"), n.cast("string"), F.lit(") "), "raw")
    cells = F.concat(F.lit("| a "), n.cast("string"), F.lit(" | b "), F.replace("raw", F.lit("|"), F.lit("/")), F.lit(" |"))
    return d.select("file", "line_no", F.when(n % 3 == 0, head).when(n % 3 == 1, bullet).otherwise(cells).alias("value"))


MD = """r AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT file, line_no, raw, CASE WHEN line_no % 3 = 0 THEN line_no % 4 + 1 ELSE 0 END AS level, lpad(line_no::VARCHAR, 9, '0') || trim('H' || line_no || ' ' || raw) AS title FROM r),
h AS (SELECT *, max(CASE WHEN level = 1 THEN line_no END) OVER w AS r2, max(CASE WHEN level = 2 THEN title END) OVER w AS m2, max(CASE WHEN level BETWEEN 1 AND 2 THEN line_no END) OVER w AS r3, max(CASE WHEN level = 3 THEN title END) OVER w AS m3 FROM l WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""


@query("md_sections", f"WITH {MD} SELECT file, line_no::INT AS line_no, CASE WHEN left(m2, 9)::INT > coalesce(r2, -1) THEN substr(m2, 10) END AS h2, CASE WHEN left(m3, 9)::INT > coalesce(r3, -1) THEN substr(m3, 10) END AS h3 FROM h")
def md_sections(spark, sf):
    return files.markdown_sections(_lines(spark, sf)).select("file", "line_no", "h2", "h3")


@query("md_bullets", f"WITH {MD} SELECT file, line_no::INT AS line_no, 'T' || line_no AS title, 'http://x/' || line_no AS url FROM h WHERE line_no % 3 = 1")
def md_bullets(spark, sf):
    return files.markdown_bullets(files.markdown_sections(_lines(spark, sf))).select("file", "line_no", "title", "url")


@query("md_table", f"WITH {MD} SELECT file, line_no::INT AS line_no, 'a ' || line_no || ';' || trim('b ' || replace(raw, '|', '/')) AS cells FROM h WHERE line_no % 3 = 2")
def md_table(spark, sf):
    return files.markdown_table(_lines(spark, sf)).select("file", "line_no", F.array_join("cells", ";").alias("cells"))


SECTIONS = ("Retrieval Optimization", "Memory modules", "Query planning", "Multi and agent", "Benchmarks", "Tool and knowledge", "Other")
_S = "['" + "', '".join(SECTIONS) + "']"
_TAGGED = f"r AS (SELECT doc_id AS ord, 's' || (doc_id % 4 + 1) AS source, {_S}[(doc_id % 7 + 1)::INT] AS section, text AS title, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN source ELSE source || '.' || doc_id % 10 END AS paper_id FROM documents)"
_TAG = "CASE source || section WHEN 's1Retrieval Optimization' THEN '질의계획' WHEN 's1Benchmarks' THEN '평가' WHEN 's2Benchmarks' THEN '평가' WHEN 's3Benchmarks' THEN '평가' WHEN 's2Query planning' THEN '질의계획' WHEN 's2Memory modules' THEN '메모리' WHEN 's3Multi and agent' THEN '에이전트오케스트레이션' WHEN 's3Tool and knowledge' THEN 'RAG강화추론' ELSE '기타' END"
_NT = r"regexp_replace(lower(trim(regexp_replace(title, '\s+', ' ', 'g'))), '[^a-z0-9 ]', '', 'g')"
_FILLED = f"{_TAGGED}, k AS (SELECT {_NT} AS key, arg_min(paper_id, ord) AS found FROM r WHERE paper_id <> '' GROUP BY 1), f AS (SELECT r.ord, r.title, r.source, {_TAG} AS tag, coalesce(nullif(r.paper_id, ''), k.found, '') AS paper_id FROM r LEFT JOIN k ON k.key = {_NT})"
_LISTED = "list_aggregate(list_filter([{0}], lambda x: list_contains(list(DISTINCT {1}), x)), 'string_agg', ';')"
_MERGED = (
    f"{_FILLED}, mg AS (SELECT CASE WHEN paper_id <> '' THEN 'id ' || paper_id ELSE 'ti ' || {_NT} END AS key, arg_max(title, (length(title), -ord)) AS title, max(paper_id) AS paper_id, list(DISTINCT source) AS ss, list(DISTINCT tag) AS ts FROM f GROUP BY 1),"
    " merged AS (SELECT title, paper_id, list_aggregate(list_filter(['s1', 's2', 's3', 's4'], lambda x: list_contains(ss, x)), 'string_agg', ';') AS source,"
    f" list_aggregate(list_filter(['{chr(39) + ', ' + chr(39)}'], lambda x: list_contains(ts, x)), 'string_agg', ';') AS tag FROM mg)"
).replace("['', '']", "['" + "', '".join(candidates.TAGS) + "']")


def _records(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (d % 7 + 1).cast("int"))
    pid = F.when(d % 5 == 0, "").when(d % 5 == 1, F.col("source")).otherwise(F.concat("source", F.lit("."), d % 10))
    rows = table(spark, sf, "documents").select(d.alias("ord"), F.concat(F.lit("s"), d % 4 + 1).alias("src"), section.alias("section"), F.col("text").alias("title"), pid.alias("paper_id"))
    return rows.select("ord", "title", "paper_id", F.col("src").alias("source"), candidates.section_tag(F.col("src"), F.col("section")).alias("tag"))


@query("section_tag", f"WITH {_TAGGED} SELECT ord, source, {_TAG} AS tag FROM r")
def section_tag(spark, sf):
    return _records(spark, sf).select("ord", "source", "tag")


@query("backfill", f"WITH {_FILLED} SELECT ord, paper_id FROM f")
def backfill(spark, sf):
    return candidates.backfill(_records(spark, sf)).select("ord", "paper_id")


@query("merge_candidates", f"WITH {_MERGED} SELECT title, paper_id, source, tag FROM merged")
def merge_candidates(spark, sf):
    return candidates.merge(candidates.backfill(_records(spark, sf)))


@query("candidates_listed", f"WITH {_MERGED} SELECT title, paper_id, source, tag, row_number() OVER (PARTITION BY source ORDER BY tag, lower(title), title, paper_id) AS place FROM merged")
def candidates_listed(spark, sf):
    """Candidates with their place among those of their sources."""
    merged = candidates.merge(candidates.backfill(_records(spark, sf)))
    return merged.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(*candidates.by_place(merged)[1:])))


def _flagged(spark, sf) -> DataFrame:
    corpus = table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("source").alias("paper_id"))
    return candidates.in_corpus(candidates.merge(candidates.backfill(_records(spark, sf))), corpus)


_FLAG = "CASE WHEN paper_id <> '' AND paper_id IN (SELECT source FROM documents WHERE doc_id % 2 = 0) THEN 'yes' ELSE 'no' END"


@query("in_corpus", f"WITH {_MERGED} SELECT title, paper_id, {_FLAG} AS in_corpus FROM merged")
def in_corpus(spark, sf):
    return _flagged(spark, sf).select("title", "paper_id", "in_corpus")


@query("candidate_pool", f"WITH {_MERGED} SELECT title, paper_id FROM merged WHERE {_FLAG} = 'no' AND paper_id <> '' AND list_has_any(string_split(tag, ';'), ['질의계획', '평가'])")
def candidate_pool(spark, sf):
    return candidates.pool(_flagged(spark, sf), ("질의계획", "평가")).select("title", "paper_id")


@query("candidate_stats", f"WITH {_MERGED} SELECT split_part(tag, ';', 1) AS tag, count(*) AS n, count(*) FILTER (WHERE paper_id <> '') AS n_with_id FROM merged GROUP BY 1")
def candidate_stats(spark, sf):
    return candidates.stats(_flagged(spark, sf))


@query("abbreviate", "SELECT event_id, CASE WHEN n >= 1000 THEN ((n + 50) // 1000) || '.' || ((n + 50) // 100 % 10) || 'k' ELSE n::VARCHAR END AS shown FROM (SELECT event_id, event_id * 7 AS n FROM events)")
def abbreviate(spark, sf):
    return table(spark, sf, "events").select("event_id", T.abbreviated(F.col("event_id") * 7).alias("shown"))


@query("deterministic_sample", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 90")
def deterministic_sample(spark, sf):
    return candidates.sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 90)


@query("report_lines", "SELECT '- ' || event_type || ': ' || count(*) AS value FROM events GROUP BY event_type")
def report_lines(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return files.report_lines(counts, "- %s: %d", "event_type", "n")


@query("gate_summary", f"WITH {GATE} SELECT source, CASE WHEN passed THEN 'passed' ELSE 'failed' END AS part, count(*) AS n FROM judged GROUP BY ALL")
def gate_summary(spark, sf):
    judged = _judged(spark, sf).withColumn("paper_id", F.struct("source", "rank"))
    return workflow.gate_summary(judged).groupBy("paper_id.source", "part").agg(F.count("*").alias("n"))


@query("corpus_ids", "SELECT doc_id AS paper_id FROM documents UNION SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark")
def corpus_ids(spark, sf):
    ids = lambda name, c: table(spark, sf, name).select(F.col(c).alias("paper_id"))
    return candidates.corpus_ids(ids("documents", "doc_id"), ids("labels", "doc_id"), ids("benchmark", "item_id"))


@query("tool_args", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 1 THEN '{}' ELSE replace(props, ' ', '') END AS args, CASE WHEN event_id % 3 = 2 THEN 'cannot parse tool arguments: ' || props || '{' END AS error FROM events")
def tool_args(spark, sf):
    e = table(spark, sf, "events")
    given = F.when(F.col("event_id") % 3 == 2, F.concat("props", F.lit("{"))).when(F.col("event_id") % 3 == 0, F.col("props"))
    return e.select("event_id", T.tool_args(given).alias("x")).select("event_id", "x.*")


@query("csv_round_trip", "SELECT doc_id, md5(text) AS digest, source FROM documents")
def csv_round_trip(spark, sf):
    path = scratch(spark)
    files.write_csv(table(spark, sf, "documents").select("doc_id", "text", "source"), path)
    return files.read_csv(spark, path, "doc_id long, text string, source string").select("doc_id", F.md5("text").alias("digest"), "source")


@query("ledger", "SELECT event_id AS paper_id, event_type AS verdict FROM events")
def ledger(spark, sf):
    catalog = Catalog(spark, scratch(spark))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("paper_id"), F.col("event_type").alias("verdict"))
    catalog.append("ledger", rows.where("paper_id % 2 = 0"))
    catalog.append("ledger", rows.where("paper_id % 2 = 1"))
    return catalog.read("ledger")


@query("parsed_scan", "SELECT doc_id::VARCHAR AS paper_id, length(text)::INT AS char_count, md5(text) AS digest FROM documents")
def parsed_scan(spark, sf):
    path = scratch(spark)
    table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.lit(True).alias("ok"), F.length("text").alias("char_count"), "text").write.json(path)
    return files.parsed_lines(spark, path).select("paper_id", "char_count", F.md5("text").alias("digest"))


@query("table_links", "SELECT doc_id AS file, 'T' || doc_id AS title, 'http://x/' || doc_id AS url FROM documents")
def table_links(spark, sf):
    d = F.col("doc_id").cast("string")
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.lit(0).alias("line_no"), F.concat(F.lit("| a | [T"), d, F.lit("](http://x/"), d, F.lit(") more |")).alias("value"))
    return files.table_links(files.markdown_table(lines)).select("file", "title", "url")


@query("status_report", "SELECT 0 AS part, 'Topic: t' AS line UNION ALL SELECT 1, 'Known concepts:' UNION ALL SELECT 2, 'Known papers:' UNION ALL SELECT 1, '- ' || s_name || ': ' || CASE WHEN s_suppkey % 2 = 0 THEN 'def' ELSE '(no definition)' END || ' [0.50]' FROM supplier UNION ALL SELECT 2, '- ' || r_name || ': p [0.25]' FROM region")
def status_report(spark, sf):
    s, r = table(spark, sf, "supplier"), table(spark, sf, "region")
    concepts = s.select(workflow.hit_line(F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, " def "), F.lit(0.5), "(no definition)").alias("line"), F.lit(0.5).alias("score"))
    papers = r.select(workflow.hit_line(F.col("r_name"), F.lit("p"), F.lit(0.25), "").alias("line"), F.lit(0.25).alias("score"))
    return workflow.status_report("t", concepts, papers).select("part", "line")


@query("usage_log", "SELECT 'gate' AS stage, false AS all_stages, count(*) AS calls FROM documents WHERE text IS NOT NULL UNION ALL SELECT NULL, true, count(*) FROM documents WHERE text IS NOT NULL")
def usage_log(spark, sf):
    told = annotators.ask(table(spark, sf, "documents"), prompts.GATE, F.col("source"), F.col("text"), id_col="doc_id")
    return workflow.usage_by_stage(annotators.usage_log(told, "gate")).select("stage", "all_stages", "calls")


@query("gate_annotator", "SELECT doc_id AS id, CASE WHEN regexp_matches(t, 'survey|review of') THEN 'survey' WHEN regexp_matches(t, 'benchmark|dataset') THEN 'benchmark' WHEN regexp_matches(t, 'analysis|we study') THEN 'analysis' ELSE 'technique' END AS type FROM (SELECT doc_id, lower(concat_ws(chr(10), source, text)) AS t FROM documents)")
def gate_annotator(spark, sf):
    return annotators.ask(table(spark, sf, "documents"), prompts.GATE, F.col("source"), F.col("text"), id_col="doc_id").where("ok").select("id", "type")
