"""Queries over work in progress: the judged queue, sessions as keyed state, calls that fail, with their twins."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions import annotators, prompts
from strandgraph.operators import explore, queue
from strandgraph.plans.encoding import table
from strandgraph.sources.durable import scratch, stored
from strandgraph.streaming import sessions

QUERIES, ORACLE_SQL = {}, {}


def _q(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


# The queue: every source is a session that has found its documents in order of their ids.
_VERDICT = "CASE WHEN regexp_matches(t, 'survey|review of') THEN 'survey' WHEN regexp_matches(t, 'benchmark|dataset') THEN 'benchmark' WHEN regexp_matches(t, 'analysis|we study') THEN 'analysis' ELSE 'technique' END"


@_q("gate_session", f"""WITH c AS (SELECT source, doc_id, 2 + length(source) % 3 * 12 AS target, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS batch, doc_id % 3 = 0 AS cached,
 CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'technique' ELSE 'survey' END ELSE {_VERDICT} END AS verdict
 FROM (SELECT *, lower(concat_ws(chr(10), CASE WHEN doc_id % 4 = 1 THEN 'A survey' WHEN doc_id % 4 = 2 THEN 'Dataset' ELSE lang END, text)) AS t FROM documents)),
s AS (SELECT *, coalesce(sum((verdict = 'technique')::INT) OVER (PARTITION BY source ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE batch < 5)
SELECT source, doc_id, batch::INT AS batch, cached, verdict, verdict = 'technique' AS passed FROM s WHERE before < target""")
def gate_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    found = docs.select("source", n.alias("paper_id"), n.alias("rank"), F.when(n % 4 == 1, "A survey").when(n % 4 == 2, "Dataset").otherwise(F.col("lang")).alias("title"), F.col("text").alias("abstract"))
    version = F.when(n % 3 == 0, prompts.GATE.version).otherwise("an older one")
    cache = docs.select(n.alias("paper_id"), version.alias("prompt_ver"), F.when(n % 2 == 0, "technique").otherwise("survey").alias("verdict"))
    target = 2 + F.length("source") % 3 * 12
    done = queue.judge(found, cache, prompts.GATE, F.col("title"), F.col("abstract"), by=("source",), target=target)
    return done.rows.select("source", F.col("paper_id").alias("doc_id"), "batch", "cached", "verdict", "passed")


# Sessions: a user's events are a thread's decisions; a tenth of them arrive twice.
_DECISIONS = {"view": "proceed", "click": "proceed", "purchase": "proceed", "signup": "revise", "error": "cancel"}
_DECISION_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DECISIONS.items()) + " END"
_NEXT_SQL = """CASE WHEN {0} = 'report' THEN 'interpret' WHEN {1} = 'cancel' THEN 'report' WHEN {0} = 'interpret' AND {1} = 'revise' THEN 'interpret'
 WHEN {0} = 'interpret' AND {1} = 'proceed' THEN 'approve' WHEN {0} = 'approve' AND {1} = 'proceed' THEN 'extract_confirm' ELSE 'report' END"""
_MID = "CASE WHEN o.ms >= w.ms + 86400000 THEN 'report' ELSE w.stage END"


@_q("session_steps", f"""WITH RECURSIVE o AS (SELECT user_id, event_id, {_DECISION_SQL} AS decision, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS rn FROM events),
w AS (SELECT user_id, rn, event_id, decision, ms, 'interpret' AS stage, 1 AS seq, NULL::BIGINT AS expired_ms FROM o WHERE rn = 1
 UNION ALL SELECT o.user_id, o.rn, o.event_id, o.decision, o.ms, {_NEXT_SQL.format(f'({_MID})', 'o.decision')},
  w.seq + 1 + (o.ms >= w.ms + 86400000 AND w.stage <> 'report')::INT, CASE WHEN o.ms >= w.ms + 86400000 AND w.stage <> 'report' THEN w.ms + 86400000 END
 FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1),
e AS (SELECT max(epoch_us(ts) // 1000) - 3600000 AS mark FROM events),
l AS (SELECT w.* FROM w JOIN (SELECT user_id, max(rn) AS rn FROM w GROUP BY 1) USING (user_id, rn))
SELECT user_id, seq, event_id::VARCHAR AS event_id, decision, stage FROM w
UNION ALL SELECT user_id, seq - 1, NULL, 'expired', 'report' FROM w WHERE expired_ms IS NOT NULL
UNION ALL SELECT user_id, seq + 1, NULL, 'expired', 'report' FROM l, e WHERE stage <> 'report' AND ms + 86400000 <= mark""")
def session_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream through the keyed state machine; a tenth arrives twice and makes no step."""
    decided = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _DECISIONS.items()])
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), decided.alias("decision"))
    given, out = scratch(spark), scratch(spark)
    events.unionByName(events.where("event_id % 10 = 3")).write.parquet(given)
    sessions.run(spark.readStream.schema(spark.read.parquet(given).schema).parquet(given), out, scratch(spark), idle=timedelta(days=1))
    return spark.read.parquet(out).select(F.col("thread_id").alias("user_id"), F.col("seq").cast("int").alias("seq"), "event_id", "decision", "stage")


def _odd_call(texts: list[str]) -> list[dict]:
    """A call with all the faults: one answer too few, one too many, a refusal, and texts that always fail."""
    if any(t.startswith("2") for t in texts):
        raise ValueError("refused")
    answers = [{"n": len(t), "first": t[:1]} for t in texts]
    if len(texts) > 1 and any(t.startswith("3") for t in texts):
        return answers[1:]
    return [*answers, answers[0]] if any(t.startswith("4") for t in texts) else answers


@_q("calls_isolated", """SELECT doc_id AS id, d NOT IN (2, 4) AS ok, CASE d WHEN 2 THEN 'refused' WHEN 4 THEN '2 answers to 1 texts' END AS error,
 CASE WHEN d NOT IN (2, 4) THEN length(text) + 1 END AS n, CASE WHEN d NOT IN (2, 4) THEN d::VARCHAR END AS first FROM (SELECT *, doc_id % 10 AS d FROM documents)""")
def calls_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers stay with their rows whatever calls do; rows whose call fails have the reason."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id") % 10, "text").alias("text"))
    told = annotators.annotate(rows, _odd_call, "n int, first string", "v1", batch=7, id_col="doc_id", concurrent=3, retries=1, backoff=0.0)
    return told.select("id", "ok", "error", "n", "first")


@_q("hit_terms", """WITH h AS (SELECT 'concept' AS kind, s_suppkey AS id, s_name AS name, round(1.0 / (1 + s_suppkey % 97), 3) AS score FROM supplier WHERE s_suppkey % 2 = 0
 UNION ALL SELECT 'paper', c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, round(1.0 / (1 + c_custkey % 89), 3) FROM customer)
SELECT row_number() OVER (ORDER BY kind, score DESC, id::VARCHAR)::INT AS ord, name AS term FROM h WHERE name <> '' QUALIFY ord <= 60""")
def hit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits joined with what they are: names of concepts, then titles of papers, best first."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    score = lambda x, n: F.bround(1.0 / (1 + F.col(x) % n), 3)
    hits = s.select(F.lit("concept").alias("kind"), F.col("s_suppkey").alias("node_id"), score("s_suppkey", 97).alias("score")).unionByName(c.select(F.lit("paper").alias("kind"), F.col("c_custkey").alias("node_id"), score("c_custkey", 89).alias("score")))
    nodes = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("rk"), F.col("s_name").alias("canonical"), F.lit("").alias("definition"))
    papers = c.select(F.col("c_custkey").alias("paper_id"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("title"), F.lit("").alias("problem"))
    return explore.hit_terms(stored(explore.with_metadata(hits, nodes, papers)), 60)


@_q("fill_missing", """SELECT doc_id AS id, CASE WHEN regexp_matches(lower(text), 'survey|review of') THEN 'survey' WHEN regexp_matches(lower(text), 'benchmark|dataset') THEN 'benchmark' WHEN regexp_matches(lower(text), 'analysis|we study') THEN 'analysis' ELSE 'technique' END AS type
FROM documents WHERE doc_id % 6 NOT IN (0, 4)""")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what this version hasn't answered is asked: even rows have been, but every third of them failed."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    done = docs.select(n.alias("id"), F.when(n % 2 == 0, prompts.GATE.version).otherwise("old").alias("prompt_ver"), (n % 3 != 2).alias("ok"))
    return annotators.fill(docs, done, prompts.GATE, F.lit(None).cast("string"), F.col("text"), id_col="doc_id").select("id", "type")
