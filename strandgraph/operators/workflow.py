"""The ingestion workflow: search results, duplicates, the gate, sessions, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions.text import month_in, norm_id, squeezed

GATE_BATCH, GATE_MAX_BATCHES = 10, 5
#: Verdicts that exclude a paper for good. Verdicts of the gate itself are paper types, so this
#: only acts on ledgers that hold such words.
REJECT_VERDICTS = ("reject", "rejected", "drop")


def feed_entries(raw: DataFrame, period_from: str | None = None, period_to: str | None = None) -> DataFrame:
    """Search results (query_ord, entry_ord, query, id, title, summary, published) as candidates.

    Ids lose versions, texts their line breaks; results outside the period are out, and of a paper
    found by several queries the first counts.
    """
    entries = raw.select(norm_id(F.col("id")).alias("paper_id"), "query_ord", "entry_ord", F.col("query").alias("first_seen_query"), squeezed(F.coalesce("title", F.lit(""))).alias("title"), squeezed(F.coalesce("summary", F.lit(""))).alias("abstract"), F.substring(F.coalesce("published", F.lit("")), 1, 10).alias("published"))
    kept = entries.where((F.col("paper_id") != "") & month_in(F.substring("published", 1, 7), period_from, period_to))
    first = Window.partitionBy("paper_id").orderBy("query_ord", "entry_ord")
    return kept.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def candidate_reasons(found: DataFrame, owned: DataFrame, ledger: DataFrame, rejects: tuple[str, ...] = REJECT_VERDICTS) -> DataFrame:
    """found (paper_id) with reason: 'owned', else 'gate', else 'new'."""
    have = owned.select("paper_id", F.lit(True).alias("is_owned")).distinct()
    gone = ledger.where(F.lower("verdict").isin(*rejects)).select("paper_id", F.lit(True).alias("is_gone")).distinct()
    reason = F.when(F.col("is_owned"), "owned").when(F.col("is_gone"), "gate").otherwise("new")
    return found.join(have, "paper_id", "left").join(gone, "paper_id", "left").withColumn("reason", reason).drop("is_owned", "is_gone")


def dedup_counts(reasons: DataFrame) -> DataFrame:
    is_ = lambda r: F.count_if(F.col("reason") == r)
    return reasons.agg(F.count("*").alias("found"), is_("owned").alias("owned_excluded"), is_("gate").alias("gate_excluded"), is_("new").alias("new"))


def gate_batches(candidates: DataFrame, target: int, by: tuple[str, ...] = (), batch: int = GATE_BATCH, most: int = GATE_MAX_BATCHES) -> DataFrame:
    """The candidates (rank, passed) that the gate gets to judge, with their batch.

    It works in batches by rank and stops after the one that reaches the target. Only the first
    batch * most candidates of a session (columns by) can be judged, so they are cut off first.
    """
    order = Window.partitionBy(*by).orderBy("rank")
    head = candidates.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= batch * most)
    numbered = head.withColumn("batch", F.floor((F.col("rn") - 1) / batch).cast("int"))
    before = F.coalesce(F.sum(F.col("passed").cast("int")).over(Window.partitionBy(*by).orderBy("batch").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.withColumn("before", before).where(F.col("before") < target).drop("before", "rn")


def to_extract(judged: DataFrame, target: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The first target passed candidates."""
    order = Window.partitionBy(*by).orderBy("rank")
    return judged.where("passed").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= target).drop("rn")


def gate_cached(papers: DataFrame, gates: DataFrame, prompt_version: str) -> DataFrame:
    """papers with the verdict of this prompt version, if there is one, and whether it was cached."""
    known = gates.where(F.col("prompt_ver") == prompt_version).groupBy("paper_id").agg(F.max_by("verdict", "judged_at").alias("verdict"))
    return papers.join(known, "paper_id", "left").withColumns({"cached": F.col("verdict").isNotNull(), "passed": F.coalesce(F.col("verdict") == "technique", F.lit(False))})


def guard_queries(queries: DataFrame, max_words: int = 6) -> DataFrame:
    """(session, ord, query): trimmed, not empty, at most max_words, first of its kind in any case."""
    q = F.trim("query")
    fit = queries.select("session", "ord", q.alias("query")).where((q != "") & (F.size(F.split(squeezed(q), " ")) <= max_words))
    first = Window.partitionBy("session", F.lower("query")).orderBy("ord")
    return fit.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def too_few_queries(asked: DataFrame, kept: DataFrame, least: int = 3) -> DataFrame:
    """(session, n): the sessions of which fewer than least queries were kept, for a warning."""
    n = kept.groupBy("session").agg(F.count("*").alias("n"))
    return asked.select("session").distinct().join(n, "session", "left").select("session", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def worksheet(papers: DataFrame, head: list, body: list) -> DataFrame:
    """papers with sheet: a Markdown block for labelling by hand, a heading of columns and a line of others."""
    return papers.withColumn("sheet", F.concat(F.lit("## "), F.concat_ws(" ", *head), F.lit("\n"), F.concat_ws(" ", *body), F.lit("\n")))


def gate_summary(judged: DataFrame) -> DataFrame:
    """(paper_id, part): what the gate let through and what not, for the approval of the extraction."""
    return judged.select("paper_id", F.when(F.coalesce("passed", F.lit(False)), "passed").otherwise("failed").alias("part"))


def hit_line(name: Column, said: Column, score: Column, missing: str) -> Column:
    """One line of what the graph already knows: a concept with its definition, a paper with its problem."""
    told = F.coalesce(F.nullif(F.trim(said), F.lit("")), F.lit(missing))
    return F.concat(F.lit("- "), name, F.lit(": "), told, F.format_string(" [%.2f]", score))


def status_report(topic: str, concepts: DataFrame, papers: DataFrame) -> DataFrame:
    """(part, ord, line): topic, then known concepts and papers (line, score), best first, for a report."""
    head = lambda part, text: topic_frame.select(F.lit(part).alias("part"), F.lit(-1.0).alias("ord"), F.lit(text).alias("line"))
    topic_frame = concepts.sparkSession.range(1)
    listed = lambda d, part: d.select(F.lit(part).alias("part"), (1 - F.col("score")).cast("double").alias("ord"), "line")
    out = head(0, f"Topic: {topic}")
    for part, title, rows in ((1, "Known concepts:", concepts), (2, "Known papers:", papers)):
        out = out.unionByName(head(part, title)).unionByName(listed(rows, part))
    return out


def latest_state(log: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def usage_by_stage(log: DataFrame) -> DataFrame:
    """Calls, tokens and seconds by stage, and in all (all_stages; a null stage is a stage)."""
    return log.rollup("stage").agg((F.grouping("stage") == 1).alias("all_stages"), F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.bround(F.sum("seconds"), 3).alias("seconds"))


def pages_prefix(pages: DataFrame, limit: int = 20_000) -> DataFrame:
    """(doc_id, text): leading pages (page_no, text) until limit characters are reached."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = pages.withColumn("before", before).where(F.col("before") < limit)
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "").alias("text"))


def batch_plan(wanted: DataFrame, inputs: DataFrame, done: DataFrame) -> DataFrame:
    """wanted (paper_id, grp) with what to do: 'exists', 'missing_input' or 'run'."""
    have = inputs.select("paper_id", F.lit(True).alias("has")).distinct()
    made = done.select("paper_id", F.lit(True).alias("made")).distinct()
    action = F.when(F.col("made"), "exists").when(F.col("has").isNull(), "missing_input").otherwise("run")
    return wanted.join(have, "paper_id", "left").join(made, "paper_id", "left").withColumn("action", action).drop("has", "made")


def stage_after(stage: str, decision: str) -> str:
    """The workflow's next stage. Cancelling ends in the report, wherever it happens."""
    if decision == "cancel":
        return "report"
    return {"interpret": {"revise": "parse", "proceed": "expand"}, "approve": {"proceed": "gate"}, "extract_confirm": {"proceed": "extract"}}.get(stage, {}).get(decision, "report")
