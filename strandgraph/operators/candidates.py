"""Candidate papers from survey lists: tags, ids by title, merged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.text import norm_title

OTHER = "기타"
#: (survey, words of the section that must all occur, tag): the first rule that fits (fixed values).
TAG_RULES = (
    ("s1", ("retrieval optimization",), "질의계획"),
    ("s1", ("integration enhancement",), "정보필터링"),
    ("s1", ("generation enhancement",), "생성"),
    ("s1", ("knowledge base",), "그래프RAG"),
    ("s1", ("web retrieval",), "RAG강화추론"),
    ("s1", ("tool using",), "RAG강화추론"),
    ("s1", ("prior experience",), "메모리"),
    ("s1", ("example or training",), "RAG강화추론"),
    ("s1", ("chain-based",), "추론워크플로우"),
    ("s1", ("tree-based",), "추론워크플로우"),
    ("s1", ("graph-based",), "그래프RAG"),
    ("s1", ("single-agent",), "에이전트오케스트레이션"),
    ("s1", ("multi-agent",), "에이전트오케스트레이션"),
    ("s1", ("benchmark",), "평가"),
    ("s1", ("dataset",), "평가"),
    ("s2", ("query planning",), "질의계획"),
    ("s2", ("knowledge boundary",), "지식경계"),
    ("s2", ("retrieval timing",), "검색시점"),
    ("s2", ("information filtering",), "정보필터링"),
    ("s2", ("memory",), "메모리"),
    ("s2", ("answer generation",), "생성"),
    ("s2", ("fine-tuning",), "학습형RL"),
    ("s2", ("reinforcement learning",), "학습형RL"),
    ("s2", ("benchmark",), "평가"),
    ("s2", ("dataset",), "평가"),
    ("s3", ("retrieval control",), "검색시점"),
    ("s3", ("query optimization",), "질의계획"),
    ("s3", ("reasoning", "integration"), "학습형RL"),
    ("s3", ("multi", "agent"), "에이전트오케스트레이션"),
    ("s3", ("tool", "knowledge"), "RAG강화추론"),
    ("s3", ("benchmark",), "평가"),
    ("s3", ("dataset",), "평가"),
    ("s3", ("evaluation",), "평가"),
)
#: Order of sources and tags in merged records (fixed values).
SOURCES = ("s1", "s2", "s3", "s4")
TAGS = ("질의계획", "검색시점", "정보필터링", "지식경계", "메모리", "생성", "추론워크플로우", "그래프RAG", "에이전트오케스트레이션", "학습형RL", "RAG강화추론", "사전정의", "평가", "기타")


def section_tag(survey: Column, section: Column) -> Column:
    low, out = F.lower(section), F
    for source, words, tag in TAG_RULES:
        fits = survey == source
        for w in words:
            fits = fits & F.contains(low, F.lit(w))
        out = out.when(fits, tag)
    return out.otherwise(OTHER)


def backfill(records: DataFrame) -> DataFrame:
    """records (ord, title, paper_id, ...): an empty id is that of the first record with the title."""
    known = records.where("coalesce(paper_id, '') <> ''").groupBy(norm_title(F.col("title")).alias("key")).agg(F.min_by("paper_id", "ord").alias("found"))
    both = records.withColumn("key", norm_title(F.col("title"))).join(known, "key", "left")
    return both.withColumn("paper_id", F.coalesce(F.nullif("paper_id", F.lit("")), "found", F.lit(""))).drop("key", "found")


def ordered(values: Column, order: tuple[str, ...]) -> Column:
    """A set's known values in the given order, then the others."""
    known = F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(values, x))
    return F.array_join(F.concat(known, F.sort_array(F.array_except(values, F.array(*map(F.lit, order))))), ";")


def merge(records: DataFrame, sources: tuple[str, ...] = SOURCES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """One record per id, or per title where there is none: (title, paper_id, source, tag).

    The longest title stays (the first of those), sources and tags are joined in their order.
    """
    key = F.when(F.col("paper_id") != "", F.concat(F.lit("id "), "paper_id")).otherwise(F.concat(F.lit("ti "), norm_title(F.col("title"))))
    grouped = records.groupBy(key.alias("key")).agg(F.max_by("title", F.struct(F.length("title"), -F.col("ord"))).alias("title"), F.max("paper_id").alias("paper_id"), F.collect_set("source").alias("ss"), F.collect_set("tag").alias("ts"))
    return grouped.select("title", "paper_id", ordered(F.col("ss"), sources).alias("source"), ordered(F.col("ts"), tags).alias("tag"))


def by_place(merged: DataFrame) -> list[Column]:
    """The order of the list of candidates: sources, tags, title in lower case; paper_id tells ties apart."""
    return [F.col("source"), F.col("tag"), F.lower("title"), F.col("title"), F.col("paper_id")]


def listed(merged: DataFrame) -> DataFrame:
    """Candidates in the order of the list, as a sorted table (sorted by ranges, so in no single task)."""
    return merged.orderBy(*by_place(merged))


def corpus_ids(*parts: DataFrame) -> DataFrame:
    """(paper_id): the ids of all parts of the corpus, each once."""
    out = parts[0].select("paper_id")
    for part in parts[1:]:
        out = out.unionByName(part.select("paper_id"))
    return out.where("paper_id is not null").distinct()


def in_corpus(merged: DataFrame, corpus: DataFrame) -> DataFrame:
    have = corpus.select("paper_id", F.lit(True).alias("has")).distinct()
    return merged.join(have, "paper_id", "left").withColumn("in_corpus", F.when(F.col("has") & (F.col("paper_id") != ""), "yes").otherwise("no")).drop("has")


def stats(merged: DataFrame) -> DataFrame:
    """(tag, n, n_with_id): candidates by their first tag, and how many have an id."""
    return merged.groupBy(F.element_at(F.split("tag", ";"), 1).alias("tag")).agg(F.count("*").alias("n"), F.count_if(F.col("paper_id") != "").alias("n_with_id"))


def pool(merged: DataFrame, core: tuple[str, ...]) -> DataFrame:
    """Candidates outside the corpus with an id and a core tag."""
    return merged.where((F.col("in_corpus") == "no") & (F.col("paper_id") != "") & F.arrays_overlap(F.split("tag", ";"), F.array(*map(F.lit, core))))


def sample(rows: DataFrame, key: str, n: int = 90, seed: int = 42) -> DataFrame:
    """A reproducible sample: the n rows with the least MD5 of seed and key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
