"""Drift audits and comparisons of graph versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit(live: DataFrame, papers: DataFrame, rebuilt: DataFrame, lexicon: DataFrame, aliases: DataFrame) -> DataFrame:
    """(finding, id) for every drift between the live graph and its sources; empty when clean.

    live and rebuilt are nodes (rk, definition), papers (paper_id, home_concept), lexicon
    (rk, status, definition), aliases (key, rk). All but the anchors are facts about one key, so one
    grouping by key sees them together.
    """
    none = F.lit(None).cast("string")
    fact = lambda d, key, kind, text=none: d.select(F.col(key).alias("id"), F.lit(kind).alias("kind"), text.alias("said"))
    facts = (
        fact(live, "rk", "live", F.trim(F.coalesce("definition", F.lit(""))))
        .unionByName(fact(rebuilt, "rk", "rebuilt"))
        .unionByName(fact(lexicon.where("status = 'rejected'"), "rk", "rejected"))
        .unionByName(fact(lexicon.where("trim(coalesce(definition, '')) <> ''"), "rk", "wanted", F.trim("definition")))
        .unionByName(fact(aliases.where("key <> rk"), "key", "alias"))
    )
    n = lambda kind: F.count_if(F.col("kind") == kind)
    said = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("said")))
    keys = facts.groupBy("id").agg(*[n(k).alias(k) for k in ("live", "rebuilt", "rejected", "alias")], said("live").alias("shown"), said("wanted").alias("wanted"))
    differing = F.size(F.filter("shown", lambda x: ~F.array_contains("wanted", x)))
    times = {
        "A_rejected_node": F.when(F.col("live") > 0, F.col("rejected")),
        "B_alias_node": F.when(F.col("live") > 0, F.col("alias")),
        "C_definition": F.when(F.size("wanted") > 0, differing),
        "E_missing": F.when(F.col("live") == 0, F.col("rebuilt")),
        "E_extra": F.when(F.col("rebuilt") == 0, F.col("live")),
    }
    findings = F.flatten(F.array(*[F.array_repeat(F.lit(k), F.coalesce(c, F.lit(0)).cast("int")) for k, c in times.items()]))
    found = keys.select(F.explode(findings).alias("finding"), F.col("id").cast("string").alias("id"))
    lost = papers.where("home_concept is not null").join(live.select(F.col("rk").alias("home_concept")).distinct(), "home_concept", "left_anti")
    return found.unionByName(lost.select(F.lit("D_anchor").alias("finding"), F.col("paper_id").cast("string").alias("id")))


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often, with side 'a' or 'b'."""
    names = a.columns
    n = F.sum("_n")
    each = a.withColumn("_n", F.lit(1)).union(b.withColumn("_n", F.lit(-1))).groupBy(*names).agg(n.alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "a").otherwise("b").alias("side")
    return each.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.abs("_n").cast("int")))).select(*names, side)


def digest(rows: DataFrame) -> tuple:
    """How many rows there are and two sums of hashes of them, in any order: tables of one digest are equal, up to
    a chance of some 2^-64. No row is shuffled."""
    null = [F.col(c).isNull() for c in rows.columns]  # hashes skip nulls
    hashed = lambda *seed: F.sum(F.xxhash64(*seed, *rows.columns, *null).cast("decimal(38,0)"))
    return tuple(rows.agg(F.count("*"), hashed(), hashed(F.lit("again"))).first())


def new_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of after whose keys, nulls included, aren't before."""
    had = before.select(*[F.col(c).alias(f"_{c}") for c in keys])
    return after.join(had, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left_anti")


def added(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(kind, id) of what a later state of the graph has that an earlier one hasn't: concepts by their names, papers,
    lineage, entries of the lexicon by their labels, and once more those of them that nobody has reviewed.

    Both are dicts of concepts (rk, canonical), papers (paper_id), lineage (src, dst), lexicon (rk, label, status).
    """
    fresh = {t: new_rows(before[t], after[t], keys) for t, keys in {"concepts": ["rk"], "papers": ["paper_id"], "lineage": ["src", "dst"], "lexicon": ["rk"]}.items()}
    told = {
        "concept": fresh["concepts"].select("canonical"),
        "paper": fresh["papers"].select(F.col("paper_id").cast("string")),
        "lineage": fresh["lineage"].select(F.concat_ws(" -> ", "src", "dst")),
        "lexicon": fresh["lexicon"].select("label"),
        "unreviewed": fresh["lexicon"].where("status = 'unreviewed'").select("label"),
    }
    found = None
    for kind, ids in told.items():
        rows = ids.toDF("id").select(F.lit(kind).alias("kind"), "id")
        found = rows if found is None else found.unionByName(rows)
    return found
