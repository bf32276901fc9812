"""Upserts and edits as joins that give a new version of a table.

Plain Parquet has no MERGE; each function takes the old rows and gives the new ones, to be written
as a new version (strandgraph.sources.catalog).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer join with columns o (old row) and n (new row)."""
    o = old.select(F.col(key), F.struct(*[c for c in old.columns if c != key]).alias("o"))
    n = new.select(F.col(key), F.struct(*[c for c in new.columns if c != key]).alias("n"))
    return o.join(n, key, "full_outer")


def upsert_papers(old: DataFrame, new: DataFrame, key: str = "paper_id") -> DataFrame:
    """Every field of a new row overwrites the old one, except that a null embedding doesn't."""
    def field(c: str) -> Column:
        if c == "embedding":
            return F.coalesce(f"n.{c}", f"o.{c}").alias(c)
        return F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return _both(old, new, key).select(key, *[field(c) for c in old.columns if c != key])


def upsert_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names and statuses are set; definition and def_status only while the definition is empty.

    An embedding, where old has that column, is set by a new one that isn't null.
    """
    both = _both(old, new, "rk")
    empty = F.col("o").isNull() | (F.coalesce("o.definition", F.lit("")) == "")
    use = F.col("n").isNotNull() & empty
    pick = lambda c: F.when(use, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    last = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    embedding = [F.coalesce("n.embedding", "o.embedding").alias("embedding")] if "embedding" in old.columns else []
    return both.select("rk", last("name"), last("status"), pick("definition"), pick("def_status"), *embedding)


def upsert_ledger(old: DataFrame, new: DataFrame, kept: tuple[str, ...] = ("verdict", "extracted", "first_seen_query")) -> DataFrame:
    """Metadata is refreshed; what the workflow found out (columns kept) stays."""
    both = _both(old, new, "paper_id")
    def field(c: str) -> Column:
        if c in kept:
            return F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        return F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select("paper_id", *[field(c) for c in old.columns if c != "paper_id"])


def add_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).dropDuplicates(["paper_id", "rk", "type"])


def merge_concept(relations: DataFrame, nodes: DataFrame, papers: DataFrame, src: str, dst: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relations, a set of rows, nodes, papers) with src merged into dst.

    Edges and anchors move, repeats fall together, an empty definition is inherited, src goes. If
    dst is no node, src's edges go with it.
    """
    if src == dst:
        return relations, nodes, papers
    live = nodes.where(F.col("rk") == dst).select("rk")
    both = relations.where(F.col("rk").isin(src, dst)).withColumn("rk", F.lit(dst)).distinct()  # all others are a set before and after
    moved = relations.where(~F.col("rk").isin(src, dst)).unionByName(both.join(F.broadcast(live), "rk", "left_semi").select(*relations.columns))
    given = F.broadcast(nodes.where(F.col("rk") == src).select(F.lit(dst).alias("rk"), F.col("definition").alias("d2"), F.col("def_status").alias("s2")))
    joined = nodes.where(F.col("rk") != src).join(given, "rk", "left")
    empty = (F.col("rk") == dst) & (F.coalesce("definition", F.lit("")) == "") & F.col("s2").isNotNull()
    kept = joined.withColumns({"def_status": F.when(empty, F.col("s2")).otherwise(F.col("def_status")), "definition": F.when(empty, F.col("d2")).otherwise(F.col("definition"))}).drop("d2", "s2")
    home = F.when(F.col("home_concept") == src, dst).otherwise(F.col("home_concept"))
    return moved, kept, papers.withColumn("home_concept", home)


def reject_concept(relations: DataFrame, nodes: DataFrame, rk: str) -> tuple[DataFrame, DataFrame]:
    """The node and its edges go. Anchors that point to it stay, for the audit to report."""
    return relations.where(F.col("rk") != rk), nodes.where(F.col("rk") != rk)


def overlay_definitions(nodes: DataFrame, overlay: DataFrame) -> DataFrame:
    """nodes with live definitions (rk, definition) on top; a rebuild doesn't know them."""
    top = overlay.select("rk", F.trim("definition").alias("d2"))
    both = nodes.join(top, "rk", "left")
    return both.withColumns({"definition": F.coalesce("d2", "definition"), "def_status": F.when(F.col("d2").isNotNull(), "ok").otherwise(F.col("def_status"))}).drop("d2")


def apply_plan(lexicon: DataFrame, plan: DataFrame) -> DataFrame:
    """lexicon (label, status) with new statuses from plan (label, new_status), and changed."""
    both = lexicon.join(plan.select("label", "new_status"), "label", "left")
    return both.withColumns({"changed": F.coalesce(F.col("new_status") != F.col("status"), F.lit(False)), "status": F.coalesce("new_status", "status")}).drop("new_status")


def plan_problems(pending: DataFrame, plan: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(problem, label): pending ones without a plan, planned ones unknown or not pending."""
    missing = pending.join(plan, "label", "left_anti").select(F.lit("missing").alias("problem"), "label")
    unknown = plan.join(lexicon, "label", "left_anti").select(F.lit("unplanned").alias("problem"), "label")
    other = plan.join(lexicon.where("status <> 'pending'"), "label", "left_semi").select(F.lit("not_pending").alias("problem"), "label")
    return missing.unionByName(unknown).unionByName(other)


def alias_union(own: Column, src: Column, src_label: Column, dst_label: Column) -> Column:
    """dst's aliases with src's and src's label added in order; dst's own label isn't taken in."""
    incoming = F.array_remove(F.concat(src, F.array(src_label)), dst_label)
    return F.array_distinct(F.concat(own, incoming))


def add_alias(aliases: Column, alias: Column) -> Column:
    new = F.trim(alias)
    return F.when((new == "") | F.array_contains(aliases, new), aliases).otherwise(F.array_append(aliases, new))


def remove_alias(aliases: Column, alias: Column) -> Column:
    return F.array_remove(aliases, alias)


def set_reviewed(reviewed: DataFrame, rk: str, flag: bool) -> DataFrame:
    rest = reviewed.where(F.col("rk") != rk)
    return rest.unionByName(reviewed.sparkSession.createDataFrame([(rk,)], "rk string")) if flag else rest
