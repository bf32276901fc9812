"""Views of the graph: concepts, derived lineage, the paper overlay, subgraphs, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions.text import slug
from strandgraph.operators.normalize import Graph, defaults
from strandgraph.sources.durable import stored


def lineage(graph: Graph) -> DataFrame:
    """(src, dst): src is the home of a paper that builds on dst; no loops, no repeats."""
    return graph.links.where("type = 'builds_on' and home <> rk and paper_id is not null").select(F.col("home").alias("src"), F.col("rk").alias("dst")).distinct()


def property_chain(graph: Graph) -> DataFrame:
    """(src, dst, self_loop) over all definitions of a paper, not only its home; loops are kept."""
    defines = graph.relations.where("type = 'defines'").select("paper_id", F.col("rk").alias("src"))
    builds = graph.relations.where("type = 'builds_on'").select("paper_id", F.col("rk").alias("dst"))
    return defines.join(builds, "paper_id").select("src", "dst").distinct().withColumn("self_loop", F.col("src") == F.col("dst"))


def concept_view(graph: Graph) -> DataFrame:
    """One row per concept with its home paper's type and domain and its papers, sorted."""
    used = graph.relations.groupBy("rk").agg(F.sort_array(F.collect_set("paper_id")).alias("papers"))
    home = graph.home_papers.join(graph.told_papers.select(F.col("paper_id").alias("home_paper"), F.col("paper_type").alias("ptype"), "domain"), "home_paper", "left")
    return defaults(graph.nodes.join(used, "rk", "left").join(home, "rk", "left"))


def defines_view(graph: Graph) -> DataFrame:
    return graph.relations.where("type = 'defines'").select("paper_id", "rk")


def paper_builds_on(graph: Graph) -> DataFrame:
    """References of papers that define nothing."""
    return graph.links.where("type = 'builds_on' and (home is null or paper_id is null)").select("paper_id", "rk")


def graph_view(graph: Graph, include_papers: bool = False) -> dict[str, DataFrame]:
    """The parts of the graph that a client draws."""
    out = {"nodes": concept_view(graph), "builds_on": lineage(graph)}
    if include_papers:
        out |= {"papers": graph.papers, "defines": defines_view(graph), "paper_builds_on": paper_builds_on(graph)}
    return out


def all_edges(graph: Graph) -> DataFrame:
    """(kind, src, dst) of every edge that is drawn, papers with a prefix."""
    paper = F.concat(F.lit("paper:"), F.col("paper_id").cast("string"))
    built = lineage(graph).select(F.lit("builds_on").alias("kind"), "src", "dst")
    defined = defines_view(graph).select(F.lit("defines").alias("kind"), paper.alias("src"), F.col("rk").alias("dst"))
    overlay = paper_builds_on(graph).select(F.lit("paper_builds_on").alias("kind"), paper.alias("src"), F.col("rk").alias("dst"))
    return built.unionByName(defined).unionByName(overlay)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) one of whose ends is no node (id)."""
    return not_whole(edges, nodes, nodes)


def not_whole(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges (src, dst) whose src isn't among starts (id) or whose dst isn't among ends (id)."""
    mark = lambda ids, c: ids.select(F.col("id").alias(c), F.lit(True).alias(f"has_{c}")).distinct()
    marked = edges.join(mark(starts, "src"), "src", "left").join(mark(ends, "dst"), "dst", "left")
    return marked.where("has_src is null or has_dst is null").select(*edges.columns)


def subgraph(pairs: DataFrame, seed: str, followers: int = 10) -> DataFrame:
    """Lineage among a seed, its first followers by name, and what those build on."""
    first = pairs.where(F.col("dst") == seed).select("src").distinct().orderBy("src").limit(followers)
    return pairs.join(F.broadcast(first), "src", "left_semi").unionByName(pairs.where(F.col("src") == seed)).distinct()


def summary(graph: Graph) -> DataFrame:
    """One row: papers, concepts, edges by type, placeholders."""
    e = graph.edges.agg(F.count_if(F.col("type") == "defines").alias("n_defines"), F.count_if(F.col("type") == "builds_on").alias("n_builds_on"))
    n = graph.nodes.agg(F.count("*").alias("n_concepts"), F.count_if(F.col("def_status") == "placeholder").alias("n_placeholders"))
    p = graph.raw_papers.agg(F.count("*").alias("n_papers"))
    return p.crossJoin(n).crossJoin(e)  # three rows of one


def literal(text: Column) -> Column:
    """A quoted Turtle string: backslashes, quotes and line ends are escaped."""
    out = text
    for char, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(mark))
    return F.concat(F.lit('"'), out, F.lit('"'))


def triples(graph: Graph) -> DataFrame:
    """(s, p, o): concepts, their labels and their lineage as SKOS-like terms."""
    me = F.concat(F.lit(":"), slug(F.col("rk")))
    said = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    both = F.array(said("a", F.lit("skos:Concept")), said("skos:prefLabel", literal(F.col("canonical"))))
    told = graph.nodes.select(me.alias("s"), F.explode(both).alias("x")).select("s", "x.p", "x.o")
    built = lineage(graph).select(F.concat(F.lit(":"), slug(F.col("src"))).alias("s"), F.lit(":buildsOn").alias("p"), F.concat(F.lit(":"), slug(F.col("dst"))).alias("o"))
    return told.unionByName(built)


def node_months(relations: DataFrame, papers: DataFrame) -> DataFrame:
    """(rk, month): the first month of the papers (paper_id, month) that a concept occurs in."""
    return relations.join(papers.select("paper_id", "month"), "paper_id").groupBy("rk").agg(F.min("month").alias("month"))


def node_paper(graph: Graph) -> DataFrame:
    """(rk, paper_id): the paper that a concept's details are shown from, its first by id; null without one."""
    return graph.first_papers


def type_counts(papers: DataFrame) -> DataFrame:
    """(paper_type, n, n_without_home): papers by type, and how many of them define nothing."""
    return papers.groupBy("paper_type").agg(F.count("*").alias("n"), F.count_if(F.col("home_concept").isNull()).alias("n_without_home"))


def without_home(papers: DataFrame) -> DataFrame:
    """(paper_id, paper_type) of the papers that define nothing."""
    return papers.where("home_concept is null").select("paper_id", "paper_type")


def status_counts(rows: DataFrame) -> DataFrame:
    """(status, n) of lexicon entries or concepts."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def with_embeddings(nodes: DataFrame, store: DataFrame) -> DataFrame:
    """nodes (node_id, ...) with their stored vector (node_id, vector); null without one."""
    return nodes.join(store.select("node_id", "vector"), "node_id", "left")


def sorted_names(nodes: DataFrame) -> DataFrame:
    """(canonical, rk, pos): names in order, numbered from 1.

    Rows are dealt to ranges of names and numbered within each; only the ranges' row counts, one row a
    partition, are summed up in order, so no task sees all names.
    """
    sorted_ = stored(nodes.select("canonical", "rk").repartitionByRange("canonical", "rk").sortWithinPartitions("canonical", "rk").withColumn("part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("part").orderBy("canonical", "rk"))
    sizes = sorted_.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return sorted_.withColumn("own", own).join(F.broadcast(before), "part").select("canonical", "rk", (F.col("own") + F.col("before")).alias("pos"))


def not_unique(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(key).count().where("count > 1").withColumnRenamed("count", "n")
