"""Exploring the graph: filters, name search, lineage closure, commands."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.sources.durable import Parts, stored


def filter_concepts(view: DataFrame, ptype: str | None = None, domain: str | None = None, date_after: str | None = None, unreviewed_only: bool = False) -> DataFrame:
    """Rows of view (ptype, domain, month, reviewed) that meet every given condition.

    Empty arguments are no condition. With date_after, concepts without a month are out.
    """
    out = view
    if ptype:
        out = out.where(F.col("ptype") == ptype)
    if domain:
        out = out.where(F.col("domain") == domain)
    if unreviewed_only:
        out = out.where(~F.coalesce("reviewed", F.lit(False)))
    if date_after:
        out = out.where(F.col("month") >= date_after)
    return out


def clean_filter(asked: dict) -> dict:
    """The conditions among what is asked for; empty values are none, and nothing asked is everything."""
    text = {k: v for k in ("ptype", "domain", "date_after") if (v := asked.get(k))}
    return text | ({"unreviewed_only": True} if asked.get("unreviewed_only") else {})


NOTHING_FITS = "no node meets the conditions"


def filter_options(view: DataFrame) -> DataFrame:
    """(kind, value): the values that filters can take."""
    pair = lambda kind, c: view.where(c.isNotNull()).select(F.lit(kind).alias("kind"), c.alias("value")).distinct()
    return pair("ptype", F.col("ptype")).unionByName(pair("domain", F.col("domain"))).unionByName(pair("year", F.substring("month", 1, 4)))


def name_search(nodes: DataFrame, query: str) -> DataFrame:
    """Concepts whose name contains the query, whatever the case; a blank query finds nothing."""
    q = query.strip().lower()
    return nodes.where(F.contains(F.lower("canonical"), F.lit(q))) if q else nodes.limit(0)


def related_terms(nodes: DataFrame, papers: DataFrame, n: int = 10) -> DataFrame:
    """(term): the first n names of concepts (canonical), then titles of papers, as material for queries."""
    both = nodes.select(F.col("canonical").alias("term"), F.lit(0).alias("o")).unionByName(papers.select(F.col("title").alias("term"), F.lit(1).alias("o")))
    return both.where("term <> ''").orderBy("o", "term").limit(n).select("term")


def with_metadata(hits: DataFrame, nodes: DataFrame, papers: DataFrame) -> DataFrame:
    """hits (kind, node_id, score) with name and said: a concept's name and definition, a paper's title and
    problem. Hits that are neither are left out."""
    what = nodes.select(F.lit("concept").alias("kind"), F.col("rk").cast("string").alias("node_id"), F.col("canonical").alias("name"), F.col("definition").alias("said"))
    what = what.unionByName(papers.select(F.lit("paper").alias("kind"), F.col("paper_id").cast("string").alias("node_id"), F.col("title").alias("name"), F.col("problem").alias("said")))
    return hits.withColumn("node_id", F.col("node_id").cast("string")).join(what, ["kind", "node_id"]).select("kind", "node_id", "score", "name", "said")


def hit_terms(hits: DataFrame, n: int = 10) -> DataFrame:
    """(ord, term): the first n names among hits, concepts before papers, each kind best first; empty ones don't count."""
    named = hits.where(F.coalesce("name", F.lit("")) != "")
    order = Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("kind") == "concept", 0).otherwise(1), F.desc("score"), "node_id")
    first = named.orderBy(F.when(F.col("kind") == "concept", 0).otherwise(1), F.desc("score"), "node_id").limit(n)
    return first.select(F.row_number().over(order).alias("ord"), F.col("name").alias("term"))


def filter_lexicon(items: DataFrame, status: str | None = None, text: str = "") -> DataFrame:
    """Lexicon items (label, status) of a status (None or 'all': any) whose name contains a text."""
    out = items if status in (None, "all") else items.where(F.col("status") == status)
    q = text.strip().lower()
    return out.where(F.contains(F.lower("label"), F.lit(q))) if q else out


def merge_targets(items: DataFrame, label: str, text: str = "", n: int = 50) -> DataFrame:
    """The first n other concepts by name that a concept can be merged into (a picker's page)."""
    return filter_lexicon(items.where(F.col("label") != label), None, text).orderBy("label").limit(n)


def next_match(index: int, n: int) -> int:
    """The match after index, around the end."""
    return (index + 1) % n if n else 0


def resolve_node(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, rk): exact key, else lower-case key, else name in lower case; null if none."""
    asked = names.select("name").distinct()
    by_key = nodes.select(F.col("rk").alias("key"), "rk")
    by_name = nodes.select(F.lower("canonical").alias("key"), "rk")
    tries = [(0, F.col("name"), by_key), (1, F.lower("name"), by_key), (2, F.lower("name"), by_name)]
    found = None
    for rank, key, side in tries:
        hit = asked.withColumn("key", key).join(side, "key").select("name", F.struct(F.lit(rank).alias("rank"), "rk").alias("x"))
        found = hit if found is None else found.unionByName(hit)
    return asked.join(found.groupBy("name").agg(F.min("x").alias("x")), "name", "left").select("name", F.col("x.rk").alias("rk"))


def closure(pairs: DataFrame, starts: DataFrame, direction: str = "ancestors") -> DataFrame:
    """(start, rk, depth): what each start (rk) reaches over lineage pairs (src, dst), itself excluded.

    'ancestors' follows src to dst, 'descendants' the other way, 'both' is the union of the two.
    The frontier is joined round by round and what was seen is removed, so cycles end. A round writes
    its new rows only; rounds are as many as the longest of the shortest paths.
    """
    found = _walk(pairs, starts, ["ancestors", "descendants"] if direction == "both" else [direction])
    if direction == "both":
        return found.groupBy("start", "rk").agg(F.min("depth").alias("depth"))
    return found.select("start", "rk", "depth")


def _walk(pairs: DataFrame, starts: DataFrame, directions: list[str]) -> DataFrame:
    """(way, start, rk, depth) of closures in several directions, which take their rounds together."""
    way = {"ancestors": ("src", "dst"), "descendants": ("dst", "src")}
    ends = F.array(*[F.struct(F.lit(d).alias("way"), F.col(a).alias("rk"), F.col(b).alias("to")) for d, (a, b) in way.items() if d in directions])
    step = stored(pairs.select(F.explode(ends).alias("x")).select("x.*"))
    seen, depth = Parts(pairs.sparkSession), 0
    ways = F.explode(F.array(*map(F.lit, directions))).alias("way")
    new = seen.add(starts.select("rk").distinct().select(ways, F.col("rk").alias("start"), "rk").withColumn("depth", F.lit(0)))
    while not new.isEmpty():
        depth += 1
        reached = new.select("way", "start", "rk").join(step, ["way", "rk"]).select("way", "start", F.col("to").alias("rk")).distinct()
        new = seen.add(reached.join(seen.all(), ["way", "start", "rk"], "left_anti").withColumn("depth", F.lit(depth)))
    return seen.all().where("rk <> start")


def closure_counts(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """(rk, n_ancestors, n_descendants) of each start, all levels counted."""
    of = lambda way, name: F.count_if(F.col("way") == way).alias(name)
    n = _walk(pairs, starts, ["ancestors", "descendants"]).groupBy(F.col("start").alias("rk")).agg(of("ancestors", "n_ancestors"), of("descendants", "n_descendants"))
    both = starts.select("rk").distinct().join(n, "rk", "left")
    return both.select("rk", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_ancestors", "n_descendants")])


def with_reviewed(view: DataFrame, reviewed: DataFrame) -> DataFrame:
    """view with the flag of the reviewed set (rk)."""
    return view.join(reviewed.select("rk", F.lit(True).alias("reviewed")).distinct(), "rk", "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))


def split_hits(hits: DataFrame, reviewed: DataFrame, unseen_only: bool = False) -> DataFrame:
    """hits (node_id, kind, score) with seen; papers are always unseen, scores keep their order."""
    marked = hits.join(reviewed.select(F.col("rk").alias("node_id"), F.lit(True).alias("seen")).distinct(), "node_id", "left")
    marked = marked.withColumn("seen", F.coalesce("seen", F.lit(False)) & (F.col("kind") == "concept"))
    return marked.where("not seen") if unseen_only else marked


@dataclass
class Command:
    """What a text asks for: a tool and its arguments."""

    tool: str
    args: dict = field(default_factory=dict)


def route(text: str, names: list[str], ptypes: tuple[str, ...] = (), domains: tuple[str, ...] = ()) -> Command:
    """A deterministic router: reset, lineage of a named node, a filter, else a semantic search."""
    low = text.strip().lower()
    if not low:
        return Command("none")
    if low in ("reset", "clear", "show all"):
        return Command("reset")
    node = max((n for n in names if n.lower() in low), key=len, default=None)
    directions = {"ancestor": "ancestors", "root": "ancestors", "descendant": "descendants", "lineage": "both"}
    asked = next((d for w, d in directions.items() if w in low), None)
    if node and asked:
        return Command("focus_lineage", {"node": node, "direction": asked})
    since = re.search(r"\b(?:after|since|from)\s+(\d{4})(?:-(\d{2}))?\b", low)
    args = {k: v for k, vs in (("ptype", ptypes), ("domain", domains)) for v in vs if v.lower() in low.split()}
    if "unreviewed" in low:
        args["unreviewed_only"] = True
    if since:
        args["date_after"] = f"{since[1]}-{since[2] or '01'}"
    if asked:
        return Command("none", {"message": "no known concept is named"})
    return Command("filter", args) if args else Command("semantic_search", {"query": text.strip()})
