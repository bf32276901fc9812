"""python -m strandgraph TABLES [--extract [--force] [--smoke]] [--incremental] [--rebuild] [--audit] [--apply PLAN.csv] [--dry-run] [--command TEXT]: the engine's jobs."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandgraph.engine import Engine
from strandgraph.operators import audit, dml
from strandgraph.sources.catalog import Catalog
from strandgraph.sources.files import read_csv


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandgraph")
    parser.add_argument("tables", help="folder of the catalog")
    parser.add_argument("--extract", action="store_true", help="extract the parsed papers that haven't been yet")
    parser.add_argument("--force", action="store_true", help="with --extract: also those that have been")
    parser.add_argument("--smoke", action="store_true", help="with --extract: the first two papers only")
    parser.add_argument("--incremental", action="store_true", help="carry new extractions into the graph")
    parser.add_argument("--rebuild", action="store_true", help="normalize all mentions and store the graph")
    parser.add_argument("--audit", action="store_true", help="show where the stored graph drifts from its sources")
    parser.add_argument("--apply", metavar="PLAN", help="CSV of label, new_status for all pending concepts")
    parser.add_argument("--dry-run", action="store_true", help="with --apply: show the changes only")
    parser.add_argument("--command", metavar="TEXT", help="route a text and show its rows")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("strandgraph").getOrCreate()
    engine = Engine(spark, Catalog(spark, given.tables))
    if given.apply:
        plan, lexicon = read_csv(spark, given.apply, "label string, new_status string"), engine.catalog.read("lexicon")
        problems = dml.plan_problems(lexicon.where("status = 'pending'").select("label"), plan.select("label"), lexicon.select("label", "status"))
        if not problems.isEmpty():
            problems.show(50, truncate=False)
            raise SystemExit("the plan doesn't fit the pending concepts; nothing was changed")
        changed = dml.apply_plan(lexicon, plan)
        changed.where("changed").select("label", "status").show(50, truncate=False)
        if not given.dry_run:
            engine.catalog.write("lexicon", changed.drop("changed"))
    if given.extract:
        print(engine.extract(force=given.force, first=2 if given.smoke else None))
    if given.incremental:
        print({"papers": engine.take_in()})
    if given.rebuild:
        print(engine.rebuild())
    if given.audit:
        graph = engine.graph()
        live = engine.catalog.read("nodes").select("rk", "definition")
        found = audit.audit(live, engine.catalog.read("paper_nodes"), graph.nodes, graph.reps, graph.aliases)
        found.groupBy("finding").agg(F.count("*").alias("n")).show()
    if given.command:
        routed, rows = engine.command(given.command)
        print(routed)
        if rows is not None:
            rows.show(50, truncate=False)


if __name__ == "__main__":
    main()
