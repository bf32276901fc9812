"""States of many tables, and the graph kept up to date by batches against builds over all papers."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from strandgraph.engine import Engine
from strandgraph.operators import audit, dml, incremental, normalize
from strandgraph.operators.normalize import Graph
from strandgraph.sources.catalog import Broken, Catalog, Conflict, Draft

LEXICON = "ord long, label string, aliases array<string>, status string, definition string, source string, first_seen string"
MENTION = "paper_id string, phase int, idx int, name string, definition string"
PAPER = "paper_id string, title string, problem string, domain string, paper_type string"


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.select(*columns).collect())


def test_states_are_whole_or_absent(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    one = lambda v: spark.createDataFrame([(1, v)], "k long, v string")
    catalog.transact(lambda d: (d.write("a", one("x")), d.write("b", one("x"))))
    catalog.snapshot("start")

    def crash(draft):
        draft.write("a", one("y"))
        raise OSError("lost")

    with pytest.raises(OSError):
        catalog.transact(crash)
    assert catalog.read("a").first().v == catalog.read("b").first().v == "x" and catalog.numbers() == [1]
    slow, fast = Draft(catalog.last()), Draft(catalog.last())
    slow.write("a", one("slow"))
    fast.write("b", one("fast"))
    catalog.commit(fast)
    with pytest.raises(Conflict):
        catalog.commit(slow)
    catalog.write("a", one("z"))
    assert (catalog.at().read("a").first().v, catalog.at().read("b").first().v, catalog.at("start").read("b").first().v) == ("z", "fast", "x")
    with pytest.raises(Conflict):
        catalog.snapshot("start")
    catalog.restore_all(1)
    assert catalog.read("a").first().v == catalog.read("b").first().v == "x" and catalog.versions("a") == [1]
    assert catalog.vacuum(keep=1, idle_seconds=0) == 4 and catalog.at("start").read("a").count() == 1
    with pytest.raises(LookupError):
        catalog.at("none")


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.write("log", spark.createDataFrame([], "n int"))
    failed = []

    def work(k):
        try:
            for i in range(3):
                catalog.append("log", spark.createDataFrame([(10 * k + i,)], "n int"))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and sorted(r.n for r in catalog.read("log").collect()) == sorted(10 * k + i for k in range(4) for i in range(3))


def test_upsert_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    old = spark.range(500).select(F.concat(F.lit("c"), "id").alias("rk"), F.lit("n").alias("name"), F.lit("approved").alias("status"), F.when(F.col("id") % 2 == 0, "d").otherwise("").alias("definition"), F.lit("ok").alias("def_status"))
    catalog.write("concepts", old, "rk", 16)
    before = {tuple(p) for p in catalog.last().tables["concepts"]["parts"]}
    new = spark.createDataFrame([("c7", "N", "pending", "new", "ok")], old.schema)
    state = catalog.transact(lambda d: d.upsert("concepts", new, dml.upsert_concepts))
    after = {tuple(p) for p in state.tables["concepts"]["parts"]}
    assert len(before - after) == len(after - before) == 1
    assert rows(state.read("concepts"), *old.columns) == rows(dml.upsert_concepts(old, new), *old.columns)
    assert state.parts("concepts", state.buckets_of("concepts", new.select("rk"))).count() < 100
    keys = spark.createDataFrame([("c7",), ("zz",)], "rk string")
    assert [r.name for r in state.read("concepts", keys).collect()] == ["N"]
    for i in range(20):  # folders of a bucket stay few
        catalog.transact(lambda d, i=i: d.append("concepts", spark.createDataFrame([(f"x{i % 2}", str(i), "s", "", "ok")], old.schema)))
    assert catalog.read("concepts").count() == 520 and max(sum(p[0] == b for p in catalog.last().tables["concepts"]["parts"]) for b in range(16)) <= 17


def test_hidden_rows_are_left_out_and_their_buckets_stay(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    frame = lambda *rows: spark.createDataFrame(rows, "k long, v string")
    catalog.write("t", frame(*((i, str(i)) for i in range(40)), (None, None), (None, "x")), "k", 4)
    first = catalog.last().tables["t"]["parts"]
    one = catalog.transact(lambda d: d.hide("t", frame((3, "3"), (4, "no"), (None, None)), frame((3, "new"), (90, "y")), ["k", "v"]))
    want = sorted([(i, str(i)) for i in range(40) if i != 3] + [(3, "new"), (90, "y"), (None, "x")], key=str)
    shown = lambda state, *keys: sorted((tuple(r) for r in state.read("t", *keys).collect()), key=str)
    assert shown(one) == want and [p for p in one.tables["t"]["parts"] if p in first] == first
    assert shown(one, spark.createDataFrame([(3,), (4,), (91,)], "k int")) == [(3, "new"), (4, "4")]
    assert sorted(r.k for r in one.known("t", spark.createDataFrame([(3,), (4,), (91,)], "k long")).collect()) == [3, 4]
    two = catalog.transact(lambda d: d.change("t", frame((5, "")).select("k"), frame((5, "z"))))  # a bucket written anew is as it was shown
    assert shown(two) == sorted([*(r for r in want if r[0] != 5), (5, "z")], key=str)
    catalog.vacuum(keep=1, idle_seconds=0)
    assert shown(catalog.last()) == shown(two)
    for i in range(4):
        last = catalog.transact(lambda d, i=i: d.hide("t", frame((10 + i, "")).select("k"), frame()))
    assert "hidden" not in last.tables["t"] and shown(last) == [r for r in shown(two) if r[0] not in range(10, 14)]


def test_rules_keep_a_bad_state_out(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))

    def start(draft):
        draft.write("nodes", spark.createDataFrame([("a",), ("b",)], "rk string"))
        draft.write("relations", spark.createDataFrame([(1, "a")], "paper_id int, rk string"))
        draft.declare_key("nodes", "rk")
        draft.declare_reference("relations", "rk", "nodes", "rk")

    catalog.transact(start)
    with pytest.raises(Broken) as told:
        catalog.append("nodes", spark.createDataFrame([("a",), (None,)], "rk string"))
    assert rows(told.value.rows, "rule", "key", "n") == [("key nodes(rk)", "a", 2), ("key nodes(rk)", "null", 1)]
    with pytest.raises(Broken) as told:
        catalog.write("nodes", spark.createDataFrame([("b",)], "rk string"))
    assert rows(told.value.rows, "rule", "key", "n") == [("reference relations.rk to nodes.rk", "a", 1)]
    assert catalog.read("nodes").count() == 2 and catalog.numbers() == [1]
    catalog.append("relations", spark.createDataFrame([(2, None), (2, "b")], "paper_id int, rk string"))


def _random_papers(rng, ids):
    words = ["a", "B", "long a", "bee", "new x", "New-X", "y"]
    names = [*words, *[f"{o} ({i})" for o in ("some a", "y", "other") for i in ("a", "new x", "zz", "bee")], "q (r) s"]
    out = []
    for p in ids:
        for phase in (0, 1):
            for idx in range(rng.randint(0, 3)):
                out.append((p, phase, idx, rng.choice(names), rng.choice(["", "", f"d{p}"]) if phase == 0 else ""))
    return out


def test_batches_equal_a_build_over_all_papers(spark, tmp_path):
    rng = random.Random(1)
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.write("lexicon", spark.createDataFrame([(0, "A", ["long a"], "approved", "", "", ""), (1, "Bee", ["b"], "rejected", "", "", ""), (2, "Y", [], "unreviewed", "", "", "")], LEXICON))
    have = {}
    for ids in (["p3", "p5", "p7", "p8"], ["p1", "p5", "p6"], ["p1", "p3", "p9"]):
        batch = {p: _random_papers(rng, [p]) for p in ids}
        have |= batch
        frame = spark.createDataFrame([m for ms in batch.values() for m in ms], MENTION)
        state = incremental.ingest_batch(catalog, frame, spark.createDataFrame([(p, None, None, None, None) for p in ids], PAPER), buckets=4)
        whole = Graph(spark.createDataFrame([m for ms in have.values() for m in ms], MENTION), state.read("papers"), state.read("lexicon"))
        assert rows(state.read("relations"), "paper_id", "rk", "type") == rows(whole.relations, "paper_id", "rk", "type")
        assert rows(state.read("nodes"), *incremental.NODE) == rows(whole.nodes, *incremental.NODE)
        assert rows(state.read("mentions"), *incremental.RAW) == sorted(m for ms in have.values() for m in ms)
        assert rows(state.read("by_concept"), "paper_id", "phase", "idx", "rk") == rows(whole.resolved, "paper_id", "phase", "idx", "rk")


def test_a_batch_over_all_buckets_writes_its_own_rows_only(spark, tmp_path):
    """What a batch leaves of other papers isn't written anew, and all tables are those of a build over all papers."""
    rng = random.Random(3)
    lexicon = spark.createDataFrame([(0, "A", ["long a"], "approved", "", "", ""), (1, "Bee", ["b"], "rejected", "", "", ""), (2, "Y", [], "unreviewed", "", "", "")], LEXICON)
    mention, paper = MENTION.replace("paper_id string", "paper_id long"), PAPER.replace("paper_id string", "paper_id long")
    catalog, have = Catalog(spark, str(tmp_path / "c")), {}
    catalog.write("lexicon", lexicon)
    big, first = ("mentions", "by_concept", "relations"), None
    for ids in (range(60), range(0, 70, 5), [2, 7, 60, 75]):
        batch = {p: _random_papers(rng, [p]) for p in ids}
        have |= batch
        frame = spark.createDataFrame([m for ms in batch.values() for m in ms], mention)
        state = incremental.ingest_batch(catalog, frame, spark.createDataFrame([(p, None, None, None, None) for p in ids], paper), buckets=4)
        first = first or {t: state.tables[t]["parts"] for t in big}
        assert all(p in state.tables[t]["parts"] for t in big for p in first[t])
    everything = spark.createDataFrame([m for ms in have.values() for m in ms], mention)
    whole = Catalog(spark, str(tmp_path / "whole")).transact(lambda d: incremental.build(d, everything, state.read("papers"), lexicon, buckets=4))
    for table in ("mentions", "by_concept", "odd", "names", "concepts", "nodes", "relations"):
        got, want = (sorted(map(str, s.read(table).select(*whole.schema(table).names).collect())) for s in (state, whole))
        assert got == want and got, table


def test_a_small_batch_reads_few_buckets(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.write("lexicon", spark.createDataFrame([(0, "A", [], "approved", "", "", "")], LEXICON))
    mentions = spark.range(3000).select(F.format_string("p%05d", F.floor(F.col("id") / 3)).alias("paper_id"), F.lit(0).alias("phase"), (F.col("id") % 3).cast("int").alias("idx"), F.concat(F.lit("name "), F.col("id") % 700).alias("name"), F.lit("d").alias("definition"))
    papers = mentions.select("paper_id", *[F.lit(None).cast("string").alias(c) for c in ("title", "problem", "domain", "paper_type")]).distinct()
    catalog.transact(lambda d: incremental.build(d, mentions, papers, d.read("lexicon"), buckets=64))
    read = []
    plain = Draft.parts
    monkeypatch.setattr(Draft, "parts", lambda self, table, buckets: read.append((table, buckets)) or plain(self, table, buckets))
    new = spark.createDataFrame([("p99999", 0, 0, "name 5", "d"), ("p99999", 1, 0, "fresh (name 6)", "")], MENTION)
    incremental.ingest_batch(catalog, new, spark.createDataFrame([("p99999", None, None, None, None)], PAPER))
    assert read and all(t == "lexicon" or (b is not None and len(b) <= 4) for t, b in read), read


def test_a_build_writes_mentions_in_their_tables_only(spark, tmp_path, monkeypatch):
    """Mentions aren't stored aside on the way: each is written as it is, and by its concept."""
    aside, keep = [], incremental.stored
    monkeypatch.setattr(incremental, "stored", lambda rows: (aside.append(rows.columns), keep(rows))[1])
    mentions = spark.createDataFrame([("p1", 0, 0, "Late (Y)", "d"), ("p2", 0, 0, "y", ""), ("p3", 1, 0, "late (y)", ""), ("p3", 1, 1, None, "")], MENTION)
    papers = spark.createDataFrame([(p, p, "", None, None) for p in ("p1", "p2", "p3")], PAPER)
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.write("lexicon", spark.createDataFrame([], LEXICON))
    state = incremental.ingest_batch(catalog, mentions, papers, buckets=4)
    assert not [c for c in aside if "idx" in c]
    assert [r.rk for r in state.read("by_concept").orderBy("paper_id", "idx").collect()] == ["late (y)", "y", "late (y)", None]
    assert state.read("concepts").where("rk = 'late (y)'").first().said.definition == "d"


def test_a_rebuild_normalizes_once(spark, tmp_path, monkeypatch):
    times, settle = [], normalize.settle
    monkeypatch.setattr(normalize, "settle", lambda *a: (times.append(1), settle(*a))[1])
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.write("mentions", spark.createDataFrame([("p1", 0, 0, "A", "d"), ("p1", 1, 0, "B", "")], MENTION))
    catalog.write("papers", spark.createDataFrame([("p1", "t", "", None, None)], PAPER))
    catalog.write("lexicon", spark.createDataFrame([], LEXICON))
    assert Engine(spark, catalog).rebuild() == {"nodes": 1, "relations": 1, "paper_nodes": 1} and len(times) == 1
    rows = catalog.read("relations")
    assert audit.digest(rows) == audit.digest(rows.repartition(3)) != audit.digest(rows.withColumn("rk", F.lit(None).cast("string")))
