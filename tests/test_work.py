"""The judged queue, sessions, calls: what is asked, how often, and what happens when it goes wrong."""

import json
import threading
import time
import uuid
from datetime import timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandgraph.engine import Engine, Session
from strandgraph.functions import annotators, prompts
from strandgraph.operators import explore, queue
from strandgraph.sources.catalog import Catalog, Conflict
from strandgraph.streaming import ingest, sessions

CACHE = "paper_id int, prompt_ver string, verdict string"


class Counted:
    """The gate's stand-in, which leaves a file for every call and a line in it for every text."""

    def __init__(self, folder, passes=lambda text: True):
        self.folder, self.passes = folder, passes
        folder.mkdir()

    def __call__(self, texts):
        (self.folder / uuid.uuid4().hex).write_text("\n".join(t.replace("\n", " ") for t in texts))
        return [{"type": "technique" if self.passes(t.replace("\n", " ")) else "survey", "reason": "r"} for t in texts]

    def texts(self):
        return [line for p in self.folder.iterdir() for line in p.read_text().split("\n")]


def candidates(spark, n, sessions=("s",)):
    return spark.range(n).select(F.explode(F.array(*map(F.lit, sessions))).alias("s"), F.col("id").cast("int").alias("paper_id"), F.col("id").cast("int").alias("rank"), F.concat(F.lit("t"), "id").alias("title"))


def judged(spark, found, cache, call, **how):
    return queue.judge(found, spark.createDataFrame(cache, CACHE), prompts.GATE, F.col("title"), F.lit("a"), by=("s",), call=call, **how)


def test_few_of_many_candidates_are_asked_about(spark, tmp_path):
    nothing, tenth = Counted(tmp_path / "a", lambda t: False), Counted(tmp_path / "b", lambda t: t.startswith(("t3 ", "t14 ", "t15 ")))
    done = judged(spark, candidates(spark, 379), [], nothing, target=2)
    assert len(nothing.texts()) == done.rows.count() == done.asked.count() == 50
    done = judged(spark, candidates(spark, 379), [], tenth, target=2)
    assert len(tenth.texts()) == done.rows.count() == 20 and [r.paper_id for r in done.rows.where("passed").orderBy("rank").collect()] == [3, 14, 15]
    again = Counted(tmp_path / "c")
    cache = [(r.paper_id, r.prompt_ver, r.verdict) for r in done.asked.collect()]
    second = judged(spark, candidates(spark, 379), cache, again, target=2)
    assert again.texts() == [] and second.rows.where("cached").count() == 20 and second.asked.count() == 0
    other = Counted(tmp_path / "d")
    judged(spark, candidates(spark, 379), [(i, "g0", "technique") for i in range(379)], other, target=2)
    assert len(other.texts()) == 10  # another prompt's verdicts don't count


def test_sessions_share_what_is_asked(spark, tmp_path):
    call = Counted(tmp_path / "a", lambda t: t.split(" ")[0] in ("t0", "t1"))
    found = candidates(spark, 30, ("x", "y")).where("s = 'x' or paper_id >= 5")
    done = judged(spark, found, [], call, target=2)
    assert sorted(call.texts()) == sorted(f"t{i} a" for i in range(30)) and {r.s: r["count"] for r in done.rows.groupBy("s").count().collect()} == {"x": 10, "y": 25}
    empty = judged(spark, candidates(spark, 0), [], call, target=2)
    assert empty.rows.count() == 0 and empty.rows.columns == done.rows.columns and empty.asked.columns == done.asked.columns


def test_a_failed_verdict_is_asked_for_again(spark, tmp_path):
    def fails(texts):
        if any(t.startswith("t1\n") for t in texts):
            raise OSError("down")
        return [{"type": "technique", "reason": "r"} for _ in texts]

    done = judged(spark, candidates(spark, 3), [], fails, target=9)
    assert {r.paper_id: (r.passed, r.error) for r in done.rows.collect()} == {0: (True, None), 1: (False, "down"), 2: (True, None)}
    call = Counted(tmp_path / "a")
    judged(spark, candidates(spark, 3), [(r.paper_id, r.prompt_ver, r.verdict) for r in done.asked.collect()], call, target=9)
    assert call.texts() == ["t1 a"]


def test_calls_of_too_few_too_many_slow_and_failing_answers(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "id int, text string").coalesce(1)
    told = lambda call, **how: {r.id: (r.ok, r.n, r.error) for r in annotators.annotate(rows, call, "n int", "v", batch=3, **how).collect()}
    right = {i: (True, i, None) for i in range(6)}
    number = lambda t: {"n": int(t[5:])}
    assert told(lambda ts: [number(t) for t in ts][: max(1, len(ts) - 1)]) == right
    assert told(lambda ts: [number(t) for t in ts] + ([{"n": 99}] if len(ts) > 1 else [])) == right
    assert told(lambda ts: []) == {i: (False, None, "0 answers to 1 texts") for i in range(6)}
    assert told(lambda ts: [number(t) for t in ts], concurrent=2, patience=20.0) == right

    def slow(texts):
        if "text 4" in texts:
            time.sleep(3)
        return [number(t) for t in texts]

    assert told(slow, patience=1.0) == right | {4: (False, None, "no answer in 1.0 s")}
    first = tmp_path / "tried"

    def once(texts):
        if not first.exists():
            first.write_text("x")
            raise OSError("busy")
        return [number(t) for t in texts]

    assert told(once, retries=1, backoff=0.01) == right


def test_calls_under_way_are_bounded(spark, tmp_path):
    import os

    def call(texts):
        mine = tmp_path / uuid.uuid4().hex
        mine.write_text("")
        n = len(os.listdir(tmp_path))
        time.sleep(0.2)
        mine.unlink()
        return [{"n": n} for _ in texts]

    rows = spark.range(24).select("id", F.lit("t").alias("text")).coalesce(1)
    most = max(r.n for r in annotators.annotate(rows, call, "n int", "v", batch=1, concurrent=4).collect())
    assert 2 <= most <= 4


def _engine(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "tables"))
    catalog.write("lexicon", spark.createDataFrame([(0, "B", ["bee"], "approved", "", "", "")], "ord long, label string, aliases array<string>, status string, definition string, source string, first_seen string"))
    catalog.write("mentions", spark.createDataFrame([("p", 0, 0, "Graph Memory", "graph memory of agents")], "paper_id string, phase int, idx int, name string, definition string"))
    catalog.write("papers", spark.createDataFrame([("p", "Walks", "memory graph agents", None, None)], "paper_id string, title string, problem string, domain string, paper_type string"))
    entries = [(0, i, "graph memory", f"x/24{i:02}.0000{i}v1", f"Paper {i}", f"We propose New{i} Net.", "2024-01-02") for i in range(25)]
    catalog.write("feed", spark.createDataFrame(entries, "query_ord int, entry_ord int, query string, id string, title string, summary string, published string"))
    engine = Engine(spark, catalog)
    engine.rebuild()
    said = annotators.hashed_embedding(["graph memory of agents", "memory graph agents"])
    catalog.write("embeddings", spark.createDataFrame([(n, "m", v["vector"]) for n, v in zip(("concept:graph memory", "paper:p"), said)], "node_id string, model string, vector array<float>"))
    return engine


def test_session_asks_little_and_tells_what_is_known(spark, tmp_path):
    engine = _engine(spark, tmp_path)
    gate = Counted(tmp_path / "gate", lambda t: t.startswith(("Paper 3", "Paper 11", "Paper 12")))
    long = "one two three four five six seven"
    calls = {"gate": gate, "expand": lambda ts: [{"queries": ["graph memory", "Graph Memory ", "", long]} for _ in ts]}
    told = []
    session = lambda name="t": Session(engine, name, calls, annotators.hashed_embedding, "m")
    known = session().start("find 2 papers about graph memory agents")
    assert known["related"] == ["Graph Memory", "Walks"] and known["report"][0] == "Topic: graph memory agents" and any("Graph Memory" in x for x in known["report"])
    assert session().resume("revise: find 2 papers about graph memory of agents") == "interpret"
    assert session().resume("proceed") == "approve"
    state = json.loads(session().state()["state"])
    assert state["queries"] == ["graph memory"] and state["too_few_queries"] and state["counts"]["new"] == 25
    assert session().resume("proceed") == "extract_confirm" and len(gate.texts()) == 20
    state = json.loads(session().state()["state"])
    assert (state["gate_calls"], state["gate_cached"], state["to_extract"]) == (20, 0, ["2403.00003", "2411.000011"])
    session("u").start("find 2 papers about graph memory")
    session("u").resume("proceed")
    assert session("u").resume("proceed") == "extract_confirm" and len(gate.texts()) == 20  # all verdicts are known
    assert session().resume("proceed") == "report"
    ledger = {r.paper_id: (r.verdict, r.extracted) for r in engine.catalog.read("ledger").collect()}
    assert len(ledger) == 25 and ledger["2403.00003"] == ("technique", True) and ledger["2401.00001"] == ("survey", False)
    stages = {r.stage: r["count"] for r in engine.catalog.read("calls").groupBy("stage").count().collect()}
    assert stages == {"parse_intent": 3, "expand": 2, "gate": 20, "extract": 2}
    for model in ("another model", ""):  # no stored vector is of it, nor of the settings' model
        with pytest.raises(ValueError):
            engine.search("x", annotators.hashed_embedding, model)
    with pytest.raises(ValueError):
        engine.patch_concept("B", source="C")  # no field that clients may set

    def go():
        try:
            told.append(session("u").resume("proceed"))
        except Conflict:
            told.append("conflict")

    threads = [threading.Thread(target=go) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = engine.catalog.read("sessions").where("thread_id = 'u'").select("seq").collect()
    assert sorted(r.seq for r in rows) == list(range(len(rows))) and "report" in told


def test_filters_are_cleaned_and_say_when_nothing_fits(spark, tmp_path):
    assert explore.clean_filter({"ptype": "", "domain": None, "unreviewed_only": False, "other": 1}) == {}
    assert explore.clean_filter({"ptype": "survey", "date_after": "", "unreviewed_only": 1}) == {"ptype": "survey", "unreviewed_only": True}
    command, rows = _engine(spark, tmp_path).command("survey after 2030")
    assert (command.tool, command.args, rows) == ("none", {"message": explore.NOTHING_FITS}, None)


EVENTS = "thread_id string, event_id int, ts timestamp, decision string"


def test_sessions_take_each_event_once_and_in_one_sequence(spark, tmp_path):
    from datetime import datetime

    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [
        [("a", 2, at(2), "proceed"), ("a", 1, at(1), "go"), ("b", 3, at(1), "go")],
        [("a", 2, at(2), "proceed"), ("a", 4, at(3), "proceed"), ("a", 4, at(3), "proceed")],  # arrives again
        [("c", 5, at(60), "go")],  # b has waited for too long by then
        [("b", 6, at(61), "go"), ("a", 7, at(61), "go")],
        [("d", 8, at(1), "go")],  # older than the watermark
    ]
    given, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for batch in batches:  # the query starts anew for each
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(given)
        sessions.run(spark.readStream.schema(EVENTS).parquet(given), out, checkpoint)
    got = {}
    for r in spark.read.parquet(out).orderBy("thread_id", "seq").collect():
        got.setdefault(r.thread_id, []).append((r.seq, r.event_id, r.stage))
    assert got["a"] == [(1, "1", "interpret"), (2, "2", "approve"), (3, "4", "extract_confirm"), (4, None, "report"), (5, "7", "interpret")]
    assert got["b"] == [(1, "3", "interpret"), (2, None, "report"), (3, "6", "interpret")] and got["c"] == [(1, "5", "interpret")] and "d" not in got


def test_usage_windows_drop_late_rows(spark, tmp_path):
    from datetime import datetime

    given, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "ts timestamp, stage string, seconds double"
    for hours in ((0.1, 0.2), (5.0,), (0.3, 5.1), (9.0,)):
        spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(hours=h), "gate", 1.0) for h in hours], schema).coalesce(1).write.mode("append").parquet(given)
        stream = ingest.windowed_usage(spark.readStream.schema(schema).parquet(given))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {(r.start.hour, r.calls) for r in spark.read.parquet(out).collect()} == {(0, 2), (5, 2)}


def test_extraction_skips_what_is_done(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "tables"))
    catalog.write("parsed", spark.createDataFrame([(f"p{i}", f"Title {i}\nWe introduce Net{i} X here." if i != 2 else None) for i in range(4)], "paper_id string, text string"))
    catalog.write("lexicon", spark.createDataFrame([], "ord long, label string, aliases array<string>, status string, definition string, source string, first_seen string"))
    engine = Engine(spark, catalog)
    assert engine.extract(first=2) == {"new": 2, "skipped": 0, "failed": 0}
    assert engine.extract() == {"new": 1, "skipped": 2, "failed": 1}
    assert engine.extract() == {"new": 0, "skipped": 3, "failed": 1}  # a failure is tried again
    assert engine.take_in() == 3 and engine.take_in() == 0
    assert {r.canonical for r in catalog.read("nodes").collect()} == {"Net0 X", "Net1 X", "Net3 X"}
    assert engine.extract(force=True) == {"new": 3, "skipped": 0, "failed": 1} and catalog.read("extractions").count() == 3


def test_candidates_come_in_order(spark):
    from strandgraph.operators import candidates

    rows = [("b", "1", "s1;s2", "x"), ("B", "2", "s1", "y"), ("a", "3", "s1", "y"), ("A", "4", "s1", "x")]
    out = candidates.listed(spark.createDataFrame(rows, "title string, paper_id string, source string, tag string").repartition(3)).collect()
    assert [r.paper_id for r in out] == ["4", "3", "2", "1"]


def test_rejected_rows_stand_beside_good_ones(spark, tmp_path):
    from strandgraph.sources import files, rejects

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"paper_id": "p", "title": "T", "paper_type": "survey", "defines": []}\n{broken\n{"paper_id": "q", "title": " ", "paper_type": "poem", "defines": [{"name": null}]}\n{"paper_id": "r"}\n')
    schema = "paper_id string, title string, paper_type string, defines array<struct<name string, definition string>>"
    done = rejects.json_rows(spark, str(tmp_path / "a"), schema, rejects.extraction_rules())
    assert [r.paper_id for r in done.good.collect()] == ["p"]
    assert sorted((len(r.row) > 0, r.reasons) for r in done.rejected.collect()) == sorted([
        (True, ["not readable"]), (True, ["no title", "unknown paper_type", "a definition without a name"]), (True, ["no title", "unknown paper_type", "no list of definitions"])])
    (tmp_path / "seen.json").write_text("{broken")
    parts = files.reviewed_parts(spark, str(tmp_path / "seen.json"))
    assert parts.good.count() == 0 and parts.rejected.first().row == "{broken"
    (tmp_path / "t.csv").write_text('n,s\n1,"a, ""b"""\nx,c\n2,d,e\n3,f\n')
    done = rejects.csv_rows(spark, str(tmp_path / "t.csv"), "n int, s string", {"f": F.col("s") == "f"})
    assert [(r.n, r.s) for r in done.good.collect()] == [(1, 'a, "b"')] and sorted(r.reasons for r in done.rejected.collect()) == [["f"], ["not readable"], ["not readable"]]


def test_feeds_are_read_once_whatever_restarts(spark, tmp_path):
    from strandgraph.sources import files

    given, out, checkpoint = (tmp_path / x for x in ("in", "out", "checkpoint"))
    given.mkdir()
    for k in range(3):
        (given / f"{9 - k}.xml").write_text(f"<feed><entry><id>{k}</id></entry><entry><id>{k}b</id></entry></feed>")
        stream = files.feed_stream(spark, str(given), "id string")
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(out)).collect()) == ["0", "0b", "1", "1b", "2", "2b"]


def test_a_threads_state_is_read_and_written_once_a_batch():
    """However many events a thread has in a batch, its state takes a fixed number of calls; ids that are too old go."""
    calls = []

    class Value:
        kept = None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, new):
            calls.append("update")
            self.kept = new

    class Handle:
        getValueState = lambda self, *a: Value()
        registerTimer = deleteTimer = lambda self, at: calls.append("timer")

    class Times:
        getCurrentWatermarkInMs = lambda self: 100

    steps = sessions._Steps(timedelta(days=1), timedelta(milliseconds=50))
    steps.init(Handle())
    rows = [Row(at=n * 1000, event_id=str(n), decision="proceed") for n in range(300)]
    assert len(list(steps.handleInputRows((1,), iter(rows + rows), Times()))) == 300
    assert len(calls) <= 4 and steps.now.kept[3] == [str(n) for n in range(50, 300)]
    assert list(steps.handleInputRows((1,), iter(rows[50:]), Times())) == []
