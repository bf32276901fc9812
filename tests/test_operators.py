import json

import pytest
from pyspark.sql import functions as F

from strandgraph.engine import Engine, Session
from strandgraph.functions import annotators, prompts, sections, vectors
from strandgraph.functions import text as T
from strandgraph.operators import candidates, dml, explore, review, score, workflow
from strandgraph.sources import files
from strandgraph.sources.catalog import Catalog
from strandgraph.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.canon(lit(" Self-RAG  x y"))) == "self rag x y"
    assert one(spark, T.norm_id(lit("http://x.org/abs/2401.12345v2/"))) == "2401.12345"
    assert one(spark, T.id_month(lit("2401.1"))) == "2024-01" and one(spark, T.id_month(lit("ab"))) is None
    assert one(spark, T.boundary_cut(lit("a" * 70 + ". " + "b" * 60), 100)) == "a" * 70 + "."
    assert one(spark, T.boundary_cut(lit("a. " + "b" * 200), 100)) == "a. " + "b" * 97
    assert one(spark, T.extract_target(lit(0))) == 2 and one(spark, T.extract_target(lit(50))) == 10
    assert one(spark, T.leaks_section(lit("x\n2. Related Work\ny"))) is True
    assert one(spark, T.abbreviated(lit(17000))) == "17.0k" and one(spark, T.abbreviated(lit(999))) == "999"
    assert one(spark, T.slug(lit("a b(c)"))) == "a_b_c"


def test_section_cut(spark):
    intro = "Abstract\n" + "Words here. " * 300 + "\n"
    later = "12\n2\nMethods\nrest"  # after a page number
    cases = {
        intro + "2 Related Work\nrest": (intro, "section"),
        "x" * 100 + "\n" + intro + "2. Our Things\nx": (intro, "section"),
        intro + later: (intro, "section"),
        intro + "and so\n2. Our Things\nx\n2 Background\n": (intro + "and so\n2. Our Things\nx\n", "section"),  # in mid-sentence
    }
    fallback = [intro + "2. Our Things\nx\n3. Other\n", "2 Related Work\n" + "a. " * 900, intro + "2 things in lower case\n", intro + "2Wiki\n", "", None]
    rows = spark.createDataFrame([(t,) for t in [*cases, *fallback]], "text string").select(sections.section_cut(F.col("text")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in rows[: len(cases)]] == list(cases.values())
    assert all(r.cut_method == "head6000" for r in rows[len(cases) :]) and rows[-1].text == ""
    no_abstract = "x" * 5100 + " abstract " + "y " * 1000
    assert one(spark, sections.section_cut(F.lit(no_abstract)))["text"] == one(spark, T.boundary_cut(F.lit(no_abstract)))


def test_vectors(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.8, 0.6]), (4, [0.8, 0.6]), (5, [-1.0, 0.0])], "node_id int, vector array<double>")
    hits = vectors.top_k(store, spark.createDataFrame([([2.0, 0.0],)], "vector array<double>"), 2)
    assert [(r.node_id, round(r.score, 6)) for r in hits.collect()] == [(1, 1.0), (3, 0.8)]


def test_closure_ends_on_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "rk string")
    got = lambda d: {r.rk for r in explore.closure(pairs, start, d).collect()}
    assert got("ancestors") == {"b", "c"} and got("descendants") == {"b", "c", "d"} and got("both") == {"b", "c", "d"}


def test_gate_stops_after_the_batch_that_reaches_the_target(spark):
    for passes, target, want in (([1] * 100, 3, 10), ([0] * 100, 3, 50), ([0] * 15 + [1] * 85, 3, 20), ([], 3, 0)):
        c = spark.createDataFrame([(i, bool(p)) for i, p in enumerate(passes)], "rank int, passed boolean")
        assert workflow.gate_batches(c, target).count() == want
    assert workflow.stage_after("interpret", "cancel") == "report" and workflow.stage_after("approve", "proceed") == "gate"


def test_feed_and_ledger(spark):
    raw = spark.createDataFrame([(0, 0, "q", "x/2401.1v2", "a\n b", "s", "2024-01-02"), (1, 0, "r", "2401.1", "late", "s", "2024-01-02"), (1, 1, "r", "2402.2", "t", "s", None), (1, 2, "r", "1901.2", "t", "s", "2019-01-01")], "query_ord int, entry_ord int, query string, id string, title string, summary string, published string")
    got = {r.paper_id: (r.title, r.first_seen_query) for r in workflow.feed_entries(raw, "2020-01").collect()}
    assert got == {"2401.1": ("a b", "q"), "2402.2": ("t", "r")}


def test_merge_and_upsert(spark):
    rel = spark.createDataFrame([(1, "a", "defines"), (1, "b", "defines"), (2, "a", "builds_on")], "paper_id int, rk string, type string")
    nodes = spark.createDataFrame([("a", "said", "ok"), ("b", "", "placeholder")], "rk string, definition string, def_status string")
    papers = spark.createDataFrame([(1, "a")], "paper_id int, home_concept string")
    r, n, p = dml.merge_concept(rel, nodes, papers, "a", "b")
    assert {tuple(x) for x in r.collect()} == {(1, "b", "defines"), (2, "b", "builds_on")}
    assert [tuple(x) for x in n.select("rk", "definition", "def_status").collect()] == [("b", "said", "ok")] and p.first().home_concept == "b"
    assert dml.merge_concept(rel, nodes, papers, "a", "zz")[0].count() == 1  # no such node: the edges go
    old = spark.createDataFrame([("a", "A", "approved", "", "placeholder"), ("b", "B", "approved", "kept", "ok")], "rk string, name string, status string, definition string, def_status string")
    new = old.select("rk", F.upper("rk").alias("name"), F.lit("rejected").alias("status"), F.lit("new").alias("definition"), F.lit("ok").alias("def_status"))
    assert {(x.rk, x.status, x.definition) for x in dml.upsert_concepts(old, new).collect()} == {("a", "rejected", "new"), ("b", "rejected", "kept")}


def test_scores(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "paper_id int, rk string")
    statuses = spark.createDataFrame([("a", "approved"), ("b", "pending"), ("c", "approved"), ("d", "approved")], "rk string, status string")
    items = score.items(rows((1, "a"), (1, "b"), (1, "d"), (2, "a")), rows((1, "a"), (1, "b"), (1, "c")), statuses, T.NODE_OK)
    got = {(r.paper_id, r.rk): (r.verdict, r.diag) for r in items.collect()}
    assert got == {(1, "a"): ("TP", None), (1, "b"): ("FN", "lexicon_dropped"), (1, "c"): ("FP", None), (1, "d"): ("FN", "not_extracted"), (2, "a"): ("FN", "not_extracted")}
    total = score.totals(score.by_paper(items)).first()
    assert (total.micro_p, total.micro_r, total.macro_p) == (0.5, 0.25, 0.5)


def test_candidates(spark):
    r = spark.createDataFrame([(0, "Big  Net", "", "s2", "x"), (1, "big net!", "p1", "s1", "y"), (2, "Other", "", "s1", "x")], "ord int, title string, paper_id string, source string, tag string")
    got = {(x.title, x.paper_id, x.source, x.tag) for x in candidates.merge(candidates.backfill(r)).collect()}
    assert got == {("Big  Net", "p1", "s1;s2", "x;y"), ("Other", "", "s1", "x")}


def test_files_and_markdown(spark, tmp_path):
    (tmp_path / "p1.concepts.json").write_text(json.dumps({"title": "T", "defines": [{"name": "A", "definition": None}]}))
    (tmp_path / "p2.concepts.json").write_text(json.dumps({"title": "U", "defines": []}))
    (tmp_path / "p1.relations.json").write_text(json.dumps({"builds_on": ["B", "C"]}))
    both = files.with_relations(files.extractions(spark, str(tmp_path)), files.relations(spark, str(tmp_path)))
    got = {(r.paper_id, r.phase, r.idx, r.name, r.definition) for r in files.mentions(both).collect()}
    assert got == {("p1", 0, 0, "A", ""), ("p1", 1, 0, "B", ""), ("p1", 1, 1, "C", "")}
    (tmp_path / "lex.json").write_text(json.dumps({"techniques": {"A": {"aliases": ["a1"], "status": "approved"}, "B": {"status": "pending"}}}))
    assert [(r.ord, r.label, r.aliases) for r in files.lexicon(spark, str(tmp_path / "lex.json")).orderBy("ord").collect()] == [(0, "A", ["a1"]), (1, "B", [])]
    (tmp_path / "seen.json").write_text("{broken")
    assert files.reviewed(spark, str(tmp_path / "seen.json")).count() == 0
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["## A", "### B", "- x [T](u)", "## C", "- [V](w)", "| a | b |", "|---|---|"])], "file string, line_no int, value string")
    assert [(r.section, r.title, r.url) for r in files.markdown_bullets(files.markdown_sections(lines)).orderBy("line_no").collect()] == [("A / B", "T", "u"), ("C", "V", "w")]
    assert [r.cells for r in files.markdown_table(lines).collect()] == [["a", "b"]]


def _catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "tables"))
    catalog.write("lexicon", spark.createDataFrame([(0, "B", ["bee"], "approved", "", "", "")], "ord long, label string, aliases array<string>, status string, definition string, source string, first_seen string"))
    return catalog


def test_command_sends_one_name_to_the_driver(spark, monkeypatch):
    view = spark.createDataFrame([(n,) for n in ["Graph", "Graph RAG", "GRAPH rag", "Tree", None]], "canonical string")
    monkeypatch.setattr("strandgraph.engine.views.concept_view", lambda graph: view)
    monkeypatch.setattr(Engine, "graph", lambda self: None)
    seen, plain = [], explore.route
    monkeypatch.setattr(explore, "route", lambda text, names, *rest: seen.append(names) or plain(text, names, *rest))
    for text in ("find papers like graph RAG", "reset", "tree rings"):
        Engine(spark, None).command(text)
    assert seen == [["GRAPH rag"], [], ["Tree"]]


def test_engine(spark, tmp_path):
    catalog = _catalog(spark, tmp_path)
    catalog.write("mentions", spark.createDataFrame([("p", 0, 0, "A", "d"), ("p", 1, 0, "bee", "")], "paper_id string, phase int, idx int, name string, definition string"))
    catalog.write("papers", spark.createDataFrame([("p", None, None, None, None)], "paper_id string, title string, problem string, domain string, paper_type string"))
    engine = Engine(spark, catalog)
    assert engine.rebuild() == {"nodes": 2, "relations": 2, "paper_nodes": 1}
    command, rows = engine.command("ancestors of A")
    assert command.tool == "focus_lineage" and [r.rk for r in rows.collect()] == ["b"]
    engine.set_reviewed("a", True)
    assert {r.rk: r.reviewed for r in engine.graph_view()["nodes"].collect()} == {"a": True, "b": False}
    engine.patch_concept("B", status="rejected")
    assert [r.rk for r in catalog.read("nodes").collect()] == ["a"]
    with pytest.raises(LookupError):
        engine.patch_concept("zz", status="approved")
    catalog.restore("lexicon", 1)
    assert catalog.versions("lexicon") == [1]


def test_stream_equals_batch(spark, tmp_path):
    catalog = _catalog(spark, tmp_path)
    folder = tmp_path / "in"
    folder.mkdir()
    for paper, defines, builds in (("p1", "A", ["bee"]), ("p2", "C", ["A"])):
        (folder / f"{paper}.json").write_text(json.dumps({"title": paper, "defines": [{"name": defines, "definition": "d"}], "builds_on": builds}))
        ingest.ingest(ingest.extraction_stream(spark, str(folder)), catalog, str(tmp_path / "ck")).awaitTermination()
    engine = Engine(spark, catalog)
    want = {tuple(r) for r in engine.graph().relations.collect()}
    assert {tuple(r) for r in catalog.read("relations").collect()} == want and len(want) == 4


def test_annotators_isolate_failures(spark):
    def call(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [{"n": len(t)} for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "x"), (4, None)], "id int, text string")
    told = annotators.annotate(rows, call, "n int", "v1")
    got = {r.id: (r.ok, r.n, r.error) for r in told.collect()}
    assert got == {1: (True, 3, None), 2: (False, None, "no"), 3: (True, 1, None), 4: (False, None, "no text")}
    assert {r.id for r in annotators.missing(rows, told, "v1").collect()} == {2, 4}
    assert annotators.usage_log(told, "s").count() == 3


def test_prompts_have_stand_ins_that_fit_their_schemas(spark):
    rows = spark.createDataFrame([(1, "We introduce Graph Net here.\nIt builds on Deep Walk."), (2, None)], "id int, text string")
    told = {p.name: annotators.ask(rows, p, *cols).orderBy("id").collect() for p, cols in (
        (prompts.EXTRACT, [F.col("text")]), (prompts.RELATE, [F.col("text")]), (prompts.INTENT, [F.lit("find 5 papers about graph memory since 2021")]),
        (prompts.EXPAND, [F.lit("graph memory for agents"), F.array(F.lit("x"))]), (prompts.GATE, [F.lit("A survey"), F.col("text")]), (prompts.SUGGEST, [F.lit("X"), F.lit(""), F.array(F.lit("p1")), F.lit(None).cast("string")]))}
    assert told["extract"][0].defines[0].name == "Graph Net" and told["relate"][0].builds_on == ["Deep Walk"] and not told["extract"][1].ok
    intent = told["parse_intent"][0]
    assert (intent.topic, intent.period_from, intent["count"]) == ("graph memory", "2021-01", 5)
    assert told["expand"][0].queries[0] == "graph memory for" and told["gate"][0].type == "survey" and told["suggest"][0].action == "approve"


def test_session_does_its_work_and_resumes(spark, tmp_path):
    catalog = _catalog(spark, tmp_path)
    catalog.write("mentions", spark.createDataFrame([("p", 0, 0, "A", "d")], "paper_id string, phase int, idx int, name string, definition string"))
    catalog.write("papers", spark.createDataFrame([("p", None, None, None, None)], "paper_id string, title string, problem string, domain string, paper_type string"))
    entries = [(0, i, "graph memory", f"x/240{i}.0000{i}v1", f"Paper {i}" if i % 2 else "A survey", f"We propose New{i} Net. It builds on A.", "2024-01-02") for i in range(6)]
    catalog.write("feed", spark.createDataFrame([*entries, (1, 0, "graph memory", "x/p", "old", "s", "2024-01-02")], "query_ord int, entry_ord int, query string, id string, title string, summary string, published string"))
    engine = Engine(spark, catalog)
    assert Session(engine, "t").start("find 2 papers about graph memory since 2020")["count"] == 2
    assert Session(engine, "t").resume("proceed") == "approve" and "graph memory" in json.loads(Session(engine, "t").state()["state"])["queries"]
    assert Session(engine, "t").resume("proceed") == "extract_confirm"
    state = json.loads(Session(engine, "t").state()["state"])
    assert state["to_extract"] == ["2401.00001", "2403.00003"] and (state["passed"], state["failed"]) == (3, 3)
    assert Session(engine, "t").resume("proceed") == "report" and json.loads(Session(engine, "t").state()["state"])["extracted"] == 2
    assert {r.paper_id for r in catalog.read("papers").collect()} == {"p", "2401.00001", "2403.00003"}
    assert {(r.name, r.phase) for r in catalog.read("mentions").where("paper_id <> 'p'").collect()} == {("New1 Net", 0), ("New3 Net", 0), ("A", 1)}
    assert catalog.read("ledger").where("verdict is not null").count() == 6 and engine.rebuild()["nodes"] == 2  # A is first met as a reference
    with pytest.raises(LookupError):
        Session(engine, "zz").resume("proceed")


def test_commands_with_dates_and_meaning(spark, tmp_path):
    catalog = _catalog(spark, tmp_path)
    catalog.write("mentions", spark.createDataFrame([("2401.1", 0, 0, "A", "graph memory of agents"), ("2101.1", 0, 0, "Old", "walks")], "paper_id string, phase int, idx int, name string, definition string"))
    catalog.write("papers", spark.createDataFrame([("2401.1", "t", "p", None, "technique"), ("2101.1", "t", "p", None, "technique")], "paper_id string, title string, problem string, domain string, paper_type string"))
    engine = Engine(spark, catalog)
    engine.rebuild()
    command, rows = engine.command("technique after 2023")
    assert command.args == {"ptype": "technique", "date_after": "2023-01"} and [r.rk for r in rows.collect()] == ["a"]
    vectors_ = annotators.hashed_embedding(["graph memory of agents", "walks", "gone"])
    catalog.write("embeddings", spark.createDataFrame([(n, "m", v["vector"]) for n, v in zip(("concept:a", "concept:old", "concept:gone"), vectors_)], "node_id string, model string, vector array<float>"))
    command, rows = engine.command("memory of graph agents", annotators.hashed_embedding, "m")
    assert command.tool == "semantic_search" and [(r.kind, r.node_id, r.score) for r in rows.collect()] == [("concept", "a", 1.0)]
    assert explore.route("ancestors of nothing", []).tool == "none"
    lexicon = catalog.read("lexicon")
    catalog.write("lexicon", lexicon.unionByName(lexicon.selectExpr("1L as ord", "'Old' as label", "array('o') as aliases", "'pending' as status", "'' as definition", "source", "first_seen")))
    assert engine.regenerate_cards(catalog.read("papers")) == 1 and catalog.read("cards").first().action == "approve"


def test_command_line(spark, tmp_path, capsys):
    from strandgraph.__main__ import main

    catalog = _catalog(spark, tmp_path)
    catalog.write("mentions", spark.createDataFrame([("p", 0, 0, "A", "d")], "paper_id string, phase int, idx int, name string, definition string"))
    catalog.write("papers", spark.createDataFrame([("p", None, None, None, None)], "paper_id string, title string, problem string, domain string, paper_type string"))
    main([str(tmp_path / "tables"), "--rebuild", "--audit", "--command", "reset"], spark)
    assert "'nodes': 1" in capsys.readouterr().out
    (tmp_path / "plan.csv").write_text("label,new_status\nzz,approved\n")
    with pytest.raises(SystemExit):
        main([str(tmp_path / "tables"), "--apply", str(tmp_path / "plan.csv")], spark)


def test_feeds_and_pdf_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><id>http://x/2401.1v1</id><title>T</title><summary>S</summary><published>2024-01-02</published></entry><entry><id>b</id></entry></feed>")
    assert {(r.id, r.title) for r in files.feed(spark, str(tmp_path / "f.xml")).collect()} == {("http://x/2401.1v1", "T"), ("b", None)}
    (tmp_path / "a.pdf").write_bytes(b"x" * 10_000)
    (tmp_path / "b.pdf").write_bytes(b"x" * 9_999)
    assert [r.paper_id for r in files.pdf_files(spark, str(tmp_path)).collect()] == ["a"]
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.json").write_text('{"paper_id": "p", "title": "T", "defines": []}\n{broken\n')
    assert {(r.paper_id, r._corrupt_record) for r in files.extraction_lines(spark, str(lines)).collect()} == {("p", None), (None, "{broken")}


def test_similar_names_need_no_common_word(spark):
    a = spark.createDataFrame([("the graph net",), ("ab",), ("the",), ("x y z w",)], "label string")
    b = spark.createDataFrame([(1, "graph net"), (2, "Alpha Beta"), (3, "the thing"), (4, "x y z v"), (5, "the")], "ord int, label string")
    got = {r.label: (r.similar, r.score) for r in review.find_similar(a, b).collect()}
    assert got == {"the graph net": ("graph net", 0.8), "ab": ("Alpha Beta", 0.95), "the": ("the thing", 0.8), "x y z w": ("x y z v", 0.6)}
