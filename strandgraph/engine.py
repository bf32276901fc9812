"""One object for clients: graph views, papers, lexicon edits, commands, rebuilds, sessions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions import annotators, prompts
from strandgraph.functions.text import STATUSES, canon, excerpt, extract_target, id_month, norm_id
from strandgraph.functions.vectors import top_k
from strandgraph.operators import audit, dml, explore, incremental, queue, review, views, workflow
from strandgraph.operators.normalize import Graph
from strandgraph.sources import files
from strandgraph.sources.catalog import Catalog, Conflict, Draft
from strandgraph.sources.durable import stored


class Engine:
    """Reads the last versions of a catalog's tables and writes new ones.

    Tables: mentions, papers, lexicon (inputs); nodes, relations, paper_nodes (built); reviewed (rk),
    cards, parsed, extractions, embeddings, sessions (optional).
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, settings: prompts.Settings | None = None):
        self.spark, self.catalog, self.settings = spark, catalog, settings or prompts.Settings()

    def graph(self) -> Graph:
        return Graph(*(self.catalog.read(t) for t in ("mentions", "papers", "lexicon")), in_files=True)

    def rebuild(self) -> dict[str, int]:
        """Normalize all mentions, store the graph, compare what was stored with the views of the normalized graph.

        Tables are compared by digests; rows are only compared where these differ.
        """
        graph = self.graph()
        for name, rows in (("nodes", graph.nodes), ("relations", graph.relations), ("paper_nodes", graph.papers)):
            self.catalog.write(name, rows)
        for name, rows in (("nodes", graph.nodes), ("relations", graph.relations), ("paper_nodes", graph.papers)):
            have = self.catalog.read(name)
            if audit.digest(have) == audit.digest(rows):
                continue
            drift = audit.multiset_diff(have, rows).count()
            if drift:
                raise RuntimeError(f"the stored {name} differ from their sources in {drift} rows")
        return {t: self.catalog.read(t).count() for t in ("nodes", "relations", "paper_nodes")}

    def extract(self, call: Callable | None = None, force: bool = False, first: int | None = None, **how: object) -> dict[str, int]:
        """Extract the parsed papers (paper_id, text) that haven't been yet: how many are new, skipped, failed.

        Results go to extractions, what was asked to extract_log. A paper that fails stays to be asked
        again and stops no other. first takes the first papers by id only, for a trial.
        """
        state = self.catalog.last()
        papers = state.read("parsed").select("paper_id", "text")
        papers = papers.orderBy("paper_id").limit(first) if first else papers
        none = f"id {papers.schema['paper_id'].dataType.simpleString()}, prompt_ver string, ok boolean, error string"
        done = state.read("extract_log") if "extract_log" in state else self.spark.createDataFrame([], none)
        told = stored(annotators.fill(papers, done, prompts.EXTRACT, F.col("text"), id_col="paper_id", force=force, call=call, **how))
        new = stored(told.where("ok").select(F.col("id").alias("paper_id"), "title", "task", "defines", "uses", "problem", "domain", "paper_type"))
        log = told.select("id", "prompt_ver", "ok", "error")

        def keep(draft: Draft) -> None:
            rest = draft.read("extractions").join(new, "paper_id", "left_anti").unionByName(new, allowMissingColumns=True) if "extractions" in draft else new
            draft.write("extractions", stored(rest))
            draft.append("extract_log", log)

        self.catalog.transact(keep)
        n = told.agg(F.count_if("ok").alias("new"), F.count_if(~F.col("ok")).alias("failed")).first()
        return {"new": n["new"], "skipped": papers.count() - n["new"] - n["failed"], "failed": n["failed"]}

    def take_in(self) -> int:
        """Carry extractions (with relations, where there are any) that the graph doesn't have yet into it,
        by what they change: the number of papers."""
        state = self.catalog.last()
        have = state.read("papers").select("paper_id") if "papers" in state else None
        new = state.read("extractions") if have is None else state.read("extractions").join(have, "paper_id", "left_anti")
        new = stored(new)
        none = self.spark.createDataFrame([], f"paper_id {new.schema['paper_id'].dataType.simpleString()}, builds_on array<string>")
        both = files.with_relations(new, state.read("relation_files") if "relation_files" in state else none)
        n = new.count()
        if n:
            incremental.ingest_batch(self.catalog, stored(files.mentions(both)), new.select("paper_id", "title", "problem", "domain", "paper_type"))
        return n

    def graph_view(self, include_papers: bool = False) -> dict[str, DataFrame]:
        out = views.graph_view(self.graph(), include_papers)
        out["nodes"] = explore.with_reviewed(out["nodes"], self.reviewed())
        return out

    def reviewed(self) -> DataFrame:
        return self.catalog.read("reviewed") if self.catalog.versions("reviewed") else self.spark.createDataFrame([], "rk string")

    def set_reviewed(self, rk: str, flag: bool) -> None:
        self.catalog.write("reviewed", dml.set_reviewed(self.reviewed(), rk, flag))

    def paper_detail(self, paper_id: object) -> DataFrame:
        """Extraction and text excerpt; a paper that neither knows is an error."""
        same = F.col("paper_id") == F.lit(paper_id)
        both = self.catalog.read("extractions").where(same).join(self.catalog.read("parsed").where(same).select("paper_id", excerpt(F.col("text")).alias("excerpt")), "paper_id", "full_outer")
        if both.isEmpty():
            raise LookupError(f"no paper {paper_id}")
        return both

    def lexicon(self) -> DataFrame:
        return self.catalog.read("lexicon").select("label", "status", "aliases", F.coalesce("definition", F.lit("")).alias("definition"), F.coalesce("source", F.lit("")).alias("source"))

    def patch_concept(self, label: str, **fields: object) -> str:
        """Set status, aliases or definition; a rejected concept also leaves the stored graph (see _synced)."""
        unknown = set(fields) - {"status", "aliases", "definition"}
        if unknown or fields.get("status", STATUSES[0]) not in STATUSES:
            raise ValueError(f"can't set {sorted(unknown) or fields['status']}")
        rows = self.catalog.read("lexicon")
        if rows.where(F.col("label") == label).isEmpty():
            raise LookupError(f"no concept {label}")
        new = {k: F.when(F.col("label") == label, F.lit(v)).otherwise(F.col(k)) for k, v in fields.items()}
        self.catalog.write("lexicon", rows.withColumns(new))

        def reject() -> None:
            rk = self.spark.range(1).select(canon(F.lit(label)).alias("rk")).first()["rk"]
            relations, nodes = dml.reject_concept(self.catalog.read("relations"), self.catalog.read("nodes"), rk)
            self.catalog.write("relations", relations)
            self.catalog.write("nodes", nodes)

        return self._synced(reject) if fields.get("status") == "rejected" else "none"

    def _synced(self, edit: Callable[[], None]) -> str:
        """Carry an edit of the lexicon over to the stored graph: 'ok', 'none' without a graph, or the
        error; the lexicon keeps its edit, and the next rebuild makes up for the graph."""
        if not self.catalog.versions("nodes"):
            return "none"
        try:
            edit()
        except Exception as error:  # the graph store's failure must not undo the lexicon
            return f"failed: {error}"
        return "ok"

    def merge_concepts(self, src: str, dst: str) -> str:
        """src's names become aliases of dst, first in the lexicon, then in the stored graph (see _synced)."""
        rows = self.catalog.read("lexicon")
        known = {r["label"]: r for r in rows.where(F.col("label").isin(src, dst)).collect()}
        if src == dst or len(known) < 2:
            raise LookupError("merging needs two different concepts")
        lost = F.array(*map(F.lit, known[src]["aliases"])).cast("array<string>")
        aliases = F.when(F.col("label") == dst, dml.alias_union(F.col("aliases"), lost, F.lit(src), F.lit(dst))).otherwise(F.col("aliases"))
        self.catalog.write("lexicon", rows.where(F.col("label") != src).withColumn("aliases", aliases))

        def merge() -> None:
            keys = self.spark.range(1).select(canon(F.lit(src)).alias("a"), canon(F.lit(dst)).alias("b")).first()
            parts = dml.merge_concept(self.catalog.read("relations"), self.catalog.read("nodes"), self.catalog.read("paper_nodes"), keys["a"], keys["b"])
            for name, part in zip(("relations", "nodes", "paper_nodes"), parts):
                self.catalog.write(name, part)

        return self._synced(merge)

    def review_cards(self) -> DataFrame:
        cards = self.catalog.read("cards")
        return cards.withColumn("rank", review.queue_rank(F.col("confidence"), F.lit(True)))

    def regenerate_cards(self, titles: DataFrame, call: Callable | None = None, parallel: int | None = None) -> int:
        """Suggest anew for pending concepts without a card, and drop cards of decided ones."""
        graph = self.graph()
        pending = graph.lexicon.where("status = 'pending'").select("label", canon(F.col("label")).alias("rk"))
        old = self.catalog.read("cards") if self.catalog.versions("cards") else None
        todo = pending if old is None else pending.join(old, "label", "left_anti")
        evidence = review.evidence_cards(graph.resolved, titles, graph.lexicon.select(canon(F.col("label")).alias("rk"), "definition"))
        similar = review.find_similar(todo.select("label"), graph.lexicon.where("status = 'approved'").select("ord", "label")).select("label", "similar")
        given = todo.join(evidence, "rk", "left").join(similar, "label", "left")
        defined = F.coalesce(F.transform("defined_in", lambda x: x["paper_id"].cast("string")), F.array().cast("array<string>"))
        told = annotators.ask(given, prompts.SUGGEST, F.col("label"), F.col("definition"), defined, F.col("similar"), call=call, id_col="label", parallel=parallel).where("ok")
        action = F.when(F.col("action") == "merge", F.concat(F.lit("merge_into:"), F.coalesce("merge_into", F.lit("?")))).otherwise(F.col("action"))
        new = told.select(F.col("id").alias("label"), F.lit("pending").alias("status"), action.alias("action"), "category", "reason", "confidence")
        kept = new if old is None else new.unionByName(old.join(pending, "label", "left_semi").select(*new.columns))
        self.catalog.write("cards", stored(kept))
        return self.catalog.read("cards").count()

    def semantic_search(self, query: DataFrame, model: str, k: int = 8) -> DataFrame:
        """The nearest nodes of the live graph."""
        hits = top_k(self.catalog.read("embeddings"), query, k, model=model)
        return hits.join(self.catalog.read("nodes").select(F.col("rk").alias("node_id")), "node_id", "left_semi")

    def months(self, graph: Graph) -> DataFrame:
        """(rk, month): the first month of the papers that a concept occurs in; papers may lack months."""
        papers = graph.papers if "month" in graph.papers.columns else graph.papers.withColumn("month", id_month(F.col("paper_id").cast("string")))
        return views.node_months(graph.relations, papers)

    def search(self, text: str, embed: Callable[[list[str]], list[dict]], model: str = "", k: int = 8) -> DataFrame:
        """(kind, node_id, score) of the concepts and the papers nearest in meaning, k of each, live ones only.

        embed makes the text's vector, as it made the stored ones: a model that made none of them is an error.
        Without a name the model is that of the settings.
        """
        model = model or self.settings.embedding
        if self.catalog.read("embeddings").where(F.col("model") == model).isEmpty():
            raise ValueError(f"no stored vector was made by {model!r}")
        query = self.spark.createDataFrame([(embed([text])[0]["vector"],)], "vector array<double>")
        store = files.embedding_store(self.catalog.read("embeddings"), model).withColumnRenamed("id", "node_id")
        live = {"concept": self.catalog.read("nodes").select(F.col("rk").alias("node_id")), "paper": self.catalog.read("paper_nodes").select(F.col("paper_id").cast("string").alias("node_id"))}
        found = [top_k(store.where(F.col("kind") == kind).drop("kind"), query, k).join(ids, "node_id", "left_semi").select(F.lit(kind).alias("kind"), "node_id", F.bround("score", 3).alias("score")) for kind, ids in live.items()]
        return found[0].unionByName(found[1])

    def nothing_known(self) -> DataFrame:
        return self.spark.createDataFrame([], "kind string, node_id string, score double, name string, said string")

    def known(self, text: str, embed: Callable[[list[str]], list[dict]], model: str, k: int = 8) -> DataFrame:
        """The hits of `search` with what they are: kind, node_id, score, name (a title for a paper), said."""
        hits = self.search(text, embed, model, k)
        return explore.with_metadata(hits, self.catalog.read("nodes"), self.catalog.read("paper_nodes"))

    def command(self, text: str, embed: Callable | None = None, model: str = "") -> tuple[explore.Command, DataFrame | None]:
        """Route a text and evaluate it. Searches by meaning give no rows without a function to embed with."""
        graph = self.graph()
        view = views.concept_view(graph)
        named = view.where(F.contains(F.lit(text.strip().lower()), F.lower("canonical"))).select("canonical")
        names = [r["canonical"] for r in named.orderBy(F.length("canonical").desc(), "canonical").limit(1).collect()]
        found = explore.route(text, names, ("technique", "survey", "benchmark", "analysis", "other"))
        if found.tool == "filter":
            found.args = explore.clean_filter(found.args)
            rows = stored(explore.filter_concepts(explore.with_reviewed(view.join(self.months(graph), "rk", "left"), self.reviewed()), **found.args))
            if rows.isEmpty():
                return explore.Command("none", {"message": explore.NOTHING_FITS}), None
            return found, rows
        if found.tool == "focus_lineage":
            starts = explore.resolve_node(view, self.spark.createDataFrame([(found.args["node"],)], "name string")).where("rk is not null")
            return found, explore.closure(views.lineage(graph), starts, found.args["direction"])
        if found.tool == "semantic_search" and embed is not None:
            return found, self.search(found.args["query"], embed, model)
        return found, view if found.tool == "reset" else None


class Session:
    """A resumable ingestion session. Each step does its work from the tables, keeps its result there
    and appends its state to the sessions table, so a restart goes on where the last step ended. Of two
    clients that resume one session at a time, one does the step and the other is told.

    Tables besides the engine's: feed (query_ord, entry_ord, query, id, title, summary, published), what
    searches found, ledger (paper_id, title, abstract, verdict, extracted, first_seen_query), verdicts
    (paper_id, prompt_ver, verdict, reason) and calls (stage, tokens, seconds). Calls are the prompts'
    stand-ins by default; embed and model, if given, find what the graph knows about the topic.
    """

    def __init__(self, engine: Engine, thread_id: str, calls: dict[str, Callable] | None = None, embed: Callable | None = None, model: str = ""):
        self.engine, self.thread_id, self.calls, self.embed, self.model = engine, thread_id, calls or {}, embed, model

    def _table(self, name: str, schema: str) -> DataFrame:
        state = self.engine.catalog.last()
        return state.read(name) if name in state else self.engine.spark.createDataFrame([], schema)

    def _append(self, stage: str, state: dict, seen: int) -> None:
        """The next state, if the session still is where this step began (its number of states)."""
        text = json.dumps(state, ensure_ascii=False)
        row = self.engine.spark.createDataFrame([(self.thread_id, seen, stage, text)], "thread_id string, seq long, stage string, state string")

        def add(draft: Draft) -> None:
            have = draft.read("sessions").where(F.col("thread_id") == self.thread_id).count() if "sessions" in draft else 0
            if have != seen:
                raise Conflict(f"session {self.thread_id} has gone on meanwhile")
            draft.append("sessions", row)

        self.engine.catalog.transact(add)

    def _ask(self, prompt: prompts.Prompt, text: str) -> dict:
        rows = self.engine.spark.createDataFrame([(0, text)], "id int, text string")
        asked = stored(annotators.annotate(rows, self.calls.get(prompt.name, prompt.offline), prompt.schema, prompt.version))
        self._log(prompt.name, asked)
        told = asked.first()
        if not told["ok"]:
            raise RuntimeError(f"{prompt.name} failed: {told['error']}")
        return {f: told[f] for f in told.asDict(True) if f not in ("id", "prompt_ver", "ok", "error", "seconds", "tokens")}

    def _log(self, stage: str, asked: DataFrame) -> None:
        self.engine.catalog.append("calls", stored(annotators.usage_log(asked, stage)))

    def start(self, text: str) -> dict:
        """Interpret what is asked for, see what the graph knows of it, and wait for a decision."""
        return self._interpret(text, self._seen())

    def _interpret(self, text: str, seen: int) -> dict:
        known = self._ask(prompts.INTENT, text)
        known |= self._related(known["topic"])
        self._append("interpret", known, seen)
        return known

    def _related(self, topic: str) -> dict:
        """Terms that the graph knows near the topic, and the report of its concepts and papers."""
        hits = self.engine.known(topic, self.embed, self.model) if self.embed else self.engine.nothing_known()
        hits = stored(hits)
        terms = [r["term"] for r in explore.hit_terms(hits).orderBy("ord").collect()]  # at most ten
        lines = workflow.status_report(topic, *[hits.where(F.col("kind") == k).select(workflow.hit_line(F.col("name"), F.col("said"), F.col("score"), "(none)").alias("line"), "score") for k in ("concept", "paper")])
        return {"related": terms, "report": [r["line"] for r in lines.orderBy("part", "ord", "line").collect()]}  # at most 16 hits

    def _seen(self) -> int:
        now = self.state()
        return 0 if now is None else now["seq"] + 1

    def state(self) -> dict | None:
        log = self._table("sessions", "thread_id string, seq long, stage string, state string")
        last = workflow.latest_state(log.where(F.col("thread_id") == self.thread_id), "thread_id", "seq").first()
        return last.asDict() if last else None

    def resume(self, decision: str) -> str:
        """Do the step that a decision leads to, and give the stage that is reached. 'revise:TEXT' asks anew."""
        now = self.state()
        if now is None:
            raise LookupError(f"no session {self.thread_id}")
        decision, _, text = decision.partition(":")
        stage, seen = workflow.stage_after(now["stage"], decision.strip()), now["seq"] + 1
        known = json.loads(now["state"])
        if stage == "parse":
            self._interpret(text.strip(), seen)
            return "interpret"
        if stage == "expand":
            known |= self._expand(known)
        elif stage == "gate":
            known |= self._gate(known)
        elif stage == "extract":
            known |= self._extract(known)
        reached = {"expand": "approve", "gate": "extract_confirm", "extract": "report"}.get(stage, stage)
        self._append(reached, known, seen)
        return reached

    def _expand(self, known: dict) -> dict:
        """Search phrases from the topic and related terms, guarded; what they find, counted, and in the ledger."""
        spark = self.engine.spark
        related = F.array(*map(F.lit, known.get("related") or [])).cast("array<string>")
        message = spark.range(1).select(prompts.EXPAND.message(F.lit(known["topic"]), related).alias("m")).first()["m"]
        asked = [(0, i, q) for i, q in enumerate(self._ask(prompts.EXPAND, message)["queries"])]
        asked = spark.createDataFrame(asked, "session int, ord int, query string")
        kept = workflow.guard_queries(asked)
        few = not workflow.too_few_queries(asked, kept).isEmpty()
        known = known | {"queries": [r["query"] for r in kept.orderBy("ord").collect()], "too_few_queries": few}  # a call's few phrases
        reasons = self._reasons(known)
        counts = workflow.dedup_counts(reasons).first().asDict()
        found = stored(reasons.select("paper_id", "title", "abstract", F.lit(None).cast("string").alias("verdict"), F.lit(False).alias("extracted"), "first_seen_query"))
        self.engine.catalog.transact(lambda d: d.write("ledger", stored(dml.upsert_ledger(d.read("ledger"), found)) if "ledger" in d else found))
        return {k: known[k] for k in ("queries", "too_few_queries")} | {"counts": counts}

    def _target(self, known: dict) -> int:
        return self.engine.spark.range(1).select(extract_target(F.lit(known.get("count")).cast("long")).alias("n")).first()["n"]

    def _reasons(self, known: dict) -> DataFrame:
        asked = self.engine.catalog.read("feed").where(F.col("query").isin(known["queries"]))
        papers = workflow.feed_entries(asked, known.get("period_from") or None, known.get("period_to") or None)
        ledger = self._table("ledger", "paper_id string, verdict string")
        return workflow.candidate_reasons(papers, self.engine.catalog.read("papers").select("paper_id"), ledger)

    def found(self, known: dict) -> DataFrame:
        """Papers of the feed for the session's queries, neither owned nor rejected, in a fixed order."""
        return self._reasons(known).where("reason = 'new'").withColumn("rank", F.struct("query_ord", "entry_ord"))

    def _gate(self, known: dict) -> dict:
        """Judge the found papers ten at a time until enough pass; a verdict that is known isn't asked for."""
        catalog, target = self.engine.catalog, self._target(known)
        cache = self._table("verdicts", "paper_id string, prompt_ver string, verdict string, reason string")
        done = queue.judge(self.found(known), cache, prompts.GATE, F.col("title"), F.col("abstract"), target=target, call=self.calls.get("gate"))
        self._log("gate", done.asked)
        new = done.asked.where("ok").select("paper_id", "prompt_ver", "verdict", "reason")
        verdicts = done.rows.select("paper_id", F.col("verdict").alias("v"))

        def keep(draft: Draft) -> None:
            draft.append("verdicts", new)
            draft.write("ledger", stored(draft.read("ledger").join(verdicts, "paper_id", "left").withColumn("verdict", F.coalesce("v", "verdict")).drop("v")))

        catalog.transact(keep)
        chosen = workflow.to_extract(done.rows, target).orderBy("rank").select("paper_id").collect()  # at most the extraction's cap
        parts = {r["part"]: r["n"] for r in workflow.gate_summary(done.rows).groupBy("part").agg(F.count("*").alias("n")).collect()}
        return {"to_extract": [r["paper_id"] for r in chosen], **parts, "gate_calls": done.asked.count(), "gate_cached": done.rows.where("cached").count()}

    def _extract(self, known: dict) -> dict:
        """Extract the chosen papers from their abstracts and add them to the engine's tables."""
        catalog = self.engine.catalog
        chosen = catalog.read("feed").withColumn("paper_id", norm_id(F.col("id"))).where(F.col("paper_id").isin(known["to_extract"])).groupBy("paper_id").agg(F.min_by(F.struct("title", "summary"), F.struct("query_ord", "entry_ord")).alias("x"))
        text = F.concat_ws("\n", "x.title", "x.summary")
        told = stored(annotators.ask(chosen, prompts.EXTRACT, text, call=self.calls.get("extract"), id_col="paper_id").where("ok"))
        built = annotators.ask(chosen, prompts.RELATE, text, call=self.calls.get("relate"), id_col="paper_id").where("ok").select(F.col("id").alias("paper_id"), "builds_on")
        both = files.with_relations(told.withColumnRenamed("id", "paper_id"), built)
        new = {"mentions": files.mentions(both), "papers": both.select("paper_id", "title", "problem", "domain", "paper_type")}
        new = {name: stored(rows) for name, rows in new.items()}
        ids = stored(both.select("paper_id"))

        def keep(draft: Draft) -> None:
            for name, rows in new.items():
                old = draft.read(name)
                rest = old.join(ids, "paper_id", "left_anti")
                draft.write(name, stored(rest.unionByName(rows.select(*[c for c in old.columns if c in rows.columns]), allowMissingColumns=True)))
            done = draft.read("ledger").join(ids.withColumn("now", F.lit(True)), "paper_id", "left")
            draft.write("ledger", stored(done.withColumn("extracted", F.coalesce("now", "extracted")).drop("now")))

        catalog.transact(keep)
        self._log("extract", told)
        return {"extracted": told.count()}
