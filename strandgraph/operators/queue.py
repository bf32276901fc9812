"""The judged queue: candidates are judged ten at a time until enough pass, and never twice.

Asking is what costs, so each round takes the next ten candidates of every session that still needs
some, looks up what is known under (paper, prompt version), and asks only about the rest, each paper
once whatever number of sessions want it. Rounds are few (five), so the loop is over rounds and each
one is a job over all sessions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions import annotators
from strandgraph.functions.prompts import Prompt
from strandgraph.operators.workflow import GATE_BATCH, GATE_MAX_BATCHES
from strandgraph.sources.durable import stored

PASSES = "technique"


@dataclass
class Judged:
    """rows: the sessions' columns, paper_id, rank, batch, verdict, cached, passed, error; asked: what was
    asked for anew, (paper_id, prompt_ver, ok, error, verdict, reason, seconds, tokens)."""

    rows: DataFrame
    asked: DataFrame


def known_verdicts(cache: DataFrame, version: str) -> DataFrame:
    """(paper_id, verdict) of this prompt version; the latest by judged_at where there are several."""
    order = F.col("judged_at") if "judged_at" in cache.columns else F.col("verdict")
    return cache.where((F.col("prompt_ver") == version) & F.col("verdict").isNotNull()).groupBy("paper_id").agg(F.max_by("verdict", order).alias("verdict"))


def judge(
    candidates: DataFrame, cache: DataFrame, prompt: Prompt, *message: Column, by: tuple[str, ...] = (), target: Column | int = 2, call: Callable | None = None,
    batch: int = GATE_BATCH, most: int = GATE_MAX_BATCHES, **how: object,
) -> Judged:
    """Judge candidates (by..., paper_id, rank, and what message needs) in rounds.

    Of a session at most batch * most candidates are looked at, and none after the round in which its
    target is reached. cache has paper_id, prompt_ver and verdict. A call that fails gives no verdict:
    the candidate doesn't pass and is asked about again another time. A paper that a session lists
    twice is judged once and listed twice.
    """
    keys = list(by)
    goal = target if isinstance(target, Column) else F.lit(target)
    order = Window.partitionBy(*keys).orderBy("rank", "paper_id") if keys else Window.partitionBy(F.lit(0)).orderBy("rank", "paper_id")
    head = candidates.withColumns({"_n": F.row_number().over(order), "_goal": goal}).where(F.col("_n") <= batch * most)
    head = stored(head.select(*keys, "paper_id", "rank", "_goal", F.floor((F.col("_n") - 1) / batch).cast("int").alias("batch"), prompt.message(*message).alias("_text")))
    known = stored(known_verdicts(cache, prompt.version).join(head.select("paper_id").distinct(), "paper_id", "left_semi"))
    session = F.struct(*keys) if keys else F.lit(0)
    done, asked = None, None
    for k in range(most):
        chunk = head.where(F.col("batch") == k).withColumn("_session", session)
        if done is not None:
            passed = done.where("passed").groupBy("_session").agg(F.count("*").alias("_passed"))
            chunk = chunk.join(passed, "_session", "left").where(F.coalesce("_passed", F.lit(0)) < F.col("_goal")).drop("_passed")
        chunk = stored(chunk)
        if chunk.isEmpty():
            break
        have = known if asked is None else known.unionByName(asked.where("ok").select("paper_id", "verdict"))
        todo = chunk.join(have, "paper_id", "left_anti").groupBy("paper_id").agg(F.first("_text").alias("text"))
        answers = annotators.annotate(todo, call or prompt.offline, prompt.schema, prompt.version, id_col="paper_id", **how)
        answers = stored(answers.select(F.col("id").alias("paper_id"), "prompt_ver", "ok", "error", F.col("type").alias("verdict"), "reason", "seconds", "tokens"))
        asked = answers if asked is None else asked.unionByName(answers)
        met = chunk.join(have.withColumn("cached", F.lit(True)), "paper_id", "left").join(answers.select("paper_id", F.col("verdict").alias("_new"), "error"), "paper_id", "left")
        rows = stored(met.select(
            "_session", *keys, "paper_id", "rank", "batch", F.coalesce("verdict", "_new").alias("verdict"), F.coalesce("cached", F.lit(False)).alias("cached"),
            F.coalesce(F.coalesce("verdict", "_new") == PASSES, F.lit(False)).alias("passed"), "error"))
        done = rows if done is None else done.unionByName(rows)
    if done is None:
        done = head.select(session.alias("_session"), *keys, "paper_id", "rank", "batch", F.lit("").alias("verdict"), F.lit(False).alias("cached"), F.lit(False).alias("passed"), F.lit("").alias("error"))
        none = "prompt_ver string, ok boolean, error string, verdict string, reason string, seconds double, tokens long"
        asked = head.select("paper_id", *[F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in none.split(", ")])
    return Judged(done.drop("_session"), asked)
