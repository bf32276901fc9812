"""Scoring extracted references against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.text import canon

#: Names that are components and tools, and names of base models (fixed values).
COMPONENT_TOOL = ("PPO", "GRPO", "Group Relative Policy Optimization", "Monte Carlo Tree Search", "MCTS", "RL", "reinforcement learning", "RAGAS", "ARES", "TruLens")
SUBSTRATE = ("BERT", "RoBERTa", "GPT-2", "GPT-3", "GPT-J", "T5", "PaLM", "OPT", "BLOOM", "Qwen", "Qwen-2.5", "LLaMA", "Llama")


def items(gold: DataFrame, raw: DataFrame, statuses: DataFrame, ok: tuple[str, ...]) -> DataFrame:
    """(paper_id, rk, verdict, diag): TP, FP or FN for every pair in gold or prediction.

    gold and raw are (paper_id, rk); only predicted concepts with a good status count. A missed one
    is 'lexicon_dropped' if it was predicted with another status, else 'not_extracted'.
    """
    g = gold.select("paper_id", "rk").distinct().withColumn("in_gold", F.lit(True))
    p = raw.select("paper_id", "rk").distinct().join(statuses.select("rk", F.col("status").isin(*ok).alias("is_ok")), "rk", "left")
    both = g.join(p.select("paper_id", "rk", F.coalesce("is_ok", F.lit(False)).alias("is_ok")), ["paper_id", "rk"], "full_outer")
    verdict = F.when(F.col("in_gold") & F.col("is_ok"), "TP").when(F.col("in_gold"), "FN").when(F.col("is_ok"), "FP")
    diag = F.when(verdict == "FN", F.when(F.col("is_ok").isNotNull(), "lexicon_dropped").otherwise("not_extracted"))
    return both.select("paper_id", "rk", verdict.alias("verdict"), diag.alias("diag")).where("verdict is not null")


def by_paper(scored: DataFrame) -> DataFrame:
    """(paper_id, tp, fp, fn, p, r): precision and recall are null where they aren't defined."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = scored.groupBy("paper_id").agg(n("TP").alias("tp"), n("FP").alias("fp"), n("FN").alias("fn"))
    return out.withColumns({"p": F.try_divide("tp", F.col("tp") + F.col("fp")), "r": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def _totals() -> list[Column]:
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return [F.count("*").alias("n_papers"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.try_divide(tp, tp + fp).alias("micro_p"), F.try_divide(tp, tp + fn).alias("micro_r"), F.avg("p").alias("macro_p"), F.avg("r").alias("macro_r")]


def totals(papers: DataFrame) -> DataFrame:
    """One row of micro and macro averages; macro skips papers where a value isn't defined."""
    return papers.agg(*_totals())


def by_group(papers: DataFrame, groups: DataFrame) -> DataFrame:
    """The same by group, and for all (all_groups; a null group is a group)."""
    return papers.join(groups, "paper_id").rollup("grp").agg((F.grouping("grp") == 1).alias("all_groups"), *_totals())


def fp_taxonomy(rk: Column, component: tuple[str, ...] = COMPONENT_TOOL, substrate: tuple[str, ...] = SUBSTRATE) -> Column:
    """Why a wrong prediction is wrong; the tuples hold names, compared by their keys."""
    keys = lambda names: [canon(F.lit(n)) for n in names]
    return F.when(rk.isin(*keys(component)), "component_tool").when(rk.isin(*keys(substrate)), "substrate").otherwise("method_misjudged")
