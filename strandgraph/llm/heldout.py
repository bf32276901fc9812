"""Held-out figures of the learned scores: python -m strandgraph.llm.heldout FOLDER_OF_TABLES

Toxicity is scored as registered: its training never sees rows whose crc32(doc_id) mod 4 is 2. Quality
is trained here without these rows. Figures are over the labelled rows held back.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import quality, toxicity
from strandgraph.llm.common import table


def area(scores: np.ndarray, truth: np.ndarray) -> float:
    """The area under the ROC curve; ties count half."""
    _, place, counts = np.unique(scores, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[place]
    n = int(truth.sum())
    return float((ranks[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n)))


def report(name: str, scores: list[float], predicted: list[bool], truth: list[int]) -> str:
    s, p, y = np.array(scores), np.array(predicted, bool), np.array(truth)
    right = int((p & (y == 1)).sum())
    return f"{name}: {len(y)} rows, {int(y.sum())} of label 1, AUC {area(s, y):.3f}, precision {right / max(1, p.sum()):.3f}, recall {right / max(1, y.sum()):.3f}"


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    given = labels.where(held)
    rows = toxicity.scored(docs.join(given, "doc_id"), toxicity.train(docs, labels)).join(given, "doc_id").where("toxic is not null").collect()
    print(report("toxicity", [r.score for r in rows], [r.predicted for r in rows], [r.toxic for r in rows]))
    rows = quality.scored(docs.join(given, "doc_id"), quality.train(docs, labels.where(~held))).join(given, "doc_id").where("quality is not null").collect()
    print(report("quality", [r.tail_probability for r in rows], [r.kept for r in rows], [r.quality for r in rows]))


if __name__ == "__main__":
    main(sys.argv[1])
