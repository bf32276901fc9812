"""Quality by ordinal cumulative-link regression on graded ratings.

A document's grade is 0 (poor), 1 (good but toxic) or 2 (good). The model is proportional odds:
P(grade <= k) = sigmoid(threshold_k - w.x), with one weight vector over hashed text features for
all grades and ordered thresholds. It gives the expected grade and the tail probability
P(grade >= 1), by which documents are selected.

Features are two hashed bags: words, and word shapes (runs of capitals, small letters, digits and
each mark, and whether the word repeats the one before). Each bag enters as the square roots of its
relative frequencies, so that length doesn't matter. Words are what Python's split() gives: white
space of any script separates them, as marks of style and not bytes are looked at here.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.common import fresh, table

GRADES = 3
#: Hashed weights for words and for shapes.
WORDS, SHAPES = 1 << 17, 1 << 12
#: Labelled rows of a grade to train on, at most, and their length (longer ones aren't drawn).
TRAIN_ROWS, TRAIN_CHARS = 1200, 50_000
RIDGE, STEPS = 2e-4, 300
#: Documents stay if P(grade >= 1) reaches this.
KEEP = 0.35
CACHE_WORDS = 100_000


def _shape(word: str) -> str:
    word = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", word)
    return re.sub(r"(.)\1+", r"\1\1", re.sub(r"\d", "0", word))


class Features:
    """Hashed features of texts; words are remembered per worker."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values."""
        words = (text or "").split()
        if not words:
            return np.array([WORDS + SHAPES - 1]), np.ones(1)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for word in [w for w in {*words} if w not in known]:
            shape = zlib.crc32(_shape(word).encode("utf-8", "surrogatepass")) % (SHAPES // 2 - 1)
            known[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS * SHAPES + shape
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        again = np.zeros(len(both), np.int64)
        again[1:] = both[1:] == both[:-1]
        out_i, out_v = [], []
        for index in (both // SHAPES, WORDS + both % SHAPES + again * (SHAPES // 2)):
            i, n = np.unique(index, return_counts=True)
            out_i.append(i)
            out_v.append(np.sqrt(n / len(words)))
        return np.concatenate(out_i), np.concatenate(out_v)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first one, and logs of the steps to the next."""
    return np.concatenate(([free[0]], free[0] + np.cumsum(np.exp(free[1:]))))


class Sample:
    """Training rows as sparse features, with the loss of weights and thresholds on them.

    The loss is the weighted mean of -log P(grade), plus RIDGE / 2 times the squared weights.
    """

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]], grades: list[int], weights: list[float]):
        self.at, self.value = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        self.row = np.repeat(np.arange(len(pairs)), [len(p[0]) for p in pairs])
        self.y, self.share = np.array(grades), np.array(weights) / np.sum(weights)

    def __call__(self, w: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The loss and its gradients."""
        y, share, cuts = self.y, self.share, thresholds(free)
        z = np.bincount(self.row, w[self.at] * self.value, len(y))
        # the lowest grade has no lower and the highest no upper threshold
        upper = np.where(y < GRADES - 1, _sigmoid(np.append(cuts, 0)[np.minimum(y, GRADES - 2)] - z), 1.0)
        lower = np.where(y > 0, _sigmoid(cuts[np.maximum(y - 1, 0)] - z), 0.0)
        mass = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        dz = share * (du - dl) / mass
        gw = np.bincount(self.at, self.value * dz[self.row], len(w)) + RIDGE * w
        gcuts = np.zeros(GRADES - 1)
        np.add.at(gcuts, np.minimum(y, GRADES - 2), np.where(y < GRADES - 1, -share * du / mass, 0))
        np.add.at(gcuts, np.maximum(y - 1, 0), np.where(y > 0, share * dl / mass, 0))
        gfree = np.concatenate(([gcuts.sum()], [gcuts[k:].sum() * np.exp(free[k]) for k in range(1, GRADES - 1)]))
        return float(-share @ np.log(mass) + RIDGE / 2 * (w @ w)), gw, gfree


class Model:
    """Weights and thresholds. Without labels of two grades every document has the top grade."""

    def __init__(self, texts: list[str], grades: list[int], weights: list[float]):
        self.w = self.cuts = None
        if len(set(grades)) < 2:
            return
        features = Features()
        sample = Sample([features(t) for t in texts], grades, weights)
        w, free = np.zeros(WORDS + SHAPES), np.array([-1.0, *[0.0] * (GRADES - 2)])
        sums = [np.zeros_like(w), np.zeros_like(free)]
        for step in range(STEPS):  # Adagrad
            _, gw, gfree = sample(w, free)
            rate = 1.0 / (1 + step / 100)
            for x, g, s, size in ((w, gw, sums[0], 1.0), (free, gfree, sums[1], 0.3)):
                s += g * g
                x -= rate * size * g / np.sqrt(s + 1e-12)
        self.w, self.cuts = w.astype(np.float32), thresholds(free)

    def __call__(self, features: Features, text: str | None) -> tuple[float, float]:
        """The expected grade and P(grade >= 1)."""
        if self.w is None:
            return float(GRADES - 1), 1.0
        at, value = features(text)
        tails = 1 - _sigmoid(self.cuts - float(self.w[at] @ value))
        return float(tails.sum()), float(tails[0])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample: at most TRAIN_ROWS labelled rows of each grade, reweighted.

    A grade is quality + (quality and not toxic); rows with a null label or id aren't used. Of
    several labels of a document the least grade holds.
    """
    rated = labels.where("quality in (0, 1) and toxic in (0, 1) and doc_id is not null")
    grade = F.col("quality") + F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    given = rated.groupBy("doc_id").agg(F.min(grade).alias("grade"))
    counts = {r["grade"]: r["count"] for r in given.groupBy("grade").count().collect()}
    by_hash = F.xxhash64("doc_id")
    drawn = None
    for k in range(GRADES):
        part = given.where(F.col("grade") == k).orderBy(by_hash, "doc_id").limit(TRAIN_ROWS)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.where(F.length("text") <= TRAIN_CHARS).select("doc_id", "text")
    rows = texts.join(F.broadcast(drawn), "doc_id").orderBy(by_hash, "doc_id", "text").limit(GRADES * TRAIN_ROWS).collect()
    found = np.bincount([r["grade"] for r in rows], minlength=GRADES)
    return Model([r["text"] for r in rows], [r["grade"] for r in rows], [counts[r["grade"]] / found[r["grade"]] for r in rows])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) for every row of docs, by the whole text.

    Null and empty texts share one feature of their own; a text of any length is one pass over its
    words. Equal texts have equal scores, repeated rows and null ids stay. Other columns aren't
    read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [model(features, t.as_py()) for t in batch.column(1)]
            grade, tail = pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.float64())
            kept = pa.array([x >= KEEP for _, x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), grade, tail, kept], ["doc_id", "expected_grade", "tail_probability", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose tail probability reaches KEEP; columns unchanged, texts not shuffled."""
    model, name = train(docs, labels), fresh(docs, "tail")

    @F.pandas_udf("double")
    def tail(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features()
        for texts in parts:
            yield pd.Series([model(features, t)[1] for t in texts], dtype="float64")

    return docs.withColumn(name, tail("text")).where(F.col(name) >= KEEP).drop(name)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_quality": _query}
