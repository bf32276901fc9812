"""Toxicity by compression distance.

zstandard trains dictionaries from samples of text: one for toxic text, one for ordinary text, and a
common base from running ordinary text that both are laid over, so that ordinary words cost the same
with either. The samples of a class are the places of its training documents that tell it from the
other class (by contexts and log-likelihood ratio); of these the trainer takes the segments that
cover most. A window of text is compressed with both dictionaries, and the difference in length is
its gain. Counts of windows at each gain, weighed by a logistic fit on documents that the dictionaries
haven't seen, give the score; its threshold is fixed.

A window is a word with its neighbours (words are cut at 64 bytes), closed by a fixed tail, as the
compressor starts no match in the last bytes of its input. Only windows around a word that gains by
itself are compressed; the others have no gain. Words repeat, so each is tried once per worker.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.common import table

#: Labelled rows to train on, at most, and their length in characters (longer ones aren't drawn).
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_CHARS = 1200, 2400, 50_000
#: A word tells a class if it follows this many different words there, this many times as often as in
#: the other class, with this log-likelihood ratio. Contexts, not counts: copies don't add any.
#: From strict to lenient; the fit takes the setting whose dictionaries do best on unseen training rows.
SETTINGS = ((4, 6.0, 18.0), (3, 6.0, 10.0), (2, 4.0, 6.0))
#: Bytes of the base and of a class's dictionary, and the trainer's segment and match lengths.
BASE_BYTES, CLASS_BYTES, SEGMENT, MATCH = 65_536, 4_096, 48, 8
#: Words of a base sample.
BASE_WORDS = 8
LEVEL, WINDOW_BYTES = 9, 64
TAIL = b" 0123456789abcdef "
MAX_GAIN = 8
CUTOFF = 0.3
CACHE_WORDS = 400_000


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if any(len(w) > WINDOW_BYTES for w in words):
        words = [w[i : i + WINDOW_BYTES] for w in words for i in range(0, len(w), WINDOW_BYTES)]
    return words


def _contexts(texts: Iterable[str]) -> dict[bytes, int]:
    """How many different words each word follows."""
    found: dict[bytes, set[int]] = defaultdict(set)
    for text in texts:
        before = 0
        for word in tokens(text):
            found[word].add(before)
            before = zlib.crc32(word)
    return {w: len(s) for w, s in found.items()}


def telling(own: dict[bytes, int], other: dict[bytes, int], setting: tuple[int, float, float]) -> set[bytes]:
    """The words whose contexts tell the one class from the other."""
    least, odds, ratio = setting
    na, nb = sum(own.values()) or 1, sum(other.values()) or 1
    out = set()
    for word, x in own.items():
        y = other.get(word, 0)
        if x >= least and ((x + 0.5) / na) / ((y + 0.5) / nb) >= odds:
            ex, ey = (x + y) * na / (na + nb), (x + y) * nb / (na + nb)
            if 2 * (x * math.log(x / ex) + (y * math.log(y / ey) if y else 0)) >= ratio:
                out.add(word)
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """What the trainer puts together from samples. It refuses too few of them (a small table has some tens
    of toxic rows); their own bytes, the last ones, are the dictionary then, which zstandard takes as well."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Trainer:
    """Dictionaries from toxic and ordinary texts, for any setting."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.texts = toxic, ordinary
        self.contexts = _contexts(toxic), _contexts(ordinary)
        runs = [b" " + b" ".join(w[i : i + BASE_WORDS]) + b" " for w in map(tokens, ordinary) for i in range(0, len(w), BASE_WORDS)]
        self.base = _trained(runs, BASE_BYTES)

    def __call__(self, setting: tuple[int, float, float]) -> tuple[bytes, bytes]:
        """The toxic and the ordinary dictionary's content."""
        out = []
        for own, other, texts in ((*self.contexts, self.texts[0]), (*self.contexts[::-1], self.texts[1])):
            words = telling(own, other, setting)
            places = [b" " + w + b" " for t in texts for w in tokens(t) if w in words]
            out.append(_trained(places, CLASS_BYTES) + self.base + TAIL)
        return out[0], out[1]


class Gains:
    """Length gains of words, remembered, and of windows."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        import zstandard

        self.sizes = []
        for content in dictionaries:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.sizes.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.known: dict[bytes, int] = {}

    def gain(self, window: bytes) -> int:
        toxic, ordinary = self.sizes
        closed = b" " + window + TAIL
        return len(ordinary.compress(closed)) - len(toxic.compress(closed))

    def features(self, text: str | None) -> np.ndarray:
        """Logs of the window counts at gains 1 to MAX_GAIN, in all and for 200 windows, and of their
        number; and the mean gain of a word by itself, losses too."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        words, known = tokens(text), self.known
        distinct = {*words}
        for word in distinct:
            if word not in known:
                known[word] = max(-MAX_GAIN, min(MAX_GAIN, self.gain(word)))
        at = np.zeros(MAX_GAIN + 1, np.int64)
        hot = {w for w in distinct if known[w] > 0}
        if hot:
            for k, word in enumerate(words):
                if word in hot:
                    at[min(MAX_GAIN, max(0, self.gain(b" ".join(words[max(0, k - 1) : k + 2]))))] += 1
        at = at[1:]
        mean = sum(map(known.__getitem__, words)) / max(1, len(words))
        return np.concatenate((np.log1p(at), np.log1p(200 * at / max(1, len(words))), [math.log1p(len(words)), mean]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the last one constant) of a ridge logistic fit."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    return mean, scale, w


class Model:
    """Dictionaries and calibration. Without labels of both kinds every score is 0."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        folds = [[r for r in rows if zlib.crc32(str(r[0]).encode()) & 4 == k] for k in (0, 4)]
        self.dictionaries = self.fit = self.setting = None
        if all({r[2] for r in fold} == {0, 1} for fold in folds):
            ys = np.array([label for fold in folds[::-1] for _, _, label in fold], np.float64)
            trainers, best = [self._trainer(fold) for fold in folds], -np.inf
            for setting in SETTINGS:
                xs = []
                for trainer, unseen in zip(trainers, folds[::-1]):
                    gains = Gains(trainer(setting))
                    xs += [gains.features(text) for _, text, _ in unseen]
                likely, fit = self._judged(np.array(xs), ys, len(folds[1]))
                if likely > best:
                    best, self.fit, self.setting = likely, fit, setting
            self.dictionaries = self._trainer(rows)(self.setting)

    @staticmethod
    def _judged(xs: np.ndarray, ys: np.ndarray, n: int) -> tuple[float, tuple]:
        """The log-likelihood of either fold's rows under the other's calibration, and one of all rows."""
        likely = 0.0
        for fit_on, judged in ((slice(0, n), slice(n, None)), (slice(n, None), slice(0, n))):
            mean, scale, w = _logistic(xs[fit_on], ys[fit_on])
            z = ((xs[judged] - mean) / scale) @ w[:-1] + w[-1]
            likely += float(np.sum(ys[judged] * z - np.logaddexp(0, z)))
        return likely, _logistic(xs, ys)

    @staticmethod
    def _trainer(rows: list[tuple[int, str, int]]) -> Trainer:
        return Trainer([t for _, t, y in rows if y], [t for _, t, y in rows if not y])

    def score(self, gains: Gains | None, text: str | None) -> float:
        if gains is None:
            return 0.0
        mean, scale, w = self.fit
        z = ((gains.features(text) - mean) / scale) @ w[:-1] + w[-1]
        return float(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample: at most TRAIN_TOXIC and TRAIN_ORDINARY labelled rows.

    Only labels whose crc32(doc_id as text) mod 4 isn't 2 are used; null labels and ids aren't. Of
    several labels of a document the highest holds; of several texts of an id each is a row.
    """
    given = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = F.xxhash64("doc_id")
    drawn = given.where("toxic = 1").orderBy(by_hash, "doc_id").limit(TRAIN_TOXIC).unionByName(given.where("toxic = 0").orderBy(by_hash, "doc_id").limit(TRAIN_ORDINARY))
    texts = docs.where(F.length("text") <= TRAIN_CHARS).select("doc_id", "text")
    rows = texts.join(F.broadcast(drawn), "doc_id").orderBy(by_hash, "doc_id", "text").limit(TRAIN_TOXIC + TRAIN_ORDINARY).collect()
    return Model([(r["doc_id"], r["text"], r["toxic"]) for r in rows])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, by the whole text alone.

    Null texts are empty; a text of any length is one pass over its words. Equal texts have equal
    scores, and repeated rows stay. A null doc_id isn't held out. Other columns aren't read. An empty
    table gives an empty result.
    """


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(model.dictionaries) if model.dictionaries else None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]
            scores = [model.score(gains, t.as_py()) for t in batch.column(1)]
            out = [batch.column(0), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= CUTOFF) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_toxicity": _query}
