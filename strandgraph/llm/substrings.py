"""Exact substring de-duplication with fixed-block anchors.

A window of 35 words contains exactly one of its document's non-overlapping blocks of 18 words
(35 = 2 * 18 - 1). If the window occurs anywhere else, that block does too, at any offset. So the
blocks of all documents are the index, and every rolling run of 18 words of every document probes
it. A block that occurs twice is an anchor. From there hits are extended: the windows around an
anchor, up to 17 words to each side, are the candidates, and those that occur twice make up the
maximal exact repeats. Words under them go.

Documents are dealt to buckets of bounded length, once, by a shuffle that all three steps read.
A bucket sends each hash once, however often it occurs there, with a mark if it occurs more than
once, to the hash's range; the range sends back to the bucket which of its hashes repeat. So a hot
passage costs one hash a bucket and not one row per occurrence or pair, and nothing is kept per owner.

Blocks are told apart by their range and 32 bits within it; a chance hit only adds candidates.
Windows are told apart by 128 bits made of two independent hashes of 64 bits: among 10^13 windows
the chance of any false repeat is about 10^-13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandgraph.llm.common import cut, table

WINDOW = 35
BLOCK = (WINDOW + 1) // 2
#: Words of a range of hashes, and of a bucket of documents, on average at most.
PER_RANGE, PER_BUCKET = 6_000_000, 2_000_000
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd, so that powers have inverses modulo 2^64
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):  # MurmurHash3's finalizer
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(digest, words), np.uint64, len(words))


def rolling(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of every run of width words, by prefix sums of a polynomial, mixed. There are two."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    if which:
        words = _mixed(words ^ np.uint64(_BASES[1]))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(_BASES[which], n), out=sums[1:])
    return _mixed((sums[width:] - sums[:-width]) * _powers(_INVERSES[which], n - width + 1))


def _placed(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a hash in the upper 32 bits, its place within the range in the lower; keeps order."""
    n, half = np.uint64(ranges), np.uint64(32)
    return (h >> half) * n + (((h & np.uint64(0xFFFFFFFF)) * n) >> half)


def _cuts(placed: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted places lie in, and where each begins (and the end)."""
    part = (placed >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    return part[first], np.append(first, len(part))


def _pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as byte planes of the lower half and of the upper half's steps: these compress."""
    v = values.astype(np.uint32)
    steps = np.diff(v >> np.uint32(16), prepend=np.uint32(0)).astype(np.uint16)
    return (v & np.uint32(0xFFFF)).astype("<u2").tobytes() + (steps & 255).astype(np.uint8).tobytes() + (steps >> 8).astype(np.uint8).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // 4
    low = np.frombuffer(raw, "<u2", n).astype(np.uint32)
    steps = np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.uint32) | np.frombuffer(raw, np.uint8, n, 3 * n).astype(np.uint32) << np.uint32(8)
    return np.cumsum(steps, dtype=np.uint32) << np.uint32(16) | low


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _rows(columns: list[list], schema: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema)], [n for n, _ in schema])


# --- first step: blocks that occur twice

ASKED = [("range", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary()), ("twice", pa.binary()), ("owned", pa.binary())]
ASKED_SQL = "range int, bucket int, found binary, twice binary, owned binary"


def _probed(ranges: int):
    """Per bucket: the distinct hashes of all rolling runs, one row a range, with marks for those that
    occur twice in the bucket and for those that are blocks."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, blocks = [], []
        for batch in batches:
            for text in batch.column("text"):
                words = word_hashes(text.as_py())
                if len(words) >= WINDOW:
                    h = rolling(words, BLOCK)
                    probes.append(h)
                    blocks.append(h[::BLOCK])
        if not probes:
            return
        values, counts = np.unique(np.concatenate(probes), return_counts=True)
        owned = np.zeros(len(values), bool)
        owned[np.searchsorted(values, np.concatenate(blocks))] = True
        placed = _placed(values, ranges)
        parts, edges = _cuts(placed, ranges)
        columns: list[list] = [[] for _ in ASKED]
        for r, a, b in zip(parts.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
            for c, x in zip(columns, (r, key[0].as_py(), _pack(placed[a:b] & np.uint64(0xFFFFFFFF)), _bits(counts[a:b] > 1), _bits(owned[a:b]))):
                c.append(x)
        yield _rows(columns, ASKED)

    return run


def _anchored(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: to each bucket those of its blocks that occur twice anywhere, as places."""
    asked, seen, twice = [], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for batch in batches:
        for bucket, found, more, owned in zip(*(batch.column(c).to_pylist() for c in ("bucket", "found", "twice", "owned"))):
            values = _unpack(found)
            seen.append(values)
            twice.append(values[_flags(more, len(values))])
            own = values[_flags(owned, len(values))]
            if len(own):
                asked.append((bucket, own))
    both = np.sort(np.concatenate(seen))
    hits = np.union1d(both[1:][both[1:] == both[:-1]], np.concatenate(twice))
    above = np.uint64(key[0].as_py()) << np.uint64(32)
    answers = [(bucket, own[_in(own, hits)].astype(np.uint64) | above) for bucket, own in asked]
    answers = [(bucket, x.tobytes()) for bucket, x in answers if len(x)]
    for at in range(0, len(answers), 10_000):
        part = answers[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int32()), pa.array([x for _, x in part], pa.binary())], ["bucket", "anchors"])


# --- second step: windows around anchors that occur twice

SPREAD = [("range", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary()), ("twice", pa.binary()), ("keys", pa.binary())]
SPREAD_SQL = "range int, bucket int, found binary, twice binary, keys binary"


def _extended(ranges: int):
    """Per bucket: the distinct windows around its anchors, one row a range, and the documents that have any."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in SPREAD]
        anchors = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), "<u8") for x in answers.column("anchors"))]))
        keys, one, two = [], [], []
        if len(anchors):
            for key, text in zip(texts.column("key").to_pylist(), texts.column("text")):
                words = word_hashes(text.as_py())
                n = len(words) - WINDOW + 1
                if n < 1:
                    continue
                hit = _in(_placed(rolling(words, BLOCK)[::BLOCK], ranges), anchors)
                if hit.any():
                    around = np.append(hit, False)[-(-np.arange(n) // BLOCK)]  # by the block that begins at or after the start
                    keys.append(key)
                    one.append(rolling(words, WINDOW)[around])
                    two.append(rolling(words, WINDOW, 1)[around])
        if keys:
            a, b = np.concatenate(one), np.concatenate(two)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
            more = np.diff(first, append=len(a)) > 1
            a, b = a[first], b[first]
            bucket = texts.column("bucket")[0].as_py()
            parts, edges = _cuts(_placed(a, ranges), ranges)
            for r, i, j in zip(parts.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
                for c, x in zip(columns, (r, bucket, a[i:j].tobytes() + b[i:j].tobytes(), _bits(more[i:j]), None)):
                    c.append(x)
            for c, x in zip(columns, (bucket % ranges, bucket, None, None, np.array(keys, "<i8").tobytes())):
                c.append(x)
        return pa.Table.from_batches([_rows(columns, SPREAD)])

    return run


def _pairs(raw: bytes) -> np.ndarray:
    """Windows as rows of two numbers."""
    return np.frombuffer(raw, "<u8").reshape(2, -1)


def _repeated(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: to each bucket those of its windows that occur twice anywhere; keys pass through."""
    asked, more, out = [], [], []
    for batch in batches:
        for bucket, found, twice, keys in zip(*(batch.column(c).to_pylist() for c in ("bucket", "found", "twice", "keys"))):
            if keys is not None:
                out.append((bucket, None, keys))
                continue
            windows = _pairs(found)
            asked.append((bucket, windows))
            more.append(_flags(twice, windows.shape[1]))
    if asked:
        a, b = (np.concatenate([w[i] for _, w in asked]) for i in (0, 1))
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        hit = np.concatenate(more)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        at = 0
        for bucket, windows in asked:
            mine = hit[at : at + windows.shape[1]]
            at += windows.shape[1]
            if mine.any():
                out.append((bucket, windows[:, mine].tobytes(), None))
        # a window that one bucket has twice and another once repeats in both: `same` has marked both
    for at in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 10_000]), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "windows", "keys"])


# --- third step: words under them go


def removed_words(n: int, places: np.ndarray) -> np.ndarray:
    """Which of n words are covered by a window that starts at one of places."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, np.minimum(places + WINDOW, n), -1)
    return np.cumsum(steps[:-1]) > 0


def _starts(words: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The starts of the windows that are among the sorted pairs (one, two)."""
    a, b = rolling(words, WINDOW), rolling(words, WINDOW, 1)
    at = np.searchsorted(one, a)
    found = np.zeros(len(a), bool)
    while True:  # pairs with one first number stand together; there is hardly ever more than one
        inside = np.flatnonzero(at < len(one))
        inside = inside[one[at[inside]] == a[inside]]
        if not len(inside):
            return np.flatnonzero(found)
        found[inside] |= two[at[inside]] == b[inside]
        at[inside] += 1


def _kept(texts: pa.Table, answers: pa.Table) -> pa.Table:
    windows = [_pairs(x.as_py()) for x in answers.column("windows") if x.is_valid]
    one, two = (np.concatenate([np.zeros(0, np.uint64), *(w[i] for w in windows)]) for i in (0, 1))
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    candidates = {k for x in answers.column("keys") if x.is_valid for k in np.frombuffer(x.as_py(), "<i8").tolist()} if len(one) else set()
    n_words, n_removed, kept = [], [], []
    for key, text in zip(texts.column("key").to_pylist(), texts.column("text")):
        words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
        left = words
        if key in candidates:
            at = _starts(word_hashes(text.as_py()), one, two)
            if len(at):
                left = [w for w, gone in zip(words, removed_words(len(words), at).tolist()) if not gone]
        n_words.append(len(words))
        n_removed.append(len(words) - len(left))
        kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
    return pa.table([texts.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row of docs with its words that don't repeat.

    Words are runs without ASCII white space; kept joins them by one blank. A null or empty text
    has no words; a text of any length is one row of its bucket. Where a doc_id is null or repeated,
    rows are told apart by a key of their own, so that a repeated row repeats its windows. There are
    no ties to break: a window's fate doesn't depend on order. Other columns aren't read. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    n, ids, chars = docs.agg(F.count("*"), F.countDistinct("doc_id"), F.sum(F.length("text"))).first()
    keyed = docs.select("doc_id", "text")
    if n == ids and isinstance(docs.schema["doc_id"].dataType, LongType):
        keyed = keyed.withColumn("key", F.col("doc_id"))
    else:
        keyed = cut(keyed.withColumn("key", F.monotonically_increasing_id()))
    n_words, least = (chars or 0) // 6, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges, buckets = (max(least, -(-n_words // per)) for per in (PER_RANGE, PER_BUCKET))
    dealt = keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).groupBy("bucket")

    asked = dealt.applyInArrow(_probed(ranges), ASKED_SQL)
    anchors = asked.groupBy("range").applyInArrow(_anchored, "bucket int, anchors binary")
    spread = dealt.cogroup(anchors.groupBy("bucket")).applyInArrow(_extended(ranges), SPREAD_SQL)
    windows = spread.groupBy("range").applyInArrow(_repeated, "bucket int, windows binary, keys binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.cogroup(windows.groupBy("bucket")).applyInArrow(_kept, f"doc_id {kind}, n_words long, n_removed long, kept string")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_substrings": _query}
