"""Packing documents into fixed windows by minimum bin slack.

A document is its token ids and an end id. Full windows are cut off its front; the rest, shorter
than a window, is packed. Only the histogram of rest lengths (at most 1023 rows, however large
the corpus) reaches the driver. There each step takes the longest length left and finds, with a
bitset subset-sum over the other lengths and their counts, the multiset that comes closest to the
window; the pattern is used as often as the counts allow. Where no multiset comes within TOLERANCE
of the window, the gap is filled with the front of another piece, whose rest stays in the
histogram. Executors number the pieces of each length (salted, so that a hot length is spread)
and read their sequence and offset from the plan's intervals.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.llm.common import cut, table
from strandgraph.llm.tokens import Tokens

WINDOW = 1024
END_ID = 0
#: Tokens of padding in a window that aren't worth a cut.
TOLERANCE = 4
#: Pieces of one length that are numbered together, on average at most.
PER_SALT = 50_000


def _best(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths in counts, the multiset whose sum is the largest up to room.

    Bit s of the set is on if sum s can be reached. Lengths go from long to short, copies in powers
    of two; walking back through the sets gives the copies of each length.
    """
    mask, reach, seen = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        seen.append((length, reach))
        left = min(counts[length], room // length)
        step = 1
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & mask
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, before in reversed(seen):
        copies = 0
        while not before >> at & 1:
            at -= length
            copies += 1
        if copies:
            out[length] = copies
    return out


def plan_windows(histogram: dict[int, int], window: int = WINDOW, tolerance: int = TOLERANCE) -> dict[int, list[tuple]]:
    """For each length its intervals of ranks: (first, copies, sequence, offset, cut, next_rank).

    A piece of rank r in [first, next first) goes to sequence + (r - first) // copies, at offset +
    (r - first) % copies * length. With cut > 0 only its first cut tokens go there, and the rest is
    the piece of rank next_rank + (r - first) of length - cut.
    """
    left = {k: n for k, n in histogram.items() if n and 0 < k <= window}
    taken: dict[int, int] = defaultdict(int)  # ranks given out so far
    made = dict(left)  # ranks that exist so far
    plan: dict[int, list[tuple]] = defaultdict(list)
    sequence = 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = _best({k: n for k, n in rest.items() if n}, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        gap = window - sum(k * c for k, c in pattern.items())
        spare = {k: left[k] - pattern.get(k, 0) for k in left}
        donor = max((k for k, n in spare.items() if n > 0 and k > gap), default=0) if gap > tolerance else 0
        times = min(left[k] // c for k, c in pattern.items())
        if donor:
            times = max(1, min([times, *(left[k] // (pattern.get(k, 0) + 1) for k in [donor])]))
        offset = 0
        for k, c in sorted(pattern.items(), reverse=True):
            plan[k].append((taken[k], c, sequence, offset, 0, 0))
            taken[k] += c * times
            left[k] -= c * times
            offset += k * c
        if donor:
            plan[donor].append((taken[donor], 1, sequence, offset, gap, made.get(donor - gap, 0)))
            taken[donor] += times
            left[donor] -= times
            made[donor - gap] = made.get(donor - gap, 0) + times
            left[donor - gap] = left.get(donor - gap, 0) + times
        sequence += times
        left = {k: n for k, n in left.items() if n}
    return dict(plan)


def pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """(doc_id, doc_tokens, start, length, crc, ids): full windows, and the rest with its ids.

    crc is the CRC-32 of the ids as little-endian unsigned 32-bit words. ids (16 bits each) are
    kept only for a rest, which may be cut again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        for batch in batches:
            rows: list[tuple] = []
            for at in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                for doc_id, flat in zip(batch.column(0).slice(at, 256).to_pylist(), tokens.encode(texts)):
                    ids = np.append(np.frombuffer(flat, np.uint16), np.uint16(END_ID))
                    wide = memoryview(ids.astype("<u4").tobytes())
                    n = len(ids)
                    for start in range(0, n, window):
                        stop = min(n, start + window)
                        rest = ids[start:stop].astype("<u2").tobytes() if stop - start < window else None
                        rows.append((doc_id, n, start, stop - start, zlib.crc32(wide[4 * start : 4 * stop]), rest))
            names = ["doc_id", "doc_tokens", "start", "length", "crc", "ids"]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, doc_tokens long, start long, length long, crc long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _placed(plan: dict[int, list[tuple]]):
    starts = {k: [x[0] for x in v] for k, v in plan.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, doc_tokens, start, length, crc, ids, rank in zip(*(c.to_pylist() for c in batch.columns)):
                done = False
                while not done:
                    first, copies, sequence, offset, part, onward = plan[length][bisect_right(starts[length], rank) - 1]
                    at = rank - first
                    done = not part
                    size = part or length
                    if part or crc is None:
                        crc = zlib.crc32(np.frombuffer(ids, "<u2")[:size].astype("<u4").tobytes())
                    out.append((doc_id, start, size, crc, doc_tokens, sequence + at // copies, offset + at % copies * length))
                    start, length, rank, crc = start + size, length - size, onward + at, None
                    ids = ids[2 * size :] if ids is not None else None
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 6]
            columns = zip(*out) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed once each; a null doc_id is
    kept. Other columns aren't read. An empty table gives an empty result. Ranks follow
    (length, salt, doc_id, start, crc), so a rerun over the same rows gives the same packing up to
    the order of equal rows.
    """
    found = cut(pieces(docs, window, path))
    lengths = found.groupBy("length").count().collect()  # at most one row per length
    plan = plan_windows({r["length"]: r["count"] for r in lengths}, window)
    total = sum(r["count"] for r in lengths)
    salts = max(16, -(-total // PER_SALT))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "crc"), F.lit(salts)).cast("int"))
    offsets = salted.groupBy("length", "salt").count().withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "crc")) - 1
    ranked = salted.withColumn("own", own).join(offsets.select("length", "salt", "base"), ["length", "salt"])
    ranked = ranked.select("doc_id", "doc_tokens", "start", "length", "crc", "ids", (F.col("own") + F.col("base")).alias("rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(plan), schema)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": _query}
