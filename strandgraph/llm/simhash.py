"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint has 64 bits. Two fingerprints that differ in at most 3 bits agree exactly in at
least one of four 16-bit segments, and of the other 48 bits one half differs in at most one bit.
The perfect binary Golay code (23, 12, 7) gives every 23-bit word one nearest codeword, at most 3
bits away. A word and its neighbours at distance one decode to at most six codewords, so a half
carries several keys: an index row stores its own codeword, a probe row asks for all codewords
that its one-bit neighbours decode to. A join on (segment, half, exact bits, codeword) therefore
meets every pair within 3 bits, and the exact distance is checked in the join itself.

Equal fingerprints are one row of the join, so copies never meet each other in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.common import column, components, cut, fresh, table

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 4
#: Generator polynomial of the perfect binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1 (fixed value).
GOLAY = 0b101011100011


def text_fingerprint(text: str | None) -> int:
    """SimHash of a text, unsigned. A null or blank text has fingerprint zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -SHINGLE])).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[i:j], SEED) for i, j in zip(starts, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):  # bounded memory for very long texts
        part = np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of docs; fp is the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((text_fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


@lru_cache(1)
def _nearest() -> np.ndarray:
    """The index (0..4095) of the codeword nearest to each 23-bit word."""
    code = np.zeros(1, np.int64)
    for k in range(12):
        code = np.concatenate((code, code ^ (GOLAY << k)))
    bits = [1 << k for k in range(23)]
    errors = [0, *bits]
    errors += [x | y for i, x in enumerate(bits) for y in bits[:i]]
    errors += [x | y | z for i, x in enumerate(bits) for j, y in enumerate(bits[:i]) for z in bits[:j]]
    out = np.zeros(1 << 23, np.int16)
    index = np.arange(4096, dtype=np.int16)
    for e in errors:
        out[code ^ e] = index
    return out


def _parts(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each segment and half: the key's exact part, and the 23-bit word to decode."""
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(16 * s)) & np.uint64(0xFFFF)).astype(np.int64) for s in range(SEGMENTS)]
    for s in range(SEGMENTS):
        x, y, z = (seg[i] for i in range(SEGMENTS) if i != s)
        rest = x | (y << 16) | (z << 32)
        for half in range(2):
            yield ((s * 2 + half) << 28) | (seg[s] << 12), (rest >> (24 * half)) & 0x7FFFFF


def _index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fp = batch["fp"].to_numpy(np.int64)
        keys = [exact | _nearest()[word] for exact, word in _parts(fp)]
        yield pd.DataFrame({"key": np.concatenate(keys), "fp": np.tile(fp, len(keys))})


def _probe_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    flips = np.array([0, *(1 << k for k in range(23))], np.int64)
    for batch in batches:
        for at in range(0, len(batch), 2000):
            fp = batch["fp"].to_numpy(np.int64)[at : at + 2000]
            for exact, word in _parts(fp):
                near = np.sort(_nearest()[word[:, None] ^ flips], axis=1).astype(np.int64)
                new = np.ones(near.shape, bool)
                new[:, 1:] = near[:, 1:] != near[:, :-1]
                yield pd.DataFrame({"key": (exact[:, None] | near)[new], "fp": np.broadcast_to(fp[:, None], near.shape)[new]})


def links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of different fingerprints that differ in at most MAX_BITS bits.

    classes has one row per fingerprint (fp). A pair can appear more than once.
    """
    spark = classes.sparkSession
    classes = classes.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "fp")  # a row becomes some fifty
    index = classes.select("fp").mapInPandas(_index_rows, "key long, fp long").withColumnRenamed("fp", "b")
    probe = classes.select("fp").mapInPandas(_probe_rows, "key long, fp long").withColumnRenamed("fp", "a")
    near = (F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return probe.join(index, (probe["key"] == index["key"]) & near).select("a", "b")


def _rooted(prints: DataFrame) -> DataFrame:
    """(fp, root): the class of each fingerprint, named by its least fingerprint."""
    classes = cut(prints.select("fp").distinct())
    roots = components(links(classes)).withColumnsRenamed({"node": "fp", "component": "root"})
    return cut(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the least id among all documents reachable by links. Null texts count as
    empty, and all empty texts share fingerprint zero, which links like any other. A null id is
    kept and ignored in minima (its component is null if nothing else is in it). Repeated rows
    stay repeated. Other columns of docs are not read, so their names cannot clash. An empty
    table gives an empty result.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    rooted = _rooted(prints)
    least = prints.groupBy("fp").agg(F.min("id").alias("least")).join(rooted, "fp")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(member, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: one row of each group stays, columns unchanged.

    The row with the least (doc_id, hash of the text) stays, a null doc_id after all others; of
    rows equal in both one stays. Only these keys are shuffled against each other, and the texts
    once, to their keys.
    """
    null, key, hashed = (fresh(docs, x) for x in ("null", "key", "hash"))
    keyed = docs.withColumns({null: F.col("doc_id").isNull(), key: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), hashed: F.xxhash64(F.coalesce("text", F.lit("")))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((text_fingerprint(t.as_py()) for t in batch.column(3)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps.view(np.int64))], ["null", "key", "hash", "fp"])

    prints = cut(keyed.select(null, key, hashed, "text").mapInArrow(run, "null boolean, key long, hash long, fp long"))
    first = prints.join(_rooted(prints), "fp").groupBy("root").agg(F.min(F.struct("null", "key", "hash")).alias("x"))
    kept = first.select(F.col("x.null").alias(null), F.col("x.key").alias(key), F.col("x.hash").alias(hashed))
    return keyed.join(kept, [null, key, hashed], "left_semi").dropDuplicates([null, key, hashed]).select(*map(column, docs.columns))


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": _query}
