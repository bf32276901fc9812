"""Document fingerprints as homomorphic multiset hashes.

A paragraph (a line, without its end) is hashed to a wide vector: four lanes of 64 bits, and 256
lanes of 32 bits that add up plus or minus one for each piece of the paragraph. A fingerprint is
the lane-wise sum over the multiset of paragraphs, modulo 2^64 and 2^32. So the order of paragraphs
doesn't matter, copies count, and a paragraph is inserted or deleted by adding or subtracting its
vector. The strong lanes hash whole paragraphs and decide equality. The narrow lanes sketch inner
products of the multisets of pieces, so that two fingerprints alone tell how alike their documents are.

Pieces are runs of words of a line, cut where a word's own bytes say so (about every fourth word), so
that an edit changes only the pieces that it touches.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.common import cut, table

STRONG, SIGNS = 4, 256
#: A piece ends after a word whose checksum has these bits zero.
CUT_MASK = 3
#: Rows of a partition of the text shuffle, on average at most.
PER_PART = 20_000


def paragraphs(text: str) -> list[bytes]:
    """The lines of a text, blank ones too: texts have one multiset if their lines are a permutation."""
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def pieces(paragraph: bytes) -> list[bytes]:
    """Runs of a paragraph's words, joined by blanks; none if it is blank."""
    words = paragraph.split()
    ends = [i for i, word in enumerate(words, 1) if not zlib.crc32(word) & CUT_MASK]
    if words and (not ends or ends[-1] < len(words)):
        ends.append(len(words))
    return [b" ".join(words[i:j]) for i, j in zip([0, *ends], ends)]


def _digests(items: list[bytes], size: int) -> np.ndarray:
    flat = b"".join([hashlib.blake2b(x, digest_size=size).digest() for x in items])
    return np.frombuffer(flat, np.uint8).reshape(len(items), size)


class Fingerprint:
    """The sum of paragraph vectors. Supports insertion, deletion, equality and likeness."""

    def __init__(self, strong: np.ndarray | None = None, signs: np.ndarray | None = None):
        self.strong = np.zeros(STRONG, np.uint64) if strong is None else strong
        self.signs = np.zeros(SIGNS, np.uint32) if signs is None else signs

    @staticmethod
    def of(lines: list[bytes]) -> Fingerprint:
        out = Fingerprint()
        for at in range(0, len(lines), 4096):
            part = lines[at : at + 4096]
            out.strong = out.strong + np.ascontiguousarray(_digests(part, 8 * STRONG)).view("<u8").sum(axis=0, dtype=np.uint64)
        small = [x for line in lines for x in pieces(line)]
        for at in range(0, len(small), 4096):
            part = small[at : at + 4096]
            ones = np.unpackbits(_digests(part, SIGNS // 8), axis=1).sum(axis=0, dtype=np.int64)
            out.signs = out.signs + (2 * ones - len(part)).astype(np.uint32)  # modulo 2^32
        return out

    @staticmethod
    def of_text(text: str | None) -> Fingerprint:
        return Fingerprint.of(paragraphs(text or ""))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong + other.strong, self.signs + other.signs)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong - other.strong, self.signs - other.signs)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and np.array_equal(self.strong, other.strong) and np.array_equal(self.signs, other.signs)

    def __str__(self) -> str:
        """The bytes of a narrow lane (1, 2 or 4, the least that hold all), then all lanes in base 64."""
        signed = self.signs.view(np.int32)
        high = int(np.abs(signed.astype(np.int64)).max())
        width = 1 if high < 128 else 2 if high < 32_768 else 4
        return f"{width}{base64.b64encode(self.strong.astype('<u8').tobytes() + signed.astype(f'<i{width}').tobytes()).decode()}"

    @staticmethod
    def parse(text: str) -> Fingerprint:
        raw = base64.b64decode(text[1:])
        signed = np.frombuffer(raw[8 * STRONG :], f"<i{text[0]}").astype(np.int32)
        return Fingerprint(np.frombuffer(raw[: 8 * STRONG], "<u8").astype(np.uint64), signed.view(np.uint32))

    def likeness(self, other: Fingerprint) -> float:
        """2 A.B / (A.A + B.B) of the multisets' counts of pieces, as the sketch tells it, within 0 and 1.

        1 if the fingerprints are equal, or neither document has a word. For pieces that occur once
        each it is the share that both have.
        """
        if self == other:
            return 1.0
        a, b = (x.signs.view(np.int32).astype(np.float64) for x in (self, other))
        norms = a @ a + b @ b
        return float(min(1.0, max(0.0, 2 * (a @ b) / norms))) if norms else 1.0


def fingerprint_column(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text (null: empty); a column named out_col is replaced."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: str(Fingerprint.of_text(t)))

    return docs.withColumn(out_col, run(F.col(text_col)))


def _with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows (part, place, id, h, text): parts are ranges of (id descending, h); the last row of a part
    is followed by a copy of the first of the next part (place 1), the last part's by that of the first.

    Only the first (id, h) of each part, one row for PER_PART rows of docs, passes the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    small = cut(rows.select("id", "h"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-small.count() // PER_PART))
    order = F.struct(F.col("id").isNull().alias("none"), F.bitwise_not("id").alias("back"), "h")
    dealt = small.repartitionByRange(parts, F.col("id").desc_nulls_last(), "h")
    firsts = dealt.groupBy(F.spark_partition_id()).agg(F.min(order).alias("x")).select("x.*").collect()
    heads = sorted((r["none"], 0 if r["none"] else r["back"], r["h"]) for r in firsts)
    before = {head: k - 1 if k else len(heads) - 1 for k, head in enumerate(heads)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(i is None, 0 if i is None else ~i, h) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            again = [(r, before[k]) for r, k in enumerate(keys) if k in before]
            for place, at, to in ((0, None, [bisect_right(heads, k) - 1 for k in keys]), (1, [r for r, _ in again], [p for _, p in again])):
                if to:
                    part = batch if at is None else batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([place] * len(to), pa.int32()), *part.columns], ["part", "place", "id", "h", "text"])

    return rows.mapInArrow(run, "part int, place int, id long, h long, text string"), max(1, len(heads))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text edited with the next document's.

    The next document is the one with the next lower id (after the last: the first). The edited
    text is the text with its last floor(n / 2) code points replaced by the first as many (or all)
    of the next document. Null texts are empty. Null ids come last; rows with one id are ordered by
    a hash of the text. A single row is its own next; repeated rows are each other's next and share
    a part. Other columns aren't read. An empty table gives an empty result. Each text is shuffled
    once, by ranges of (id, hash), and each part is one pass in order, with two texts in memory.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spread, parts = _with_next(docs, id_col, text_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def row(one: tuple, after: tuple) -> tuple:
        doc_id, text, mark = one
        half = len(text) // 2
        edit = text[: len(text) - half] + after[1][:half]
        new = Fingerprint.of_text(edit)
        return (doc_id, len(text), hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest(), str(mark), str(new), mark.likeness(new), mark.likeness(after[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_part, closed = None, None, None
        for batch in batches:
            out = []
            for part, place, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place and closed == part:
                    continue  # the next part's head is repeated there: one copy of it follows
                now = (doc_id, text or "", Fingerprint.of_text(text))
                if last is not None and part == last_part:
                    out.append(row(last, now))
                last, last_part, closed = (None, None, part) if place else (now, part, None)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = zip(*out) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    ordered = spread.repartitionById(parts, "part").sortWithinPartitions("part", "place", F.col("id").desc_nulls_last(), "h")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("part", "place", "id", "text").mapInArrow(run, schema)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))


QUERIES = {"op3_multiset": _query}
