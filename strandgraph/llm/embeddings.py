"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits the vectors by a random projection near its median, again and again, where it parts
the fewest pairs known to be linked; vectors within a margin of the cut go to both sides (spill). The trees are fitted on a sample bounded in rows and
bytes and route every vector. Where the sample is too thin for the depth that the table needs, leaves
are split further by trees fitted on executors, each on a bounded sample of its own leaf, until all
are small: so leaves don't grow with the table. Only vectors that share a leaf are compared, exactly
and in double precision.

A pair that meets in several leaves counts in the first one, which each side knows from its own
list of leaves: no shuffle of pairs is needed. A leaf returns link counts and a spanning forest,
so its output is linear in its vectors. Leaves over BLOCK vectors (of vectors that are mostly linked)
are cut into blocks, and blocks are compared two by two: no task holds more than two blocks. Equal
vectors are one row throughout, and vectors travel in the precision in which they came.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from strandgraph.llm.common import components, cut, table

COSINE = 0.9
#: Trees, at least; one more for every four levels of a tree, as each level can part a pair.
TREES = 3
#: A split stops where fewer vectors are expected; vectors of a block.
LEAF, BLOCK = 400, 2_500
#: Share of a node's sample on each side of the median that spills over.
SPILL = 0.06
#: Sampled vectors that fit the trees, and their numbers, at most; the least that a node needs for a split.
SAMPLE, SAMPLE_VALUES, LEAST = 65_536, 8_388_608, 16
#: Sampled vectors that fit a leaf's own tree, about; vectors that one task routes by it, on average at most.
FIT, ROUTED = 2_048, 5_000
#: Vectors of a node that a split looks at, random directions that it tries, and where they may be cut.
LOOKED_AT, DIRECTIONS, CUTS = 256, 4, (0.5, 0.4, 0.6, 0.3, 0.7)
#: A node whose sampled vectors are mostly linked isn't split: blocks count its links.
DENSE = 0.85
SEED = 7


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """One tree for vectors of one dimension: directions, medians and margins in heap order.

    open has the leaves that are expected to be large, where the sample has no more to tell.
    """

    def __init__(self, sample: np.ndarray, share: float, rng: np.random.Generator):
        self.nodes: dict[int, tuple[np.ndarray, float, float]] = {}
        self.open: set[int] = set()
        stack = [(1, np.arange(len(sample)))]
        while stack:
            node, rows = stack.pop()
            if len(rows) * share <= LEAF:
                continue
            if len(rows) < LEAST or node >= 1 << 40:
                self.open.add(node)
                continue
            part = sample[rng.choice(rows, min(len(rows), LOOKED_AT), replace=False)]
            like = part @ part.T
            if np.median(like) >= DENSE:
                continue
            direction, middle, margin = self._split(sample[rows], part, np.argwhere(np.triu(like >= COSINE, 1)), rng)
            along = sample[rows] @ direction
            low, high = rows[along <= middle + margin], rows[along >= middle - margin]
            if len(low) == len(rows) or len(high) == len(rows):
                continue
            self.nodes[node] = (direction, middle, margin)
            stack += [(2 * node, low), (2 * node + 1, high)]

    @staticmethod
    def _split(vectors: np.ndarray, part: np.ndarray, linked: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, float]:
        """A random direction with a cut and a margin: the median, unless another cut, or the next
        direction, parts fewer of the node's linked pairs that were looked at."""
        best = None
        for _ in range(DIRECTIONS):
            direction = rng.standard_normal(vectors.shape[1])
            along, seen = vectors @ direction, part @ direction
            for share in CUTS:
                middle = float(np.quantile(along, share))
                margin = float(np.quantile(np.abs(along - middle), 2 * SPILL))
                side = np.where(seen > middle + margin, 1, np.where(seen < middle - margin, -1, 0))
                lost = int((side[linked[:, 0]] * side[linked[:, 1]] < 0).sum())
                if best is None or lost < best[0]:
                    best = lost, direction, middle, margin
                if not lost:
                    return best[1:]
        return best[1:]

    def route(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the rows that reach it."""
        stack = [(1, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if node not in self.nodes:
                if len(rows):
                    yield node, rows
                continue
            direction, middle, margin = self.nodes[node]
            along = vectors[rows] @ direction
            stack += [(2 * node, rows[along <= middle + margin]), (2 * node + 1, rows[along >= middle - margin])]


def _name(*parts: int) -> int:
    """A leaf's name."""
    return xxhash.xxh64_intdigest(",".join(map(str, parts))) >> 1


def _forest(sample: list[np.ndarray], n: int) -> dict[int, list[Tree]]:
    """Trees by dimension. Dimensions that the sample lacks have none: one leaf."""
    by_dim: dict[int, list[np.ndarray]] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    rng = np.random.default_rng(SEED)
    share = n / max(1, len(sample))
    count = max(TREES, math.ceil(math.log2(max(2, n / LEAF)) / 4))
    return {d: [Tree(unit(np.array(vs)), share, rng) for _ in range(count)] for d, vs in sorted(by_dim.items())}


def _assign(forest: dict[int, list[Tree]], kind: str):
    """Per vector: its bytes, the leaves that it reaches, and those of them that are to be split further."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["vector"].map(len)):
                given = np.stack(part["vector"].to_list())
                vectors = unit(given)
                leaves: list[list[int]] = [[] for _ in range(len(part))]
                opened: list[list[int]] = [[] for _ in range(len(part))]
                for t, tree in enumerate(forest.get(dim) or [None]):
                    for node, rows in tree.route(vectors) if tree else [(1, np.arange(len(part)))]:
                        name = _name(dim, t, node)
                        more = tree is None or node in tree.open
                        for r in rows:
                            leaves[r].append(name)
                            if more:
                                opened[r].append(name)
                yield pd.DataFrame({"id": part["id"], "copies": part["copies"], "dim": dim, "raw": [v.astype(kind).tobytes() for v in given], "leaf": leaves, "open": opened})

    return run


def _matrix(part: pd.DataFrame, kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(part["raw"]), kind).reshape(len(part), -1))


def _refined(placed: DataFrame, kind: str) -> DataFrame:
    """placed, with its open leaves split by trees of their own until none is large."""
    settled = placed.select("id", F.explode(F.array_except("leaf", "open")).alias("leaf"))
    now = cut(placed.select("id", F.explode("open").alias("leaf")))
    vectors = placed.select("id", "raw")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        leaf, size = int(part["leaf"].iloc[0]), int(part["size"].iloc[0])
        tree = Tree(_matrix(part, kind), size / len(part), np.random.default_rng(leaf))
        return pd.DataFrame({"leaf": [leaf], "tree": [pickle.dumps(tree)]})

    def route(part: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"id": [], "leaf": [], "open": []})
        leaf = int(part["leaf"].iloc[0])
        tree = pickle.loads(trees["tree"].iloc[0]) if len(trees) else None
        out = []
        for node, rows in tree.route(_matrix(part, kind)) if tree else [(1, np.arange(len(part)))]:
            out.append(pd.DataFrame({"id": part["id"].to_numpy()[rows], "leaf": _name(leaf, node), "open": bool(tree and tree.nodes and node in tree.open)}))
        return pd.concat(out)

    while not now.isEmpty():
        sizes = cut(now.groupBy("leaf").agg(F.count("*").alias("size")))
        settled = settled.unionByName(now.join(sizes.where(F.col("size") <= LEAF), "leaf", "left_semi"))
        large = cut(now.join(sizes.where(F.col("size") > LEAF), "leaf").join(vectors, "id"))
        drawn = large.where(F.pmod(F.xxhash64("id", "leaf"), F.col("size")) < FIT)
        trees = drawn.groupBy("leaf").applyInPandas(fit, "leaf long, tree binary")
        salts = sizes.where(F.col("size") > LEAF).select("leaf", F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / ROUTED).cast("int"))).alias("salt"))
        spread = trees.join(salts, "leaf")
        salted = large.withColumn("salt", F.pmod(F.xxhash64("id"), F.floor(F.col("size") / ROUTED) + 1).cast("int")).select("leaf", "salt", "id", "raw")
        routed = cut(salted.groupBy("leaf", "salt").cogroup(spread.groupBy("leaf", "salt")).applyInPandas(route, "id long, leaf long, open boolean"))
        settled = settled.unionByName(routed.where("not open").select("id", "leaf"))
        now = cut(routed.where("open").select("id", "leaf"))
    lists = settled.groupBy("id").agg(F.collect_set("leaf").alias("leaf"))  # as many as a vector's leaves
    return cut(placed.select("id", "copies", "dim", "raw").join(lists, "id"))


def _linked(kind: str):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Links of one pair of blocks of a leaf: (id, links, root) of the vectors that have any."""
        leaf, one, two = key
        x = _matrix(part, kind)
        ids, copies = part["id"].to_numpy(), part["copies"].to_numpy()
        blocks = part["block"].to_numpy()
        a = np.flatnonzero(blocks == one)
        b = a if one == two else np.flatnonzero(blocks == two)
        lists = np.full((len(part), max(len(v) for v in part["leaves"])), -1, np.int64)
        for k, v in enumerate(part["leaves"]):
            lists[k, : len(v)] = v
        links, root = np.zeros(len(part), np.int64), np.argsort(np.argsort(ids))
        back = np.argsort(root)
        has = np.zeros(len(part), bool)
        step = max(1, 1_000_000 // max(1, len(b)))
        pairs = []
        for at in range(0, len(a), step):
            i, j = np.nonzero(x[a[at : at + step]] @ x[b].T >= COSINE)
            i, j = a[at + i], b[j]
            i, j = (i[i < j], j[i < j]) if one == two else (i, j)
            for k in range(0, len(i), 20_000):
                p, q = i[k : k + 20_000], j[k : k + 20_000]
                before = np.where((lists[p] >= 0) & (lists[p] < leaf), lists[p], -2)
                new = ~(before[:, :, None] == lists[q][:, None, :]).any(axis=(1, 2))
                np.add.at(links, p[new], copies[q[new]])
                np.add.at(links, q[new], copies[p[new]])
            # a spanning forest of what was found so far stands for its pairs
            i, j = np.concatenate([*(u for u, _ in pairs), i]), np.concatenate([*(v for _, v in pairs), j])
            has[i] = has[j] = True
            while True:  # least rank among linked vectors, until nothing changes
                low = np.minimum(root[i], root[j])
                last = root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                root = root[back][root]
                if np.array_equal(last, root):
                    break
            linked = np.flatnonzero(has)
            pairs = [(linked, back[root[linked]])]
        found = np.flatnonzero(has)
        return pd.DataFrame({"id": ids[found], "links": links[found], "root": ids[back[root[found]]]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    n_links counts the other rows linked directly, component_id is the least id reachable. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of
    different dimension don't link, as leaves hold one dimension each. A null id is kept and ignored in
    minima. Repeated rows are rows of their own. A cosine of exactly the threshold is a link. Other columns aren't read. An empty table gives an empty result.
    """
    v = F.col("vector")
    fit = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    keyed = named.withColumn("fit", fit).withColumns({"h1": F.when(F.col("fit"), F.xxhash64("vector")), "h2": F.when(F.col("fit"), F.xxhash64(F.reverse("vector")))})
    found = keyed.where("fit").groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = cut(found.withColumn("id", F.monotonically_increasing_id()))
    n, widest = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    drawn = classes.orderBy("h1", "h2").limit(max(1, min(SAMPLE, SAMPLE_VALUES // (widest or 1)))).select("vector")
    forest = _forest([np.array(r["vector"]) for r in drawn.toLocalIterator()], n)
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    placed = cut(classes.select("id", "copies", "vector").mapInPandas(_assign(forest, kind), "id long, copies long, dim int, raw binary, leaf array<long>, open array<long>"))
    placed = placed.drop("open") if placed.where("size(open) > 0").isEmpty() else _refined(placed, kind)
    rows = placed.select("id", "copies", "raw", F.col("leaf").alias("leaves"), F.explode("leaf").alias("leaf"))
    large = placed.select(F.explode("leaf").alias("leaf")).groupBy("leaf").count().where(F.col("count") > BLOCK).select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    sized = rows.join(large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = sized.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    met = cut(paired.select("leaf", "one", "two", "block", "id", "copies", "raw", "leaves").groupBy("leaf", "one", "two").applyInPandas(_linked(kind), "id long, links long, root long"))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    rooted = classes.drop("vector").join(links, "id", "left").join(roots.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    linked = keyed.where("fit").select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = keyed.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_embeddings": _query}
