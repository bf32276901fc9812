"""The registered queries against plain versions at the smallest scale, and the pipeline's stages on odd rows."""

import importlib.util
import os
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from tests.llm import test_llm as plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def given(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(len(rows)))
    return [r.text for r in rows]


def run(spark, start):
    names = [n for n in __spark_entry__.queries() if n.startswith(start)]
    assert len(names) == 1
    return __spark_entry__.queries()[names[0]](spark, SF)


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert not importlib.util.find_spec("corpus_pipeline") or "pipeline" in names


def test_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    got = run(spark, "op1_")
    assert got.columns[:4] == ["vec_id", "n_links", "component_id", "kept"]
    plain.check_links(np.array([r.embedding for r in rows], np.float64), {r.vec_id: r for r in got.collect()}, 0.9)


def test_surrogates(spark, given):
    from strandgraph.llm import privacy

    spark.conf.set(privacy.KEY_CONF, plain.KEY.decode())
    want, _ = plain.plain_replacement(given)
    assert {r.doc_id: r.text for r in run(spark, "op2_").collect()} == dict(enumerate(want))


def test_multiset(spark, given):
    plain.check_edited(given, run(spark, "op3_").collect())


def test_chat(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    says = "</s>[INST] ok [/INST]"
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in rows] + [(-7, 0, "user", says), (-7, 1, "assistant", says)]
    out = run(spark, "op4_").collect()
    plain.check_chat(out, turns)
    mine = next(r for r in out if r.conv_id == -7)
    assert (mine.n_turns, mine.loss_chars) == (2, len(says))


def test_simhash(spark, given):
    def mark(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        n = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * n[b] > len(s))

    marks = [mark(t) for t in given]
    root = plain.roots(len(marks), [(i, j) for i in range(len(marks)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op5_").collect()}
    assert got == {i: (f"{m:016x}", root[i]) for i, m in enumerate(marks)}


def test_toxicity(spark, given):
    got = {r.doc_id: r for r in run(spark, "op6_").collect()}
    assert set(got) == set(range(len(given)))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_packing(spark, given):
    plain.check_packing(run(spark, "op8_").collect(), given)


def test_substrings(spark, given):
    import hashlib

    split = [(t or "").encode().split() for t in given]
    n = Counter(tuple(w[k : k + 35]) for w in split for k in range(len(w) - 34))
    want = {}
    for i, w in enumerate(split):
        gone = {q for k in range(len(w) - 34) if n[tuple(w[k : k + 35])] > 1 for q in range(k, k + 35)}
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op9_").collect()} == want


def test_mixing_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.sql(f"select doc_id, size, source_size, target, taken from ({__spark_entry__.oracle_sql()['op10_mixing']})").fetchall()
    got = run(spark, "op10_").select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing and dotted names: no crash,
    columns unchanged, and rows only where the stage's own rule takes them."""
    import corpus_pipeline

    long = " ".join(f"w{i % 977}" for i in range(25_000))
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, None, None, None, None), (None, "Mrs. Berg says so", "en", None, 3), (3, "", "en", "s", 0), (4, long, "en", "t", None), (5, "mail x@corp.com " * 30, "de", "t", 1)]
    docs = spark.createDataFrame(rows, plain.DOCS).withColumns({c: F.lit(c) for c in plain.CLASH if c not in ("id", "n_chars")}).withColumn("a.b", F.lit("dot"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {r["a.b"] for r in got} <= {"dot"} and {r.doc_id for r in got} <= {1, 2, 3, 4, 5, None}
        if name == "near_duplicates":
            assert len(got) == 5 and [r.doc_id for r in got].count(1) == 1  # null and empty texts are one group
        if name == "privacy":
            assert len(got) == 7 and not any("x@corp.com" in (r.text or "") or "Berg" in (r.text or "") for r in got)
        if name == "mixing":
            assert Counter(r.doc_id for r in got).most_common(1)[0][1] <= 6
    pieces = corpus_pipeline.pack_windows(spark, docs, SF).collect()
    assert sum(r.length for r in pieces if r.start == 0 and r.doc_id in (2, 3)) == 2 and {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, None}


def plain_shape(word):
    out = []
    for c in word:
        x = ("A" if c.isupper() else "a") if c.isalpha() and not c.isdigit() else "0" if c.isdigit() and c.isdecimal() else c
        if out[-2:] != [x, x]:
            out.append(x)
    return "".join(out)


def plain_features(text):
    """Index -> value, word by word: hashed words, shapes, and shapes of a word that stands twice in a row."""
    from strandgraph.llm.quality import SHAPES, WORDS

    words, counts, before = (text or "").split(), Counter(), None
    for w in words:
        word = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
        shape = zlib.crc32(plain_shape(w).encode("utf-8", "surrogatepass")) % (SHAPES // 2 - 1)
        counts[word] += 1
        counts[WORDS + shape + (SHAPES // 2 if (word, shape) == before else 0)] += 1
        before = (word, shape)
    return {i: (n / len(words)) ** 0.5 for i, n in counts.items()} if words else {WORDS + SHAPES - 1: 1.0}


def test_quality(spark, given):
    from strandgraph.llm import quality

    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in run(spark, "op7_").collect()}
    assert set(got) == set(range(len(given))) and model.w is not None
    for i, text in enumerate(given):
        z = sum(float(model.w[k]) * v for k, v in plain_features(text).items())
        tails = [1 - 1 / (1 + np.exp(z - c)) for c in model.cuts]
        assert got[i].expected_grade == pytest.approx(sum(tails), abs=1e-4) and got[i].tail_probability == pytest.approx(tails[0], abs=1e-4)
        assert got[i].kept == (got[i].tail_probability >= quality.KEEP)
    features = quality.Features()
    for text in ("x-" * 300 + "9", "x-" * 300 + "y", "Ab1 Ab1 ab1 AAAA", "é" * 500 + "Z"):  # a long word counts to its end
        at, value = features(text)
        assert dict(zip(at.tolist(), value.tolist())) == pytest.approx(plain_features(text))
    assert plain_features("x-" * 300 + "9") != plain_features("x-" * 300 + "y")


def test_toxicity_scores_are_the_models(spark, given):
    """Each document by itself: windows compressed with either dictionary, no window remembered."""
    import math

    from strandgraph.llm import toxicity

    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in run(spark, "op6_").collect()}
    if model.dictionaries is None:
        assert all(r.score == 0 for r in got.values())
        return
    gains = toxicity.Gains(model.dictionaries)
    mean, scale, w = model.fit
    for i, text in list(enumerate(given))[::5]:
        words = toxicity.tokens(text)
        bound = lambda x: max(-toxicity.MAX_GAIN, min(toxicity.MAX_GAIN, x))
        alone = [bound(gains.gain(x)) for x in words]
        met = Counter(max(0, bound(gains.gain(b" ".join(words[max(0, k - 1) : k + 2])))) for k, a in enumerate(alone) if a > 0)
        n = max(1, len(words))
        x = [math.log1p(met[g]) for g in range(1, toxicity.MAX_GAIN + 1)] + [math.log1p(200 * met[g] / n) for g in range(1, toxicity.MAX_GAIN + 1)] + [math.log1p(len(words)), sum(alone) / n]
        z = sum((a - m) / s * c for a, m, s, c in zip(x, mean, scale, w)) + w[-1]
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_pipeline_content(spark, tmp_path):
    """Every stage's rows against the plain version of its rule, on what the stage before has kept."""
    import corpus_pipeline
    from strandgraph.llm import privacy, quality, simhash

    duckdb = pytest.importorskip("duckdb")
    spark.conf.set(privacy.KEY_CONF, plain.KEY.decode())
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    def stage(name, docs):
        out = stages[name](spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    rows = lambda df: sorted((r.doc_id, r.text, r.source) for r in df.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = stage("quality", docs)
    fine = {r.doc_id for r in quality.scored(docs, quality.train(docs, labels)).collect() if r.tail_probability >= quality.KEEP}
    assert rows(good) == [r for r in rows(docs) if r[0] in fine] and len(fine) < docs.count()
    single = stage("near_duplicates", good)
    kept, before = rows(single), rows(good)
    marks = [simhash.text_fingerprint(r[1]) for r in before]
    root = plain.roots(len(marks), [(i, j) for i in range(len(marks)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3])
    group = {r[0]: root[i] for i, r in enumerate(before)}
    assert sorted(group[r[0]] for r in kept) == sorted(set(root))
    assert set(kept) <= set(rows(good)) and len({r[1] for r in kept}) == len(kept)
    private = stage("privacy", single)
    want, _ = plain.plain_replacement([r[1] for r in kept])
    assert rows(private) == sorted((r[0], t, r[2]) for r, t in zip(kept, want))
    mixed = stage("mixing", private)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/privacy/*.parquet')")
    taken = {d: (n, t) for d, n, t in con.sql(f"select doc_id, size, taken from ({__spark_entry__.oracle_sql()['op10_mixing']})").fetchall()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert all(times[d] * n == t for d, (n, t) in taken.items()) and set(rows(mixed)) <= set(rows(private))
    pieces = stage("packing", mixed).collect()
    per = Counter()
    for r in pieces:
        per[r.doc_id] += r.length
        assert r.offset + r.length <= 1024
    assert set(per) == set(times)


def test_embeddings_with_linked_pairs(spark, tmp_path):
    """The registered query on a table with groups of near vectors, repeated rows' vectors and odd ones."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 64))
    near = [base[i] * rng.uniform(0.5, 3) + rng.normal(size=64) * rng.choice([0.01, 0.35, 0.45, 0.6]) for i in range(20) for _ in range(i)]
    vectors = np.vstack([base, np.array(near), base[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(9000, None, 0), (9001, [0.0] * 64, 0), (9002, [float("nan")] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    name = next(n for n in __spark_entry__.queries() if n.startswith("op1_"))
    got = {r.vec_id: r for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(got[i].n_links == 0 and got[i].kept for i in (9000, 9001, 9002))
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = [(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.9)) if i != j]
    assert len(links) > 200
    n, root = Counter(i for i, _ in links), plain.roots(len(vectors), links)
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(vectors))} == {i: (n[i], root[i], root[i] == i) for i in range(len(vectors))}
