"""Decontamination, ranked search and the filter audit against brute force, on odd rows and at the smallest scale."""

import hashlib
import itertools
import math
import os
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from strandgraph.llm import contamination, filters, lexical

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string, source string", "item_id string, text string"
CLASH = ("h", "w", "at", "len", "digest", "part", "mask", "row", "term", "rank", "score", "found", "copies")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s) for i, t, s in rows], DOCS).withColumns({c: F.lit(c) for c in CLASH})


def told(docs, items, size=10):
    """Brute force: (doc_id, n_words, n_hit, n_items, sha, contaminated) of each row."""
    grams = defaultdict(set)
    for i, t in items:
        w = split(t)
        k = min(len(w), size)
        for p in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[p : p + k])].add("" if i is None else str(i))
    out = []
    for i, t, _ in docs:
        w, hit, found = split(t), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in grams:
                    hit |= set(range(p, p + k))
                    found |= grams[tuple(w[p : p + k])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.select(*columns).collect()), key=repr)


CONTAMINATED = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ODD_ITEMS = [("b2", PASSAGE), ("a10", f"x {PASSAGE} y"), ("a9", "short Item!"), (None, "KK éß"), ("e", ""), ("n", None), ("a9", "short Item!"), ("w", " ".join(f"w{i}" for i in range(500, 520)))]
ODD_DOCS = [
    (1, f"So: {PASSAGE.upper()}, then", "s"), (2, " ".join(PASSAGE.split()[:9]), "s"), (3, "a SHORT-item b short item", None), (4, None, None), (5, "", ""), (6, LONG, "s"), (1, f"So: {PASSAGE.upper()}, then", "s"),
    (1, "other text of the same id", "s"), (None, "kK Éß kK éß", "t"), (None, None, "t"), (7, "\U0001f600 " * 40 + PASSAGE, "t"), (8, "...\x00\x7f", "t"), (9, " ".join([PASSAGE] * 50), "t"),
]


def test_contamination_on_odd_rows(spark):
    docs, items = docs_of(spark, ODD_DOCS), spark.createDataFrame(ODD_ITEMS, ITEMS).withColumn("gram", F.lit(1))
    want = told(ODD_DOCS, ODD_ITEMS)
    assert rows_of(contamination.contaminated(docs, items), *CONTAMINATED) == want
    assert rows_of(contamination.contaminated(docs, items, rows=7), *CONTAMINATED) == want  # many blocks
    none = told(ODD_DOCS, [])
    assert rows_of(contamination.contaminated(docs, items.limit(0)), *CONTAMINATED) == none
    assert contamination.contaminated(docs.limit(0), items).count() == 0


def test_contamination_blocks_stay_within_their_bound(spark):
    items = spark.range(300).select(F.col("id").alias("item_id"), F.concat_ws(" ", *[F.concat(F.lit(f"k{j}x"), "id") for j in range(12)]).alias("text"))
    grams = contamination.windows(items)
    parts = contamination.blocks(grams, rows=100)
    sizes = [p.count() for p in parts]
    assert sum(sizes) == grams.count() == 900 and max(sizes) <= 100


def test_cleaning_removes_spans_or_documents(spark):
    docs, items = docs_of(spark, ODD_DOCS), spark.createDataFrame(ODD_ITEMS, ITEMS)
    spans = contamination.clean(docs, items)
    assert spans.columns == docs.columns
    got = {(r.doc_id, r.text) for r in spans.collect()}
    assert (1, "So: then") in got and (2, " ".join(PASSAGE.split()[:9])) in got and (4, None) in got and (3, "a b ") in got and (9, "") in got and (5, "") in got
    assert spans.count() == len(ODD_DOCS) and not contamination.contaminated(spans.where("doc_id <> 6"), items).where("contaminated").count()
    kept = contamination.clean(docs, items, "documents")
    assert kept.columns == docs.columns and rows_of(kept, "doc_id", "text") == sorted(((i, t) for i, t, _ in ODD_DOCS if not told([(i, t, None)], ODD_ITEMS)[0][5]), key=repr)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=8), st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5))
def test_contamination_of_repetitive_texts(spark, docs, items):
    docs = [(i, " ".join(d), "s") for i, d in enumerate(docs)]
    items = [(str(i), " ".join(d)) for i, d in enumerate(items)]
    got = contamination.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), size=4)
    assert rows_of(got, *CONTAMINATED) == told(docs, items, 4)


def ranked(docs, items, k=10):
    """Brute force: (item_id, rank, doc_id, score)."""
    split_docs = [(i, split(t)) for i, t, _ in docs if split(t)]
    n_docs, total = len(split_docs), sum(len(w) for _, w in split_docs)
    counts = [(i, len(w), Counter(w)) for i, w in split_docs]
    df = Counter(t for _, _, c in counts for t in c)
    wanted = defaultdict(list)
    for i, t in items:
        if i is not None:
            wanted[i] += split(t)
    out = []
    for item, words in wanted.items():
        scores = []
        for i, n, c in counts:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


RANKED = ("item_id", "rank", "doc_id", "score")


def test_search_on_odd_rows(spark):
    docs, items = docs_of(spark, ODD_DOCS), spark.createDataFrame(ODD_ITEMS, ITEMS).withColumn("times", F.lit(1))
    want = ranked(ODD_DOCS, ODD_ITEMS)
    assert rows_of(lexical.ranked(docs, items), *RANKED) == want and {r[0] for r in want} == {"b2", "a10", "a9", "w"}
    assert rows_of(lexical.ranked(docs, items, k=1, seeds=1), *RANKED) == ranked(ODD_DOCS, ODD_ITEMS, 1)
    assert lexical.ranked(docs, items.limit(0)).count() == lexical.ranked(docs.limit(0), items).count() == 0


def test_search_prunes_nothing_that_counts(spark, monkeypatch):
    """Many ties and repeated rows, few documents an item, terms of all frequencies; with and without a sent vocabulary."""
    import random

    rng = random.Random(3)
    words = [f"t{i}" for i in range(40)]
    some = lambda n: " ".join(words[min(39, int(rng.expovariate(0.15)))] for _ in range(n))
    docs = [(i // 2, some(rng.choice([1, 2, 5, 40, 200])), "s") for i in range(300)]
    docs += [docs[7]] * 15
    items = [(f"i{i}", some(rng.choice([1, 3, 8, 30]))) for i in range(25)]
    want = ranked(docs, items)
    for seeds, known in ((5, 1_000_000), (60, 0), (10_000, 1_000_000)):
        monkeypatch.setattr(lexical, "VOCABULARY", known)
        got = lexical.ranked(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(items, ITEMS), seeds=seeds)
        assert rows_of(got, *RANKED) == want


def test_postings_deal_frequent_terms(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("all "), F.when(F.col("id") % 2 == 0, "even ").otherwise(""), F.lit("r"), "id").alias("text"), F.lit("s").alias("source"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # else a small table's buckets are one file
    spark.conf.set(name, "false")
    index = lexical.postings(docs.unionByName(docs.select("doc_id", F.lit("z").alias("text"), "source")), bucket_rows=500)
    spark.conf.unset(name)
    assert index.where("term = 'even'").count() == 2000 and index.where("term = 'r17'").count() == 1
    assert index.where("term = 'all'").select(F.input_file_name()).distinct().count() > 1


def audited(docs, labels):
    """Brute force: every order applied to every document, one filter after the other."""
    rows = [(i, t or "", s or "") for i, t, s in docs]
    marks = defaultdict(lambda: [False, False])
    for i, q, x in labels:
        if i is not None:
            marks[i][0] |= q == 1
            marks[i][1] |= x == 1
    def fails(i, t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        found = "A" if len(w) < 50 else ""
        found += "B" if 100 * len(set(w)) < 65 * len(w) else ""
        found += "C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else ""
        found += "D" if set(t) & set("#$%&*|") else ""
        return found + ("E" if i is not None and any(j is not None and j < i and u == t for j, u, _ in rows) else "")

    each = [(s, fails(i, t), *(marks[i] if i is not None else (False, False))) for i, t, s in rows]
    out = []
    for part in sorted({s for s, *_ in each}):
        mine = [x[1:] for x in each if x[0] == part]
        steps, total = {}, Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, letter in enumerate(order):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                total[letter] += len(gone)
                all_failing = sum(letter in x[0] for x in mine)
                steps[order, k + 1] = (len(left), len(gone), all_failing - len(gone), sum(x[0] == letter for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone))
        out += [(part, o, k, *v, total[o[k - 1]]) for (o, k), v in steps.items()]
    return sorted(out, key=repr)


AUDITED = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_on_odd_rows(spark):
    words = " ".join(f"u{i}" for i in range(60))
    rows = [
        (1, words, "s"), (2, words, "t"), (2, words, "t"), (3, words, ""), (None, words, None), (4, None, None), (5, "", "s"), (0, "", "t"), (6, "A B C", "s"), (7, "a " * 80, "s"), (8, f"{words} #", "t"),
        (9, f"{words} {words} {words}|", "t"), (10, LONG, "s"), (11, LONG, "s"), (12, "x y " * 60, "t"), (13, "\U0001f600" * 99 + "ABCDEF", "t"),
    ]
    labels = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (5, None, 1), (None, 1, 1), (7, 1, 1), (8, 1, None), (99, 1, 1), (11, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    docs = docs_of(spark, rows)
    assert rows_of(filters.audit(docs, frame), *AUDITED) == audited(rows, labels)
    assert rows_of(filters.audit(docs, frame.limit(0)), *AUDITED) == audited(rows, [])
    assert filters.audit(docs.limit(0), frame).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    run = lambda name, columns: rows_of(__spark_entry__.queries()[name](spark, SF), *columns)
    assert run("op11_contamination", CONTAMINATED) == told(docs, items)
    assert run("op12_search", RANKED) == ranked(docs, items)
    assert run("op13_filters", AUDITED) == audited(docs, labels)


def test_contamination_runs_in_the_jvm(spark):
    docs, items = docs_of(spark, ODD_DOCS), spark.createDataFrame(ODD_ITEMS, ITEMS)
    plan = contamination.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
