"""What a later state of the graph has that an earlier one hasn't."""

import os

import pytest

import __spark_entry__
from strandgraph.operators import audit

SF = "/root/testdata/sf0.001"


def test_every_part_of_the_graph_is_compared(spark):
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    state = lambda concepts, papers, lineage, lexicon: {
        "concepts": frame("rk string, canonical string", *concepts), "papers": frame("paper_id string", *papers),
        "lineage": frame("src string, dst string", *lineage), "lexicon": frame("rk string, label string, status string", *lexicon),
    }
    before = state([("a", "A"), (None, "?"), ("gone", "Gone")], [("p1",), (None,)], [("a", "b")], [("a", "A", "unreviewed")])
    after = state([("a", "A new"), ("b", "Bee"), (None, "?")], [("p1",), ("p2",), (None,)], [("a", "b"), ("b", "a")], [("a", "A", "approved"), ("b", "Bee", "unreviewed"), ("c", "C", "rejected")])
    want = [("concept", "Bee"), ("lexicon", "Bee"), ("lexicon", "C"), ("lineage", "b -> a"), ("paper", "p2"), ("unreviewed", "Bee")]
    assert sorted(map(tuple, audit.added(before, after).collect())) == want
    assert audit.added(after, after).isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_query_compares_concepts_and_the_lexicon_too(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = sorted(map(tuple, __spark_entry__.queries()["graph_diff"](spark, SF).select("kind", "id").collect()))
    assert got == sorted(con.sql(f"select kind, id from ({__spark_entry__.oracle_sql()['graph_diff']})").fetchall())
    assert {kind for kind, _ in got} == {"concept", "paper", "lineage", "lexicon", "unreviewed"}
