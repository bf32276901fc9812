"""A sample of the registered queries against their SQL twins at the smallest scale."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = "lineage concept_nodes resolve_paren score_groups gate_batches merge_candidates cut_signals usage_by_stage md_sections find_similar".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    row = lambda r: tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r)
    want = con.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(row, got.select(*columns).collect()))) == sorted(map(repr, map(row, want)))
