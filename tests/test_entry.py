import os

import duckdb
import pytest

import __spark_entry__ as entry
from seqloom import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SOME = ("dict_ev", "succ_rank_ev", "encode_s_ev", "bwt_s_ev", "lcp_ev", "glcp_usr", "runs_bwt_ev", "count_order1_ev_m3", "size_report_ev", "size_forms_ev", "bench_report_ev", "build_report_ev", "generated_syn", "id_of_ev", "bench_agree_ev", "sampled_patterns_ev_m16", "lcp_rounds_ev", "glcp_rounds_usr", "gsa_docs_heads")


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(map(tuple, frame[names].astype(str).values))


@pytest.mark.parametrize("name", SOME)
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
