"""Registered queries against their SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from treeline.plans import queries as hierarchy
from treeline.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
SOME = ["t1_clean_term", "t3_parse_lemma", "p1_parse_arrow_lines", "c1_lexical_edges", "c5_extraction_requests", "g2_reduction", "g7_condense_synonyms", "g16_closed_sample", "m3_prf", "m5_evaluate_modes", "m11_remove_edges", "m14_prune_sweep_direct", "m22_fp_context", "f3_make_examples", "a9_paired_delta_test", "a16_roc_auc"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, names, order):
    at = [names.index(n) for n in order]
    return sorted(repr(tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns, sorted(names)) == plain(cur.fetchall(), names, sorted(names))


def test_every_oracle_has_a_query():
    assert set(hierarchy.ORACLE_SQL) <= set(hierarchy.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
