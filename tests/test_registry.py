import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import diff

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "q6_arithmetic_mismatches", "q7_items_vs_totals", "q14_numbered_list", "r18_rule_check", "v1_dedupe_issues",
    "g2_grounding_check", "p10_paged_items", "l4_build_layout_item", "h6_apply_probe", "c1_reserve", "t3_number_tickets",
    "st2_stream_reserve", "st6_session_errors",
]
OWN = re.compile(r"(op\d+_.*|pipeline)$")  # the corpus operators have tests of their own
if os.environ.get("ALL_QUERIES"):  # every registered query; takes some minutes
    SAMPLE = [n for n in entry.oracle_sql() if not OWN.match(n)]


def test_every_query_has_its_sql():
    named = {n for n in entry.queries() if not OWN.match(n)}
    assert named == {n for n in entry.oracle_sql() if not OWN.match(n)}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    problem = diff((df.columns, [tuple(r) for r in df.collect()]), ([x[0] for x in cur.description], cur.fetchall()))
    assert not problem, problem
