"""Every registered query runs; where an oracle exists the results are equal."""

import re

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()
# The queries of the training-data operators have tests of their own.
OWN = re.compile(r"op\d+_|pipeline$")
# Rows-only queries that build a whole evidence packet; the fixtures in test_evidence cover them.
SLOW = {"packet_identity", "scoped_packet", "verified_packet", "route_ablation"}


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW and not OWN.match(n)])
def test_query(spark, sf, con, name):
    frame = QUERIES[name](spark, sf)
    got = compare.rows_of(frame.columns, frame.collect())
    if name in ORACLES:
        names, rows = compare.oracle_rows(con, ORACLES[name])
        assert sorted(names) == sorted(frame.columns)
        assert got == compare.rows_of(names, rows)


def test_entry(spark):
    frame = entry(spark)
    assert frame.count() > 0 and "phrase" in frame.columns


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
