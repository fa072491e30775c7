"""Every query with an SQL twin gives the same rows on an independent engine."""

import math
from decimal import Decimal

import duckdb
import pytest

from marketspan.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: The same drafts as W-15_snapshot, which is tested.
SAME_DRAFTS = {"R-29_occurrences", "W-22_report"}


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool):
        return round(float(x), 6)
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events pages".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SAME_DRAFTS))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=str)
    assert ours == theirs
