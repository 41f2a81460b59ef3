"""Every registered query of the library against its SQL on the same tables."""

import math
from collections import Counter

import pytest

from inkwell.plans import all_queries, board_watch

from .conftest import SF

QUERIES, SQL = all_queries()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    got = duck.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(out.columns)
    assert rows(out.columns, map(tuple, out.collect())) == rows(columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert board_watch(spark, SF).count() > 0


def test_plans(spark):
    """Scalar operators stay in the JVM; a top-k limits before its shuffle."""
    plan = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan("x1_normalize_url") and "Arrow" not in plan("x8_html_text")
    assert "WindowGroupLimit" in plan("k1_coarse_top")
    assert "CartesianProduct" not in plan("j1_newly_entered")
