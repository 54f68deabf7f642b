"""Every named query of the engine against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from gridloom.plans import catalog, oracles

DIR = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()
#: Queries of fitted models and rounding: no SQL.
FITTED = {"lookup_float_mismatch", "cdf_train", "lattice_train", "mlp_train", "bootstrap_points"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in SQL])
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DIR)
    names = sorted(got.columns)
    want = duck.sql(SQL[name])
    assert names == sorted(want.columns)
    theirs = want.select(*(f'"{c}"' for c in names)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, theirs))


def test_fitted_queries(spark):
    q = catalog.queries()
    assert set(q) - set(SQL) == FITTED
    one = q["lookup_float_mismatch"](spark, DIR).first()
    assert one.rate < 0.02 and one.max_diff <= 1
    assert all(r.valid and r.loss <= r.base * 1.0001 + 1e-6 for r in q["cdf_train"](spark, DIR).collect())
    assert all(r.n_parameters == 97 and r.loss >= 0 for r in q["mlp_train"](spark, DIR).collect())
    assert q["bootstrap_points"](spark, DIR).first().n == 500
    lattice = q["lattice_train"](spark, DIR).collect()
    assert len(lattice) == 1000 and sum(r.y > 0 for r in lattice) > 900


def test_lattice_radii_are_those_of_the_points(spark, duck):
    """Predicted radii against the distances to the k-th neighbours, by SQL."""
    y = {r.pid: r.y for r in catalog.queries()["lattice_train"](spark, DIR).collect()}
    true = dict(duck.sql(f"WITH {oracles.EV} SELECT a.pid, list_sort(list(sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))))[{catalog.K}] FROM ev a JOIN ev b ON a.pid <> b.pid GROUP BY a.pid").fetchall())
    mean = sum(true.values()) / len(true)
    assert sum((y[p] - t) ** 2 for p, t in true.items()) < 1.2 * sum((mean - t) ** 2 for t in true.values())
