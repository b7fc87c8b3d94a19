"""Every query that has an SQL twin returns the twin's rows; the others return rows."""

import pytest
from oracle import connect, same

from tidemark import catalog

SQL = catalog.oracle_sql()
REST = sorted(set(catalog.queries()) - set(SQL))


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, con, name):
    same(catalog.queries()[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", ["l02_second_learner", "l04_out_of_fold", "l06_focal_training", "l07_group_ranker", "l08_isolation_forest", "s14_model_files", "x17_danger", "x23_model_importance", "x03_nelder_mead"])
def test_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_inventory_is_covered():
    wanted = {"S": 14, "C": 25, "F": 20, "E": 21, "J": 13, "P": 25, "W": 20, "O": 7, "U": 4, "M": 10, "N": 3, "G": 1, "X": 23, "L": 9}
    ids = {f"{k}{i:02d}" for k, n in wanted.items() for i in range(1, n + 1)}
    assert sorted(ids - set(catalog.covered())) == []


def test_entry(spark):
    assert "anom_amt_zscore" in catalog.entry(spark, "/root/testdata/sf0.001").columns
