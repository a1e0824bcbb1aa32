"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessella.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(pdf):
    plain = lambda x: tuple(float(v) for v in x) if isinstance(x, (list, np.ndarray)) else None if pd.api.types.is_scalar(x) and pd.isna(x) else float(x) if isinstance(x, (int, float, np.number)) else x
    return sorted((tuple(map(plain, r)) for r in pdf[sorted(pdf.columns)].astype(object).values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got, want = rows(QUERIES[name](spark, SF).toPandas()), rows(duck.execute(ORACLE[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 for x, y in zip(a, b, strict=True)), (a, b)


def test_queries_without_sql(spark):
    """What SQL can't express; the operators behind them are tested by numbers in test_operators."""
    assert sorted(set(QUERIES) - set(ORACLE)) == ["j08_index", "m06_cross_validation", "s04_gbm_oracle"]
    folds = QUERIES["m06_cross_validation"](spark, SF).toPandas()
    assert sorted(folds["fold"].unique()) == list(range(5)) and folds.groupby("fold")["n"].first().sum() == QUERIES["a06_prefix_features"](spark, SF).count()
    ranked = QUERIES["s04_gbm_oracle"](spark, SF).toPandas()
    assert list(ranked["rank"]) == list(range(1, 21)) and ranked["score"].is_monotonic_decreasing
    exact = QUERIES["j07_knn_distances"](spark, SF).toPandas().groupby("crop_id")["dist"].max()
    near = QUERIES["j08_index"](spark, SF).toPandas()
    assert (near["dist"] <= near["query_id"].map(exact) + 1e-9).mean() >= 0.9  # the share of the true five nearest


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
