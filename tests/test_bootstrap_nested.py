"""The nested bootstrap draws from every row, and draws as the counts by row do."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sievework.operators import sampling as P
from sievework.plans import views as V
from sievework.plans.q_metrics import bootstrap_nested

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def test_draws_come_from_all_rows(spark):
    n = duckdb.sql(f"SELECT count(*) FROM read_parquet('{SF}/events.parquet')").fetchall()[0][0]
    got = {r.draw: r for r in bootstrap_nested(spark, SF).collect()}
    weights = Counter({r.draw: r.w for r in P.poisson_draws(V.patterns(spark, SF, 1), "row_id", 5, 62).groupBy("draw").agg(F.sum("weight").alias("w")).collect()})
    assert {k: r.rows for k, r in got.items()} == weights
    assert all(abs(r.rows - n) < 5 * n**0.5 for r in got.values())
    assert all(0 < r.diversity < 2 for r in got.values())


def test_cells_equal_counts(spark):
    rows = V.patterns(spark, SF, 1).limit(40).select(F.col("row_id").cast("string").alias("k"), "p").cache()
    want = {(r.k, r.cell): r.n for r in P.multinomial_counts(rows, "k", "p", 32, 63).collect()}
    got = rows.select("k", F.posexplode(P.multinomial_cells(F.col("p"), "k", 32, 63)).alias("cell", "n")).where("n > 0").collect()
    assert {(r.k, r.cell): r.n for r in got} == want
