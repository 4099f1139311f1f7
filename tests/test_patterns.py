"""Patterns hash a row once a cell, and moments of shots are those of the counts by row."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.operators import sampling as P
from sievework.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", ["row_diversity", "walsh_coefficients", "vector_mean"])
def test_a_pattern_takes_one_hash_a_cell(spark, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("md5(") == 8 and "lambdafunction" not in plan


def test_normalised_binds_its_vector_once(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (2, [])], "k int, v array<double>")
    out = df.select(S.normalised(F.transform("v", lambda x: S.keyed_uniform(1, "k", x))).alias("p"))
    assert out._jdf.queryExecution().executedPlan().toString().count("md5(") == 1
    assert [list(r.p) for r in df.select(S.normalised(F.col("v")).alias("p")).collect()] == [[0.25, 0.75], []]


def test_moments_equal_counts(spark):
    rows = spark.createDataFrame([(d, i, (d + i) % 4, [0.1 * i, 0.5, 0.5 - 0.1 * i]) for d in (0, 1) for i in range(1, 5)], "draw int, row_id long, weight int, p array<double>")
    got = {(r.draw, r.cell): (r.rows, r.s, r.q) for r in P.shot_moments(rows, "row_id", "p", 16, 63).groupBy("draw", "cell").agg(*(F.sum(c).alias(c) for c in ("rows", "s", "q"))).collect()}
    copies = rows.where("weight > 0").select("*", F.explode(F.sequence(F.lit(1), "weight")).alias("copy")).withColumn("k", F.concat_ws("/", "draw", "row_id", "copy"))
    want, n = Counter(), Counter()
    for r in copies.select("draw", F.posexplode(P.multinomial_cells(F.col("p"), "k", 16, 63)).alias("cell", "n")).collect():
        for k, x in enumerate((1, r.n, r.n * r.n)):
            want[r.draw, r.cell, k] += x
        n[r.draw, r.cell] += 1
    assert got == {at: tuple(want[(*at, k)] for k in range(3)) for at in n}
