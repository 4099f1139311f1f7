"""Exact resampling keeps its rows for any number of draws."""

from pyspark.sql import functions as F

from sievework.operators import sampling as P


def test_over_a_thousand_draws(spark):
    df = spark.createDataFrame([(i,) for i in (3, 5, 8)], "row_id long")
    many = {(r.draw, r.row_id): r.weight for r in P.multinomial_draws(df, "row_id", 1001, 2).collect()}
    few = {(r.draw, r.row_id): r.weight for r in P.multinomial_draws(df, "row_id", 4, 2).collect()}
    assert few == {k: w for k, w in many.items() if k[0] < 4}
    assert len({k[0] for k in many}) == 1001 and sum(many.values()) == 3 * 1001
    assert P.multinomial_draws(df.where(F.lit(False)), "row_id", 4, 2).count() == 0
