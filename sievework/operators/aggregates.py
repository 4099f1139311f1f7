"""Counts, profiles, quantiles and summaries."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ordered


def split_counts(df: DataFrame, by: str, label: str = "y") -> DataFrame:
    neg = F.count_if(F.col(label) == 0)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("prevalence"), F.try_divide(neg, F.sum(label)).alias("neg_pos_ratio")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """column, n, share of all rows that are not null."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("_all"))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def card_profile(df: DataFrame, card: str, amount: str) -> DataFrame:
    """Mean and sample deviation (0 for one row) of log(1 + amount) by card, and over all rows (population deviation)."""
    x = F.log1p(F.col(amount))
    by = df.groupBy(card).agg(F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"))
    return by.join(df.agg(F.avg(x).alias("all_mean"), F.stddev_pop(x).alias("all_sd")))


def quantiles(df: DataFrame, column: str, qs: list[float], groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, q, value) by linear interpolation between order statistics; nulls don't count.

    Values are counted first and put in order in buckets, so neither a group nor its distinct values meet in one task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count(F.lit(1)).alias("_n"))
    o = ordered(counts, column, groups=groups, sums={"n": F.col("_n")}, ranks=False)
    o = o.select(*groups, F.col(column).cast("double").alias("_v"), (F.col("run_n") - F.col("_n")).alias("_from"), "run_n", "all_n", F.explode(F.array(*(F.lit(float(q)) for q in qs))).alias("q"))
    at = F.col("q") * (F.col("all_n") - 1)
    holds = lambda rank: (F.col("_from") <= rank) & (rank < F.col("run_n"))
    ends = o.groupBy(*groups, "q").agg(F.max(F.when(holds(F.floor(at)), F.col("_v"))).alias("_low"), F.max(F.when(holds(F.ceil(at)), F.col("_v"))).alias("_high"), F.max("all_n").alias("all_n"))
    share = at - F.floor(at)
    return ends.select(*groups, "q", F.when(share == 0, F.col("_low")).otherwise((1 - share) * F.col("_low") + share * F.col("_high")).alias("value"))


def quantile_linear(df: DataFrame, column: str, qs: list[float]) -> DataFrame:
    """(q, value) by linear interpolation between order statistics."""
    return quantiles(df, column, qs)


def quantile_higher(df: DataFrame, column: str, q: float, groups: tuple[str, ...] = ()) -> DataFrame:
    """The value at 0-based rank ceil(q (n - 1)), per group: the smallest at or above the quantile's position."""
    placed = ordered(df.where(F.col(column).isNotNull()), column, groups=groups, ranks=False)
    at = F.ceil(F.round(q * (F.col("total") - 1), 9)) + 1
    return placed.where(F.col("position") == at).select(*groups, F.col(column).alias("threshold"))


def robust_spread(df: DataFrame, column: str, groups: tuple[str, ...] = (), floor: float = 1e-12) -> DataFrame:
    """Median, interquartile range and the variance of (x - median) / range, which is var / range^2; ranges under floor count as floor."""
    of = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    found = quantiles(df, column, [0.25, 0.5, 0.75], groups).groupBy(*groups).agg(of(0.25).alias("_lo"), of(0.5).alias("median"), of(0.75).alias("_hi"))
    spread = df.groupBy(*groups).agg(F.var_pop(column).alias("v"))
    spread = spread.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), "v")
    on = [found[g].eqNullSafe(spread[f"_g{i}"]) for i, g in enumerate(groups)]
    both = found.join(spread, on) if groups else found.join(F.broadcast(spread))  # one row each
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(floor))
    return both.select(*groups, "median", width.alias("iqr"), (F.col("v") / (width * width)).alias("robust_variance"))


def bincount(df: DataFrame, column: str, bins: int) -> DataFrame:
    counts = df.groupBy(F.col(column).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def vector_mean(df: DataFrame, column: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, cell, mean) over the rows' vectors."""
    return exploded(df, column, groups).groupBy(*groups, "cell").agg(F.avg("x").alias("mean"))


def exploded(df: DataFrame, column: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, cell, x) by entry of the rows' vectors. The outer form: for a plain posexplode Spark adds a filter on the
    vector's size, which computes the whole vector once more wherever it is not stored."""
    return df.select(*groups, F.posexplode_outer(column).alias("cell", "x")).where("cell IS NOT NULL")


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, mean_i, mean_j, cov): population covariances of all pairs i <= j, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs))
    rows = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"m_{a}").alias("mean_i"), F.col(f"m_{b}").alias("mean_j"), F.col(f"c_{a}_{b}").alias("cov")) for a, b in pairs]
    return one.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def arg_best(df: DataFrame, metric: str, index: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """The row with the largest metric, the earliest index on ties."""
    best = df.groupBy(*groups).agg(F.max_by(F.struct(*[c for c in df.columns if c not in groups]), F.struct(F.col(metric), -F.col(index))).alias("e"))
    return best.select(*groups, "e.*")


def seed_mean(df: DataFrame, row: str, score: str, seeds: int) -> DataFrame:
    """Mean score per row over seeds; null where a seed is missing or failed (null score)."""
    agg = df.groupBy(row).agg(F.avg(score).alias("_m"), F.count(score).alias("n"))
    return agg.select(row, F.when(F.col("n") == seeds, F.col("_m")).alias("score"), "n")


def seed_status(df: DataFrame, family: str, ok: Column) -> DataFrame:
    agg = df.groupBy(family).agg(F.count_if(ok).alias("done"), F.count(F.lit(1)).alias("n"))
    return agg.withColumn("status", F.when(F.col("done") == F.col("n"), "COMPLETE").when(F.col("done") > 0, "PARTIAL").otherwise("FAILED"))


def draw_summary(df: DataFrame, value: str, groups: tuple[str, ...] = ()) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    agg = df.groupBy(*groups).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), p.alias("p"))
    return agg.select(*groups, "mean", "sd", F.get("p", 1).alias("median"), F.get("p", 0).alias("low"), F.get("p", 2).alias("high"))
