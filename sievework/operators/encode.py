"""Encoders fitted on a subset: frequencies, first-appearance codes, empirical distribution, bits, standard scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.ordered import ordered


def ecdf(df: DataFrame, column: str, fit: Column, groups: tuple[str, ...] = ()) -> DataFrame:
    """df with n_lt and n_le (fit rows below, and up to, the value), n_fit and u = (n_lt + n_le) / (2 n_fit).

    A rank, not a theta join: values are counted first, so that one which many rows have is one row of the order, and
    the ranks of the values are joined back. Small value tables are broadcast, and skewed values split, by Spark.
    """
    keys = [*groups, column]
    values = df.groupBy(*keys).agg(F.sum(fit.cast("int")).alias("_fit"))
    o = ordered(values, column, groups=groups, sums={"fit": F.coalesce("_fit", F.lit(0))}, ranks=False)
    n_le, n_lt = F.col("run_fit"), F.col("run_fit") - F.coalesce("_fit", F.lit(0))
    u = S.clip((n_lt + n_le) / 2 / F.col("all_fit"), 0.0, 1.0)
    ranks = o.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), n_le.alias("n_le"), n_lt.alias("n_lt"), F.col("all_fit").alias("n_fit"), u.alias("u"))
    on = [df[k].eqNullSafe(ranks[f"_k{i}"]) for i, k in enumerate(keys)]
    return df.join(ranks, on).drop(*(f"_k{i}" for i in range(len(keys))))


def frequency(df: DataFrame, column: str, fit: Column) -> DataFrame:
    """(column, n): counts over the fit rows."""
    return df.where(fit & F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def first_codes(df: DataFrame, column: str, fit: Column, order: str) -> DataFrame:
    """(column, code): categories numbered from 0 by their first row among the fit rows."""
    first = df.where(fit & F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    return ordered(first, "_first", (column,), ranks=False).select(column, (F.col("position") - 1).alias("code"))


def standardised(df: DataFrame, columns: list[str], fit: Column) -> DataFrame:
    """df with z_<column>, by mean and population deviation of the fit rows; a deviation of 0 counts as 1."""
    stats = df.where(fit).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    z = {f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(z).drop(*(f"_{k}_{c}" for k in "ms" for c in columns))


def cell_probabilities(us: list[Column]) -> Column:
    """Array of 2^n probabilities of the bit patterns (first column: lowest bit) of independent bits with P(1) = sin^2(pi u / 2)."""
    import math

    one = [F.pow(F.sin(math.pi / 2 * u), 2) for u in us]
    each = [reduce(lambda a, b: a * b, [p if cell >> i & 1 else 1 - p for i, p in enumerate(one)]) for cell in range(1 << len(us))]
    return F.array(*each)
