"""The first rows of an order, found by counting in ever narrower ranges of its values: no sort, no task of as many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import ordered
from .staging import staged

#: Ranges of one pass; rows of a range that are put in order rather than counted again.
RANGES, FEW = 1024, 10_000


def first_rows(df: DataFrame, value: str, key: str, k: int, desc: bool = False) -> DataFrame:
    """The k first rows of df by value, then key; of rows equal in both, some.

    Values are counted in ranges, of which the one that has the k-th row is cut again, until it has FEW rows or one value
    alone. Rows before that range are kept by a filter, where they are; only the range's own rows are put in order, by
    value and key, over as many tasks as it takes. Null is lowest when rising and last when falling, NaN is the greatest
    number. Values that are not numbers are put in order at once. df is read once for each pass and must give the same rows
    each time.
    """
    if k <= 0:
        return df.limit(0)
    if not isinstance(df.schema[value].dataType, T.NumericType):
        return placed(df, value, key, k, desc)
    # numbers that differ may be one double: all decisions compare the values themselves
    rank, number = classes(value, desc), F.col(value).cast("double")
    rows, before = F.lit(False), 0
    counts = {r.c: r.n for r in df.groupBy(rank.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}  # three classes
    for c in sorted(counts):
        if before + counts[c] >= k:
            break
        rows, before = rows | (rank == c), before + counts[c]
    else:
        return df
    inside, n = rank == c, counts[c]
    if c == 1:
        low, high = df.where(inside).agg(F.min(value), F.max(value)).first()
        while n > FEW and low != high:
            edge, span = float(low), float(high) - float(low)
            if not 0 < span < float("inf"):
                break
            of = F.least(F.greatest(F.floor((number - edge) / span * RANGES), F.lit(0)), F.lit(RANGES - 1))
            bins = df.where(inside).groupBy(of.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()  # RANGES rows
            bins.sort(key=lambda r: -r.b if desc else r.b)
            reached = before
            for b in bins:
                if reached + b.n >= k:
                    break
                reached += b.n
            if b.n == n:
                break
            earlier = F.col(value) > exact(b.high, df, value) if desc else F.col(value) < exact(b.low, df, value)
            rows, before = rows | (inside & earlier), reached
            inside, n, low, high = (rank == 1) & F.col(value).between(exact(b.low, df, value), exact(b.high, df, value)), b.n, b.low, b.high
    if before + n == k:
        return df.where(rows | inside)
    return df.where(rows).unionByName(placed(df.where(inside), value, key, k - before, desc))


def classes(value: str, desc: bool) -> Column:
    """0, 1 and 2 in the order of nulls, numbers and NaN, or of NaN, numbers and nulls when falling."""
    first, last = (2, 0) if desc else (0, 2)
    return F.when(F.col(value).isNull(), first).when(F.isnan(F.col(value).cast("double")), last).otherwise(1)


def exact(x, df: DataFrame, value: str) -> Column:
    return F.lit(x).cast(df.schema[value].dataType)


def placed(df: DataFrame, value: str, key: str, k: int, desc: bool) -> DataFrame:
    """The same by positions in the whole order."""
    at = ordered(df.select(F.struct("*").alias("row"), F.col(value).alias("value"), F.col(key).alias("key")), "value", ("key",), desc=desc, ranks=False)
    return at.where(F.col("position") <= k).select("row.*")


def written_first_rows(df: DataFrame, value: str, key: str, k: int, desc: bool = False) -> DataFrame:
    """first_rows of df written once, for a df that is dear to compute."""
    return first_rows(staged(df, "selected"), value, key, k, desc)
