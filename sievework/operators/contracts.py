"""Data contracts: counts, keys, domains, split membership, time sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def ingest_manifest(df: DataFrame, split: str = "split", label: str = "y", time: str = "t", sealed: str = "test") -> DataFrame:
    """Rows, positives, rate, first and last time of each split; of the sealed one rows only."""
    shown = lambda c: F.when(F.first(split) != sealed, c)
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), shown(F.sum(label)).alias("positives"), shown(F.avg(label)).alias("rate"), shown(F.min(time)).alias("t_min"), shown(F.max(time)).alias("t_max")
    )


def row_contract(df: DataFrame, key: str, label: str, unit: list[str]) -> DataFrame:
    """(check, violations): repeated or null keys, labels other than 0 and 1, values that are not finite or not in [0, 1]."""
    keyed = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col(label).isin(0, 1) | F.col(label).isNull()).alias("label"),
        *(F.count_if(~S.finite(F.col(c))).alias(f"f_{c}") for c in unit), *(F.count_if((F.col(c) < 0) | (F.col(c) > 1)).alias(f"u_{c}") for c in unit),
    )
    one = keyed.agg(
        F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise(0)).alias("null_key"), F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1).otherwise(0)).alias("repeated_key"),
        F.sum("label").alias("label_not_binary"), *(F.sum(f"f_{c}").alias(f"not_finite_{c}") for c in unit), *(F.sum(f"u_{c}").alias(f"outside_unit_{c}") for c in unit),
    )
    return unpivot(one, one.columns, "check", "violations")


def unpivot(df: DataFrame, columns: list[str], name: str, value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.unpivot(list(keep), columns, name, value)


def split_check(source: DataFrame, parts: DataFrame, key: str, label: str) -> DataFrame:
    """One row: keys missing from the splits, unknown to the source, in more than one split, and labels that differ."""
    each = parts.groupBy(key).agg(F.count_distinct("split").alias("splits"), F.max(label).alias("part_label"))
    both = source.select(key, label, F.lit(1).alias("s")).join(each.withColumn("p", F.lit(1)), key, "full")
    return both.agg(
        F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("unknown"), F.count_if(F.col("splits") > 1).alias("overlapping"),
        F.count_if((F.col("p") == 1) & (F.col("s") == 1) & ~F.col(label).eqNullSafe(F.col("part_label"))).alias("label_differs"),
    )


def time_source_check(rows: DataFrame, other: DataFrame, key: str, order: str, tolerance: float) -> DataFrame:
    """One row: how `other` (key, t, y, amount) agrees with `rows`, and whether its time ever falls along `order`.

    Time falls somewhere exactly when a bucket's first time is below an earlier bucket's last or falls within one.
    """
    near = F.abs(F.col("a.amount") - F.col("b.amount")) <= tolerance
    joined = rows.alias("a").join(other.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"))
    agree = joined.agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("a.y") == F.col("b.y")).alias("labels_match"), F.count_if(near).alias("amounts_match"))
    shape = other.agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count_distinct("t").alias("times"))
    return shape.join(agree).join(falls(other, "t", order))


def falls(df: DataFrame, value: str, order: str, width: int = 4096) -> DataFrame:
    """One row, falls: steps at which value decreases in the order of an integer column.

    Windows run over `width` ids; of each only its first and last value and its count go on, to windows over `width` of
    those, and so on, so that the last window has a row for every width^3 ids.
    """
    parts = df.select(F.col(order).alias("_k"), F.lit(0).cast("long").alias("n"), F.col(value).alias("first"), F.col(value).alias("last"))
    for _ in range(3):
        parts = parts.withColumn("_g", F.floor(F.col("_k") / width))
        step = F.col("first") < F.lag("last").over(Window.partitionBy("_g").orderBy("_k"))
        steps = parts.withColumn("_d", F.coalesce(step.cast("long"), F.lit(0)))
        parts = steps.groupBy("_g").agg(F.sum(F.col("n") + F.col("_d")).alias("n"), F.min_by("first", "_k").alias("first"), F.max_by("last", "_k").alias("last")).withColumnRenamed("_g", "_k")
    across = (F.col("first") < F.lag("last").over(Window.orderBy("_k"))).cast("long")
    return parts.withColumn("edge", across).agg((F.coalesce(F.sum("n"), F.lit(0)) + F.coalesce(F.sum("edge"), F.lit(0))).alias("falls"))


def finite_methods(scores: DataFrame) -> DataFrame:
    """Scores of the methods whose scores are all finite."""
    good = scores.groupBy("method").agg(F.bool_and(S.finite(F.col("score"))).alias("ok")).where("ok").select("method")
    return scores.join(F.broadcast(good), "method", "left_semi")


def scatter_update(base: DataFrame, band: DataFrame, key: str, score: str) -> DataFrame:
    """base with `final`: the band's new score where a row is in the band, the old one bit for bit elsewhere; `changed_off_band` flags a breach."""
    new = band.select(key, F.col(score).alias("_new"), F.lit(True).alias("_in"))
    out = base.join(new, key, "left").withColumn("final", F.when(F.col("_in"), F.col("_new")).otherwise(F.col(score)))
    return out.withColumn("changed_off_band", F.col("_in").isNull() & ~F.col("final").eqNullSafe(F.col(score))).drop("_new", "_in")


def dictionary_join(df: DataFrame, column: str, pairs: DataFrame, value: str, default: Column, most_broadcast: int = 100_000) -> DataFrame:
    """df with `value` looked up by column in pairs (column, value); misses and nulls get default. Only a dictionary of at
    most most_broadcast rows is broadcast."""
    small = pairs.limit(most_broadcast + 1).count() <= most_broadcast
    d = pairs.select(F.col(column).alias("_key"), F.col(value).alias("_value"))
    return df.join(F.broadcast(d) if small else d, df[column] == F.col("_key"), "left").withColumn(value, F.coalesce("_value", default)).drop("_key", "_value")
