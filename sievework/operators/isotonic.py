"""Isotonic regression by pools that merge: adjacent violators are pooled within score ranges, then at the ranges' borders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import MOST_SENT, ordered
from ..plans.staging import staged

POOL = ["low", "high", "n", "total"]


def pooled(blocks: Iterable[tuple], onto: list[tuple]) -> list[tuple]:
    """onto, a rising list of (low, high, n, total), with blocks that follow it; a mean not above the one before is pooled with it."""
    for low, high, n, total in blocks:
        while onto and onto[-1][3] * n >= total * onto[-1][2]:
            low, _, m, before = onto.pop()
            n, total = n + m, total + before
        onto.append((low, high, n, total))
    return onto


def pools(fit: DataFrame, score: str, label: str, ranges: int | None = None) -> DataFrame:
    """(low, high, n, total), written: the pools of the isotonic regression of label on score, whose means total / n rise.

    Equal scores are one block. Each range of scores is pooled in one pass; neighbouring ranges then merge two by two, and
    of a pair only the pools between the means at its border go to a task: the others can't change. Labels of 0 and 1 leave
    less than 4 n^(2/3) pools, of other means each. Rows without a score (null, NaN) or label are left out.
    """
    rows = fit.select(F.col(score).cast("double").alias("low"), F.col(label).alias("_y")).where(F.col("low").isNotNull() & ~F.isnan("low") & F.col("_y").isNotNull())
    whole = isinstance(rows.schema["_y"].dataType, T.IntegralType)
    blocks = rows.groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_y").cast("long" if whole else "double")).alias("total"))
    blocks = blocks.repartitionByRange(ranges, "low") if ranges else blocks.repartitionByRange("low")
    blocks = blocks.sortWithinPartitions("low").select("low", F.col("low").alias("high"), "n", "total", F.spark_partition_id().alias("part"))
    schema = blocks.schema

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, part = [], 0
        for b in batches:
            if len(b):
                part = int(b["part"].iloc[0])
                pooled(zip(*(b[c].tolist() for c in POOL), strict=True), found)
        if found:
            yield pd.DataFrame(found, columns=POOL).assign(part=part)

    def merged(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("low")
        both = pooled(zip(*(pair[c].tolist() for c in POOL), strict=True), [])
        return pd.DataFrame(both, columns=POOL).assign(part=int(pair["part"].iloc[0]))

    out = staged(blocks.mapInPandas(within, schema), "pools")
    most = out.agg(F.max("part")).first()[0] or 0
    while most:
        mean = F.col("total") / F.col("n")
        ends = out.groupBy("part").agg(F.min_by(mean, "low").alias("_first"), F.max_by(mean, "low").alias("_last"))
        # the other range of a pair; one row a range
        ends = ends.withColumn("part", F.col("part").bitwiseXOR(F.lit(1)))
        left = F.col("part") % 2 == 0
        at_border = F.coalesce(F.when(left, mean >= F.col("_first")).otherwise(mean <= F.col("_last")), F.lit(False))
        marked = out.join(F.broadcast(ends), "part", "left").select(*POOL, F.shiftright("part", 1).alias("part"), at_border.alias("_border"))
        # written once: the two branches read the same rows
        marked = staged(marked, "borders")
        changed = marked.where("_border").drop("_border").groupBy("part").applyInPandas(merged, schema)
        out = staged(marked.where("NOT _border").drop("_border").unionByName(changed), "pools")
        most >>= 1
    return out.drop("part")


def calibrated(df: DataFrame, found: DataFrame, score: str, most_sent: int = MOST_SENT) -> DataFrame:
    """df with calibrated: the mean of the score's pool, straight lines between pools and the end pools' means beyond.

    Up to `most_sent` counted pools go to every task; more meet their rows by number, by a shuffle. Null for a null or NaN
    score, and for all where there are no pools.
    """
    if found.count() > most_sent:
        return by_number(df, found, score)
    kept = sorted((r.low, r.high, r.total / r.n) for r in found.collect())
    x = np.array([v for low, high, _ in kept for v in (low, high)])
    y = np.array([mean for _, _, mean in kept for _ in range(2)])
    shipped = df.sparkSession.sparkContext.broadcast((x, y))
    names = [*(c for c in df.columns if c != "calibrated"), "calibrated"]
    rows = df.select(*names[:-1], F.col(score).cast("double").alias("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, (x, y) = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(float), shipped.value
            value = np.interp(at, x, y) if len(x) else np.full(len(at), np.nan)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(value, mask=np.isnan(value))], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("calibrated", T.DoubleType())]))


def by_number(df: DataFrame, found: DataFrame, score: str) -> DataFrame:
    """What calibrated gives, with pools as a table: rows and pools are put in one order, in which a row's number is that of the
    pools that begin at or below its score."""
    means = found.select("low", "high", (F.col("total") / F.col("n")).alias("mean"))
    numbered = staged(ordered(means, "low", ranks=False).select("position", "low", "high", "mean"), "numbered")
    after = numbered.select((F.col("position") - 1).alias("position"), F.col("low").alias("next_low"), F.col("mean").alias("next_mean"))
    pool = numbered.join(after, "position", "full")  # number 0 stands for what is below the first pool
    names = [c for c in df.columns if c != "calibrated"]
    at = F.col(score).cast("double")
    rows = df.select(F.struct(*names).alias("row"), F.when(~F.isnan(at), at).alias("at"))
    begins = found.select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col("low").alias("at"), F.lit(0).alias("is_row"))
    both = rows.withColumn("is_row", F.lit(1)).unionByName(begins)
    placed = ordered(both, "at", ("is_row",), sums={"pools": 1 - F.col("is_row")}, ranks=False).where("is_row = 1")
    lots = placed.select("row", "at", F.col("run_pools").alias("position")).join(pool, "position", "left")
    share = (F.col("at") - F.col("high")) / (F.col("next_low") - F.col("high"))
    between = F.col("mean") + share * (F.col("next_mean") - F.col("mean"))
    value = F.when(F.col("mean").isNull(), F.col("next_mean")).when((F.col("at") <= F.col("high")) | F.col("next_low").isNull(), F.col("mean")).otherwise(between)
    return lots.select(*(F.col("row")[c].alias(c) for c in names), F.when(F.col("at").isNotNull(), value).alias("calibrated"))
