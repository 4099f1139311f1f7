"""Review bands: regions by two thresholds, re-ordering and replacing inside the band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ordered
from ..plans.selection import written_first_rows


def region(score: Column, low: float | Column, high: float | Column) -> Column:
    """above: score > high; band: low < score <= high; below: the rest."""
    return F.when(score > high, "above").when(score > low, "band").otherwise("below")


def band_rerank(df: DataFrame, score: str, head: str, low: float, high: float, key: str = "row_id") -> DataFrame:
    """df with `reranked`: inside the band the k-th best by head gets the band's own k-th best score; elsewhere the score."""
    inside = df.where((F.col(score) > low) & (F.col(score) <= high))
    by_head = ordered(inside, head, (key,), desc=True, ranks=False).select(key, "position")
    by_score = ordered(inside, score, (key,), desc=True, ranks=False).select(F.col(score).alias("_s"), "position")
    new = by_head.join(by_score, "position").select(key, "_s")
    return df.join(new, key, "left").withColumn("reranked", F.coalesce("_s", score)).drop("_s")


def splice_replace(df: DataFrame, score: str, head: str, low: float, high: float) -> DataFrame:
    """df with `spliced` (head inside the band, score elsewhere) and `crossed` (the region changed thereby)."""
    inside = region(F.col(score), low, high) == "band"
    spliced = F.when(inside, F.col(head)).otherwise(F.col(score))
    return df.withColumn("spliced", spliced).withColumn("crossed", region(F.col("spliced"), low, high) != region(F.col(score), low, high))


def with_gain(df: DataFrame, budget: int, order: str, key: str = "row_id") -> DataFrame:
    """The `budget` best rows by order, ties by key."""
    return written_first_rows(df, order, key, budget, desc=True)
