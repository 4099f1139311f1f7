"""Splits and samples, all decided by keyed hashes or by position in a stated order."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.ordered import ordered
from ..plans.selection import written_first_rows


def chrono_rank(df: DataFrame, time: str, key: str) -> DataFrame:
    """df with position and total in (time, key) order."""
    return ordered(df, time, (key,), ranks=False)


def split_chronological(df: DataFrame, time: str, key: str, train: float = 0.6, val: float = 0.8) -> DataFrame:
    """df with split: the first floor(train n) rows in (time, key) order are train, up to floor(val n) val, the rest test.

    Times are counted, and only the rows of the two times at which a part ends are put in order, by key; df itself is
    filtered where it is. Where rows equal in time and key fall on both sides of an end, all rows are put in order.
    """
    counts = ordered(df.groupBy(time).agg(F.count(F.lit(1)).alias("_n")), time, sums={"n": F.col("_n")}, ranks=False)
    ends = []
    for q in (train, val):
        cut = F.floor(F.round(F.col("all_n") * q, 9))
        at = counts.where((cut > F.col("run_n") - F.col("_n")) & (cut <= F.col("run_n"))).select(time, (cut - F.col("run_n") + F.col("_n")).alias("nth"), "_n").first()
        if at is None:
            ends.append(F.lit(False))
        elif at.nth == at[2]:
            ends.append(_upto(df, time, at[0]))
        else:
            same = F.col(time).eqNullSafe(F.lit(at[0]).cast(df.schema[time].dataType))
            near = ordered(df.where(same).select(F.col(key).alias("_k")), "_k", ranks=False).where(F.col("position").isin(at.nth, at.nth + 1))
            last, after = [r[0] for r in near.orderBy("position").select("_k").collect()]
            if last == after:
                cuts = [F.floor(F.round(F.col("total") * x, 9)) for x in (train, val)]
                split = F.when(F.col("position") <= cuts[0], "train").when(F.col("position") <= cuts[1], "val").otherwise("test")
                return chrono_rank(df, time, key).withColumn("split", split).drop("position", "total")
            ends.append((_upto(df, time, at[0]) & ~same) | (same & _upto(df, key, last)))
    return df.withColumn("split", F.when(ends[0], "train").when(ends[1], "val").otherwise("test"))


def _upto(df: DataFrame, column: str, value) -> Column:
    """Which rows have the value or a lower one; null is lowest."""
    c = F.col(column)
    return c.isNull() if value is None else c.isNull() | (c <= F.lit(value).cast(df.schema[column].dataType))


def split_head(df: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    return ordered(df, key, ranks=False).withColumn("split", F.when(F.col("position") <= F.floor(F.round(F.col("total") * share, 9)), "fit").otherwise("val"))


def split_stratified(df: DataFrame, label: str, key: str, seed: int, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Per class in keyed order: round-half-even(train n) rows, then round-half-even(val n), then the rest."""
    h = shuffled(df, key, seed, (label,))
    a, b = F.bround(F.col("total") * train), F.bround(F.col("total") * val)
    return h.withColumn("split", F.when(F.col("position") <= a, "train").when(F.col("position") <= a + b, "val").otherwise("test"))


def shuffled(df: DataFrame, key: str, seed: int | str, groups: tuple[str, ...] = ()) -> DataFrame:
    """df with _u (keyed uniform) and its position and total within the groups, by _u then key."""
    return ordered(df.withColumn("_u", S.keyed_uniform(seed, 0, key)), "_u", (key,), groups, ranks=False)


def sample_stratified(df: DataFrame, label: str, key: str, size: int, seed: int) -> DataFrame:
    """`size` rows, each class with its share of them (rounded half to even)."""
    h = shuffled(df, key, seed, (label,))
    n = df.count()
    return h.where(F.col("position") <= F.bround(F.lit(float(size)) * F.col("total") / max(1, n)))


def sample_class_cap(df: DataFrame, label: str, key: str, negatives: int, seed: int) -> DataFrame:
    """All rows of label 1 and `negatives` of label 0 without replacement: the first by hash."""
    some = written_first_rows(df.where(F.col(label) == 0).withColumn("_u", S.keyed_uniform(seed, 0, key)), "_u", key, negatives).drop("_u")
    return df.where(F.col(label) == 1).unionByName(some)


def sample_minority_majority(df: DataFrame, label: str, key: str, majority: int, seed: int) -> DataFrame:
    """All rows of the smaller class (label 1 on a tie) and `majority` of the larger."""
    n1 = df.where(F.col(label) == 1).count()
    minor = 1 if n1 <= df.where(F.col(label) == 0).count() else 0
    some = written_first_rows(df.where(F.col(label) == 1 - minor).withColumn("_u", S.keyed_uniform(seed, 0, key)), "_u", key, majority).drop("_u")
    return df.where(F.col(label) == minor).unionByName(some)


def landmarks(df: DataFrame, key: str, each: int, seed: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """`each` rows per group by keyed order."""
    return shuffled(df, key, seed, groups).where(F.col("position") <= each).drop("_u", "position", "total")


def label_budget(df: DataFrame, label: str, key: str, split: str, budget: int, replicates: int) -> DataFrame:
    """(replicate, rows): for each replicate `budget` positives, four fifths from train and the rest from val with one each at
    least, and all negatives of both."""
    for_train = min(max(1, round(0.8 * budget)), budget - 1)
    reps = df.where(F.col(split).isin("train", "val")).select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    pos = reps.where(F.col(label) == 1).withColumn("_u", S.keyed_uniform("replicate", split, key))
    pos = ordered(pos, "_u", (key,), ("replicate", split), ranks=False)
    kept = pos.where(F.col("position") <= F.when(F.col(split) == "train", for_train).otherwise(budget - for_train))
    return reps.where(F.col(label) == 0).unionByName(kept.select(reps.columns))


def kfold(df: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    """df with fold in [0, folds): sizes differ by one at most."""
    return shuffled(df, key, seed).withColumn("fold", F.pmod(F.col("position") - 1, F.lit(folds)).cast("int")).drop("_u")


def rolling_origin(df: DataFrame, time: str, key: str) -> DataFrame:
    return chrono_rank(df, time, key).withColumn("half", F.when(F.col("position") <= F.floor(F.col("total") / 2), "thresholds").otherwise("evaluated"))


def ntile(df: DataFrame, value: str, key: str, k: int, name: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """df with `name`: k consecutive slices (1-based) of equal count in (value, key) order; the first ones are one row larger."""
    o = ordered(df, value, (key,), groups, ranks=False)
    size, more = F.floor(F.col("total") / k), F.col("total") % k
    head = more * (size + 1)
    i = F.col("position") - 1
    slice_ = F.when(i < head, F.floor(i / (size + 1))).otherwise(more + F.floor((i - head) / F.greatest(size, F.lit(1)))) + 1
    return o.withColumn(name, slice_.cast("int")).drop("position", "total")


def time_windows(df: DataFrame, time: str, key: str, windows: int, each: int, seed: int) -> DataFrame:
    """df's windows of equal count in time, `each` rows of each by keyed order."""
    return landmarks(ntile(df, time, key, windows, "w"), key, each, seed, ("w",))


def poisson_draws(df: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """df by draw with the Poisson(1) weight of the row in it; rows of weight 0 are left out. All methods of a row share it."""
    d = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    return d.withColumn("weight", S.keyed_poisson(seed, "draw", key)).where("weight > 0")


def multinomial_draws(df: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """Resampling with replacement of exactly n rows: slot k of a draw takes the row of rank 1 + floor(n u(draw, k))."""
    ranked = ordered(df, key, ranks=False)
    n = df.count()
    all_slots = n * draws
    parts = max(df.sparkSession.sparkContext.defaultParallelism, all_slots // 10_000_000)
    slots = df.sparkSession.range(0, all_slots, 1, parts).select(F.expr(f"id div {max(1, n)}").alias("draw"), (F.col("id") % max(1, n)).alias("id"))
    taken = slots.select("draw", (F.floor(S.keyed_uniform(seed, "draw", "id") * n) + 1).alias("position"))
    counted = taken.groupBy("draw", "position").agg(F.count(F.lit(1)).alias("weight"))
    return counted.join(ranked, "position").drop("position", "total")


def binomial_readout(p: Column, shots: int, seed, draw, key) -> Column:
    """A share of `shots` that comes out near p: normal approximation with keyed noise, clipped to [0, 1]."""
    return S.clip(p + S.keyed_normal(seed, draw, key) * F.sqrt(p * (1 - p) / shots), 0.0, 1.0)


def multinomial_counts(df: DataFrame, key: str, vector: str, shots: int, seed: int) -> DataFrame:
    """(key, cell, n): `shots` keyed draws of a cell by each row's probability vector."""
    edges = F.transform(F.sequence(F.lit(1), F.size(vector)), lambda i: S.total(F.slice(vector, F.lit(1), i)))
    s = df.select(key, edges.alias("_e"), F.explode(F.sequence(F.lit(0), F.lit(shots - 1))).alias("shot"))
    u = S.keyed_uniform(seed, "shot", key)
    cell = F.least(F.size(F.filter("_e", lambda e: e <= F.col("_u"))), F.size("_e") - 1)
    return s.withColumn("_u", u).groupBy(key, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def multinomial_cells(vector: Column, key: str, shots: int, seed: int) -> Column:
    """What multinomial_counts draws for a row, as an array of the count of each cell: no row per shot."""
    count = lambda drawn: F.transform(F.sequence(F.lit(0), F.size(vector) - 1), lambda c: F.size(F.filter(drawn, lambda x: x == c)))
    edges = F.transform(F.sequence(F.lit(1), F.size(vector)), lambda i: S.total(F.slice(vector, F.lit(1), i)))
    uniforms = F.transform(F.sequence(F.lit(0), F.lit(shots - 1)), lambda shot: S.keyed_uniform(seed, shot, key))
    # edges, uniforms and the cells drawn are each bound once
    cells = lambda e: F.transform(uniforms, lambda u: F.least(F.size(F.filter(e, lambda x: x <= u)), F.size(e) - 1))
    drawn = F.get(F.transform(F.array(edges), cells), 0)
    return F.get(F.transform(F.array(drawn), count), 0)


def shot_moments(drawn: DataFrame, key: str, vector: str, shots: int, seed: int) -> DataFrame:
    """(draw, cell, rows, s, q) of each task: its copies of rows in the draw, and the sums and sums of squares of their counts
    by cell. drawn has a row's key, weight and probability vector (of one length) by draw; each of its `weight` copies
    counts `shots` cells of its own, as multinomial_cells does for the key draw/key/copy."""
    rows = drawn.select(F.col("draw").cast("int").alias("draw"), F.col(key).cast("string").alias("key"), F.col("weight").cast("int").alias("weight"), F.col(vector).cast("array<double>").alias("p"))
    heads = [f"{seed}:{shot}:".encode() for shot in range(shots)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            draws, weights, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1).to_pylist()
            p = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            copied = np.repeat(np.arange(batch.num_rows), weights)
            edges, cells = np.cumsum(p, 1), p.shape[1]
            names = [f"{d}/{k}/{c}".encode() for d, k, w in zip(draws.tolist(), keys, weights.tolist(), strict=True) for c in range(1, w + 1)]
            for at in range(0, len(names), 4096):
                words = b"".join([md5(h + k).digest()[:4] for k in names[at : at + 4096] for h in heads])
                u = np.frombuffer(words, ">u4").reshape(-1, shots) / float(1 << 32)
                own = copied[at : at + 4096]
                # the cell is the number of edges up to u, but the last at most
                cell = np.zeros(u.shape, np.int64)
                for c in range(cells - 1):
                    cell += edges[own, c : c + 1] <= u
                n = np.bincount((np.arange(len(own))[:, None] * cells + cell).ravel(), minlength=len(own) * cells).reshape(-1, cells)
                for d in np.unique(draws[own]).tolist():
                    mine = n[draws[own] == d]
                    sums = np.stack([np.full(cells, len(mine)), mine.sum(0), (mine * mine).sum(0)])
                    found[d] = found[d] + sums if d in found else sums
        for d, (count, s, q) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), d, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), *map(pa.array, (count, s, q))], ["draw", "cell", "rows", "s", "q"])

    return rows.mapInArrow(run, "draw int, cell int, rows long, s long, q long")


def permuted_labels(df: DataFrame, key: str, label: str, permutations: int, seed: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """df by permutation, with `permuted`: as many ones as label has, on the rows that come first in keyed order."""
    reps = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("permutation"))
    reps = reps.withColumn("_u", S.keyed_uniform(seed, "permutation", key))
    o = ordered(reps, "_u", (key,), ("permutation", *groups), sums={"ones": F.col(label)}, ranks=False)
    return o.withColumn("permuted", (F.col("position") <= F.col("all_ones")).cast("int")).drop("_u", "position", "total", "run_ones", "all_ones")
