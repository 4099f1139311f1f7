"""Ranks and running sums over a global order without a window that takes all rows into one task.

Rows go to ranges of whole sort keys (groups, value, tie and at last a number of the row), whose bounds Spark samples and
compares column by column. So any type that has an order will do, and a value that most rows share or a beginning that
all texts have is cut like any other. Rows are numbered and summed up within the sorted ranges as these are written,
and one row of sums for each range and group carries the totals on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import staged

#: Rows of a table that is counted and then sent to all tasks; a larger one is joined by a shuffle.
MOST_SENT = 100_000
#: A value that more than one in HOT_SHARE of the rows have is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1_000


class Running:
    """Numbers and sums of the rows of each group, carried over the batches of a sorted range."""

    def __init__(self, groups: list[str], sums: list[str]) -> None:
        self.groups, self.sums = groups, sums
        self.group, self.rows, self.carried = None, 0, dict.fromkeys(sums, 0)

    def add(self, batch: pa.RecordBatch) -> list[pa.Array]:
        """The batch's row numbers within their groups, from 1, and the sums up to and with each row."""
        n = batch.num_rows
        new = np.zeros(n, bool)
        for g in self.groups:
            code = batch.column(g).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        first, last = (repr([batch.column(g)[i].as_py() for g in self.groups]) for i in (0, n - 1))
        goes_on, new[0] = first == self.group, True
        begins = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        number = np.arange(1, n + 1) - begins[of]
        if goes_on:
            number[of == 0] += self.rows
        out = [pa.array(number)]
        for name in self.sums:
            x = batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)
            total = np.cumsum(x)
            total = total - (total[begins] - x[begins])[of]
            if goes_on:
                total[of == 0] += self.carried[name]
            self.carried[name] = total[-1]
            out.append(pa.array(total))
        self.group, self.rows = last, number[-1]
        return out


def ranged(df: DataFrame, value: str, tie: tuple[str, ...] = (), groups: tuple[str, ...] = (), desc: bool = False, sums: tuple[str, ...] = ()) -> DataFrame:
    """df, written, with _b, its range, which never falls along the order of groups, value and tie, _p, the row's number in its
    group within the range, and _w_<c> for each of sums, its sum up to there (whole numbers as long, others as double)."""
    whole = lambda c: isinstance(df.schema[c].dataType, T.IntegralType)
    rows = df.withColumns({c: F.col(c).cast("long" if whole(c) else "double") for c in sums} | {"_at": F.monotonically_increasing_id()})
    order = [*map(F.asc, groups), F.desc(value) if desc else F.asc(value), *map(F.asc, tie), F.asc("_at")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_at").withColumn("_b", F.spark_partition_id())
    made = ["_p", *(f"_w_{c}" for c in sums)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = Running(list(groups), list(sums))
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *running.add(b)], [*b.schema.names, *made])

    schema = T.StructType(rows.schema.fields + [T.StructField("_p", T.LongType())] + [T.StructField(f"_w_{c}", rows.schema[c].dataType) for c in sums])
    return staged(rows.mapInArrow(run, schema), "ranges")


def ordered(
    df: DataFrame, value: str, tie: tuple[str, ...] = (), groups: tuple[str, ...] = (), desc: bool = False, sums: dict[str, Column] | None = None, ranks: bool = True
) -> DataFrame:
    """df with position (1-based, by value then tie; rows equal in both in any order), total, and for each of sums:
    run_<name> (up to and with this row) and all_<name>. With ranks also below (rows before this value) and ties.

    Null is lowest when rising and last when falling, NaN is the greatest number; nulls in sums count as 0.
    """
    sums = sums or {}
    rows = ranged(df.withColumns({f"_s_{k}": v for k, v in sums.items()}), value, tie, groups, desc, tuple(f"_s_{k}" for k in sums))
    last = [F.max_by(f"_w__s_{k}", "_p").alias(f"_t_{k}") for k in sums]
    per = rows.groupBy("_b", *groups).agg(F.max("_p").alias("_n"), *last)
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    parts = staged(per.select(
        F.col("_b").alias("_bb"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.coalesce(F.sum("_n").over(before), none).alias("_o"), F.sum("_n").over(whole).alias("total"),
        *(F.coalesce(F.sum(f"_t_{k}").over(before), none).alias(f"_o_{k}") for k in sums), *(F.sum(f"_t_{k}").over(whole).alias(f"all_{k}") for k in sums),
    ), "offsets")
    # a row for each range and group; a range and group has no more rows than a range
    on = [F.col("_b") == F.col("_bb"), *(F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups))]
    made = {"position": F.col("_o") + F.col("_p"), "total": F.col("total")}
    for k in sums:
        made |= {f"run_{k}": F.col(f"_o_{k}") + F.col(f"_w__s_{k}"), f"all_{k}": F.col(f"all_{k}")}
    both = rows.drop(*made).join(F.broadcast(parts) if parts.count() <= MOST_SENT else parts, on)
    out = both.select(*(c for c in df.columns if c not in made), *(c.alias(name) for name, c in made.items()))
    return ranked(out, rows, value, groups, desc) if ranks else out


def ranked(df: DataFrame, counted: DataFrame, value: str, groups: tuple[str, ...] = (), desc: bool = False) -> DataFrame:
    """df with below, the rows of `counted` before the value in its group, and ties, those that have it.

    Values are counted before they are put in order, so a value is one row there, however many rows have it. The fewer
    than HOT_SHARE hot values go to every task, the others meet their rows by a shuffle.
    """
    names = [*groups, value]
    counts = counted.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    places = ordered(counts, value, (), groups, desc, {"n": F.col("_n")}, False)
    places = places.select(*(F.col(c).alias(f"_v{i}") for i, c in enumerate(names)), (F.col("run_n") - F.col("_n")).alias("below"), F.col("_n").alias("ties"))
    places = staged(places, "places")
    total = places.agg(F.sum("ties")).first()[0] or 0
    on = [F.col(c).eqNullSafe(F.col(f"_v{i}")) for i, c in enumerate(names)]
    columns = [*df.columns, "below", "ties"]
    if places.count() <= MOST_SENT:
        return df.join(F.broadcast(places), on).select(*columns)
    is_hot = F.col("ties") * HOT_SHARE > total
    hot, cold = places.where(is_hot), places.where(~is_hot)
    return df.join(F.broadcast(hot), on).select(*columns).unionByName(df.join(F.broadcast(hot), on, "left_anti").join(cold, on).select(*columns))


def midranks(df: DataFrame, value: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """df, written, with below and ties."""
    rows = staged(df, "rows")
    return ranked(rows, rows, value, groups)
