"""Empirical distributions and ranks of several columns at once, for tables whose rows are too many to be shuffled once a column.

Rows are packed in blocks where they are. A block sends, for each column, its distinct values in order with the numbers of
their fit rows, cut at common bounds; each range of values adds these up and sends the ranks back, and only these and
what is kept of the rows meet again, by block. A value is one entry of a block, however many of its rows have it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from .bootstrap import places_of

#: Rows of a block, marks that a block gives of a column's values, and rows of a range of values.
BLOCK, MARKS, RANGE = 1 << 15, 64, 1 << 20


def thin(rising: np.ndarray) -> bytes:
    """Rising whole numbers as their steps, byte by byte of all: the upper bytes are mostly zeros, which shrink well."""
    return np.diff(rising, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def thick(raw) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1))


def small(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers, none below zero, in as few bytes as the largest takes."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def _numbers(raw, n: int) -> np.ndarray:
    """What small has made of n numbers."""
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64)


def block_ecdf(df: DataFrame, columns: dict[str, Column], fit: Column, keep: tuple[str, ...], counts: bool = False) -> DataFrame:
    """The columns `keep` of df and, for each of the named columns (double), <name>u as `ecdf` has it: by the fit rows below, and
    up to, the value. With `counts` it is <name>n, the sum of these two counts, and n_fit. Null is lowest and NaN the
    greatest number."""
    names = list(columns)
    n = len(names)
    kept = df.select(*keep).schema
    rows = df.select(*keep, F.coalesce(fit, F.lit(False)).alias("_fit"), *(c.cast("double").alias(f"_v{i}") for i, c in enumerate(columns.values())))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, count = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            for at in range(0, t.num_rows, BLOCK):
                x = t.slice(at, BLOCK).combine_chunks()
                sink, other = pa.BufferOutputStream(), x.select(list(keep))
                with pa.ipc.new_stream(sink, other.schema) as out:
                    out.write_table(other)
                own, found = x.column("_fit").to_numpy().astype(bool), []
                for i in range(n):
                    places, of = np.unique(~places_of(x.column(f"_v{i}").combine_chunks()), return_inverse=True)
                    marks = places[(2 * np.arange(MARKS) + 1) * len(places) // (2 * MARKS)]
                    found.append((thin(places), small(np.bincount(of[own], minlength=len(places))).tobytes(), of.astype(np.uint16).tobytes(), marks.tolist()))
                arrays = [pa.array([list(c)], t) for c, t in zip(zip(*found, strict=True), [pa.list_(pa.binary())] * 3 + [pa.list_(pa.list_(pa.int64()))], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x.num_rows], pa.int64()), pa.array([int(own.sum())], pa.int64()), pa.array([sink.getvalue().to_pybytes()]), *arrays], ["rows", "fits", "kept", "places", "counts", "of", "marks"])

        def numbered() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for b in block():
                yield b.add_column(0, "block", pa.array([part + made], pa.int64()))
                made += 1

        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count >= BLOCK:
                yield from numbered()
                held, count = [], 0
        if held:
            yield from numbered()

    packed = staged(rows.mapInArrow(blocks, "block long, rows long, fits long, kept binary, places array<binary>, counts array<binary>, of array<binary>, marks array<array<long>>"), "blocks")
    sizes = packed.agg(F.sum("rows").alias("n"), F.sum("fits").alias("fits")).first()
    total, fits = sizes.n or 0, sizes.fits or 0
    ranges = max(1, math.ceil(total / RANGE))
    # MARKS marks a block and column, reduced to a bound for each range
    bounds = [np.zeros(0, np.int64)] * n
    if ranges > 1:
        marks = packed.select(F.posexplode("marks").alias("column", "m")).select("column", F.explode("m").alias("mark"))
        shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
        for r in marks.groupBy("column").agg(F.percentile_approx("mark", shares, F.lit(max(10_000, 20 * ranges))).alias("bounds")).collect():  # a row a column
            bounds[r.column] = np.unique(np.array(r.bounds, np.int64))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, every, counted in zip(b.column("block").to_pylist(), b.column("places"), b.column("counts"), strict=True):
                out = []
                for i in range(n):
                    places, numbers = thick(every[i].as_buffer()), counted[i].as_buffer()
                    width = numbers.size // len(places)
                    ends = [0, *np.searchsorted(places, bounds[i]).tolist(), len(places)]
                    out += [(block, i, at, thin(places[lo:hi]), numbers[lo * width : hi * width].to_pybytes()) for at, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if lo < hi]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "column", "range", "places", "counts"])

    def ranks(group: pa.Table) -> pa.Table:
        """For each block of a range, the fit rows of the range below and up to each of its values, as one sum, in steps."""
        places = [thick(x.as_buffer()) for x in group.column("places")]
        own = [_numbers(x.as_buffer(), len(p)) for x, p in zip(group.column("counts"), places, strict=True)]
        values, of = np.unique(np.concatenate(places), return_inverse=True)
        count = np.bincount(of, np.concatenate(own), len(values)).astype(np.int64)
        upto = np.cumsum(count)
        both, ends = (2 * upto - count)[of], np.cumsum([len(p) for p in places])[:-1]
        steps = [small(np.diff(x, prepend=0)) for x in np.split(both, ends)]
        whole = pa.array(np.full(len(places), upto[-1]))
        return pa.table([*(group.column(c) for c in ("block", "column", "range")), whole, pa.array([len(x) for x in steps], pa.int64()), pa.array([x.tobytes() for x in steps], pa.binary())], ["block", "column", "range", "whole", "n", "steps"])

    parts = max(df.sparkSession.sparkContext.defaultParallelism, n * ranges // 4)
    cut = packed.select("block", "places", "counts").mapInArrow(cuts, "block long, column int, range int, places binary, counts binary").repartition(parts, "column", "range")
    ranked = staged(cut.groupBy("column", "range").applyInArrow(ranks, "block long, column int, range int, whole long, n long, steps binary"), "ranks")
    # a row for each range
    sums = ranked.groupBy("column", "range").agg(F.max("whole").alias("w"))
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = {(r.column, r.range): r.before or 0 for r in sums.select("column", "range", F.sum("w").over(before).alias("before")).collect()}

    def unpacked(group: pa.Table) -> pa.Table:
        us, of, rest = [[] for _ in names], None, None
        at = {(c, r): i for i, (c, r) in enumerate(zip(group.column("column").to_pylist(), group.column("range").to_pylist(), strict=True))}
        for (column, place), i in sorted(at.items()):
            if column < 0:
                of, rest = group.column("of")[i], pa.ipc.open_stream(group.column("kept")[i].as_buffer()).read_all()
                continue
            steps = _numbers(group.column("steps")[i].as_buffer(), group.column("n")[i].as_py())
            us[column].append(np.cumsum(steps) + 2 * offsets[column, place])
        found = [np.concatenate(u)[np.frombuffer(of[i].as_buffer(), np.uint16)] for i, u in enumerate(us)]
        if not counts:
            found = [np.clip(u / 2 / fits, 0.0, 1.0) if fits else np.full(len(u), None, object) for u in found]
        return pa.table([*rest.columns, *(pa.array(u, kind) for u in found)], [*rest.column_names, *made])

    made, kind = [f"{c}{'n' if counts else 'u'}" for c in names], pa.int64() if counts else pa.float64()
    null = lambda kind: F.lit(None).cast(kind)
    own = packed.select("block", F.lit(-1).alias("column"), F.lit(0).alias("range"), null("long").alias("n"), null("binary").alias("steps"), "kept", "of")
    back = ranked.select("block", "column", "range", "n", "steps", null("binary").alias("kept"), null("array<binary>").alias("of"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{c}` {'long' if counts else 'double'}" for c in made)])
    parts = max(df.sparkSession.sparkContext.defaultParallelism, total // (1 << 21))
    out = own.unionByName(back).repartition(parts, "block").groupBy("block").applyInArrow(unpacked, schema)
    return out.withColumn("n_fit", F.lit(fits)) if counts else out


#: Rows of a block of rows in the order of their keys.
KEYED = 1 << 16


def ap_stable_orders(df: DataFrame, scores: dict[str, Column], label: str, key: str, name: str = "method") -> DataFrame:
    """(name, ap) of each of the scores, where each row is a step and the order of key breaks ties, as ap_stable_order has it.

    Rows are put in the order of their keys once, for all scores, and packed in blocks of that order; so of equal scores the
    rows of the earlier block come first, and in a block the earlier rows. A block sends for each score its distinct values
    with their numbers of rows, and the places of positives among these. Ranges are cut by score and block, so a score that
    most rows have is cut like others.
    """
    names = list(scores)
    columns = [c.cast("double").alias(f"_s{i}") for i, c in enumerate(scores.values())]
    rows = df.repartitionByRange(F.asc(key)).sortWithinPartitions(F.asc(key)).select(F.coalesce(F.col(label) == 1, F.lit(False)).alias("_y"), *columns)

    def packed_block(x: pa.Table, number: int) -> pa.RecordBatch:
        own, found = np.flatnonzero(x.column("_y").to_numpy()), []
        for i in range(len(names)):
            places = places_of(x.column(f"_s{i}").combine_chunks())
            order = np.argsort(places, kind="stable")
            values, n = np.unique(places, return_counts=True)
            begins, at = np.cumsum(n) - n, np.empty(len(order), np.int64)
            at[order] = np.arange(len(order))
            hits = np.sort(at[own])  # positives in the block's own order of scores
            value = np.searchsorted(begins, hits, "right") - 1
            marks = places[order][(2 * np.arange(MARKS) + 1) * len(order) // (2 * MARKS)]
            found.append((thin(values), small(n).tobytes(), small(np.bincount(value, minlength=len(values))).tobytes(), (hits - begins[value] + 1).astype(np.int32).tobytes(), marks.tolist()))
        kinds = [pa.list_(pa.binary())] * 4 + [pa.list_(pa.list_(pa.int64()))]
        arrays = [pa.array([list(c)], t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([x.num_rows], pa.int64()), *arrays], ["block", "rows", "places", "counts", "positives", "nth", "marks"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            while count >= KEYED:
                t = pa.Table.from_batches(held).combine_chunks()
                yield packed_block(t.slice(0, KEYED), number)
                number, held, count = number + 1, t.slice(KEYED).to_batches(), count - KEYED
        if count:
            yield packed_block(pa.Table.from_batches(held).combine_chunks(), number)

    packed = staged(rows.mapInArrow(blocks, "block long, rows long, places array<binary>, counts array<binary>, positives array<binary>, nth array<binary>, marks array<array<long>>"), "blocks")
    ranges = max(1, math.ceil((packed.agg(F.sum("rows")).first()[0] or 0) / RANGE))
    bounds: list[list[tuple[int, int]]] = [[] for _ in names]
    if ranges > 1:  # MARKS rows a block and score, of which every so many is a bound
        marks = packed.select("block", F.posexplode("marks").alias("column", "m")).select("column", "block", F.explode("m").alias("mark"))
        every = max(1, packed.count() * MARKS // ranges)
        nth = F.row_number().over(Window.partitionBy("column").orderBy("mark", "block"))
        for r in marks.withColumn("_n", nth).where(F.col("_n") % every == 0).select("column", "mark", "block").collect():  # a row a range and score
            bounds[r.column].append((r.mark, r.block))
        bounds = [sorted(set(b)) for b in bounds]

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *every in zip(b.column("block").to_pylist(), *(b.column(c) for c in ("places", "counts", "positives", "nth")), strict=True):
                out = []
                for i in range(len(names)):
                    places, counts, positives, nth = thick(every[0][i].as_buffer()), *(x[i].as_buffer() for x in every[1:])
                    before = np.concatenate([[0], np.cumsum(_numbers(positives, len(places)))]).tolist()
                    ends = [0, *(int(np.searchsorted(places, p, "right" if block < at else "left")) for p, at in bounds[i]), len(places)]
                    part = lambda raw, lo, hi: raw[lo * (raw.size // len(places)) : hi * (raw.size // len(places))].to_pybytes()  # noqa: B023, E731
                    for at, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                        if lo < hi:
                            out.append((block, i, at, thin(places[lo:hi]), part(counts, lo, hi), part(positives, lo, hi), nth[4 * before[lo] : 4 * before[hi]].to_pybytes()))
                kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "column", "range", "places", "counts", "positives", "nth"])

    def steps(group: pa.Table) -> pa.Table:
        """The range's rows, and the places of its positives among them."""
        group = group.sort_by("block")
        places = [thick(x.as_buffer()) for x in group.column("places")]
        n, pos = (np.concatenate([_numbers(x.as_buffer(), len(p)) for x, p in zip(group.column(c), places, strict=True)]) for c in ("counts", "positives"))
        nth = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in group.column("nth")])
        order = np.argsort(np.concatenate(places), kind="stable")
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(n[order]) - n[order]
        hits = np.sort(np.repeat(before, pos) + nth)
        first = [group.column(c)[0].as_py() for c in ("column", "range")]
        return pa.table([*(pa.array([x], pa.int32()) for x in first), *(pa.array([int(x)], pa.int64()) for x in (n.sum(), len(hits))), pa.array([thin(hits)], pa.binary())], ["column", "range", "n", "pos", "hits"])

    parts = max(df.sparkSession.sparkContext.defaultParallelism, len(names) * ranges // 4)
    cut = packed.select("block", "places", "counts", "positives", "nth").mapInArrow(cuts, "block long, column int, range int, places binary, counts binary, positives binary, nth binary")
    ranged = staged(cut.repartition(parts, "column", "range").groupBy("column", "range").applyInArrow(steps, "column int, range int, n long, pos long, hits binary"), "steps")
    before, so_far = {}, {}
    for r in sorted(ranged.select("column", "range", "n", "pos").collect(), key=lambda r: (r.column, r.range)):  # a row a range and score
        n, pos = before[r.column, r.range] = so_far.get(r.column, (0, 0))
        so_far[r.column] = n + r.n, pos + r.pos

    def precisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for column, place, raw in zip(b.column("column").to_pylist(), b.column("range").to_pylist(), b.column("hits"), strict=True):
                hits, (n, pos) = thick(raw.as_buffer()), before[column, place]
                out.append(float(((pos + 1 + np.arange(len(hits))) / (n + hits)).sum()))
            yield pa.RecordBatch.from_arrays([b.column("column"), pa.array(out, pa.float64())], ["column", "s"])

    sums = ranged.select("column", "range", "hits").mapInArrow(precisions, "column int, s double").groupBy("column").agg(F.sum("s").alias("s")).collect()  # a row a score
    return df.sparkSession.createDataFrame([(names[r.column], r.s / so_far[r.column][1] if so_far[r.column][1] else None) for r in sums], f"{name} string, ap double")
