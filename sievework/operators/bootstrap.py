"""Paired bootstrap with keyed Poisson weights, and the tests, intervals and verdicts on its draws."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.staging import staged
from .metrics import ap_tie_aware

#: Draws that are read off the order of the scores together, weights that a task holds at once, and of these those made in one go.
BLOCK, WEIGHTS, CACHED = 2048, 1 << 20, 1 << 17
#: Poisson(1) has weight k where the draw's 32-bit number is at or above k of these.
CUTS = [math.ceil(c * 2**32) for c in S.POISSON_CUTS if math.ceil(c * 2**32) < 2**32]
#: Weights from this one on are rare.
COMMON = 4
#: Rows of one method, in order, that are packed into one row.
PACKED = 1 << 16
#: Rows that a task holds to put them in order by itself, rows of these for one mark, and rows of a range of the common order: a
#: SPREAD-th of all, but PACKED at least and RANGED at most.
HELD, MARKED, SPREAD, RANGED = 1 << 19, 1 << 10, 64, 1 << 20
#: Rows of a run, on average, from which runs are long.
LONG = 16
#: Bytes of a row of a piece, of a weight's two sums in a run as a rule, and how often the former the sums of all runs may take to be kept.
ROW_BYTES, RUN_BYTES, KEPT = 17, 3, 2
#: Columns of rows that are packed together; scores as places_of makes them, words and labels in the same order.
BLOCK_ROW = "method string, scores binary, words binary, labels binary"
#: Draws that are tried for one that is asked for.
DRAWN_ON = 8
#: Step of the counter from draw to draw, and the multipliers that mix 32 bits.
STEP, FIRST, SECOND = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits, mixed in place so that each bit depends on all."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(FIRST)
    x ^= x >> np.uint32(13)
    x *= np.uint32(SECOND)
    x ^= x >> np.uint32(16)
    return x


def words_of(seed: int, keys: list[str]) -> np.ndarray:
    """The first two words of the digest of seed and key: rows by 2."""
    return np.frombuffer(b"".join([hashlib.md5(f"{seed}:{k}".encode()).digest()[:8] for k in keys]), ">u4").astype(np.uint32).reshape(-1, 2)


def numbers_of(words: np.ndarray, first: int, draws: int) -> np.ndarray:
    """A number of 32 bits for each row in each of the draws from `first` on: rows by draws.

    The first word starts a counter that draws step on, and the second is mixed into what the first mixing makes of it,
    so rows share their numbers only if both words agree.
    """
    with np.errstate(over="ignore"):
        x = words[:, :1] + np.arange(first, first + draws, dtype=np.uint64).astype(np.uint32) * np.uint32(STEP)
        return mixed(mixed(x) ^ words[:, 1:])


def row_numbers(seed: int, first: int, draws: int, keys: list[str]) -> np.ndarray:
    return numbers_of(words_of(seed, keys), first, draws)


def row_weights(seed: int, first: int, draws: int, keys: list[str]) -> np.ndarray:
    """Poisson(1) weights of each row in the draws from `first` on: rows by draws."""
    return small_weights(seed, first, draws, keys).astype(float)


def small_weights(seed: int, first: int, draws: int, keys: list[str]) -> np.ndarray:
    """row_weights in bytes."""
    return weights_of(words_of(seed, keys), first, draws)


def weights_of(words: np.ndarray, first: int, draws: int) -> np.ndarray:
    """The weights of rows with these words, made in pieces that stay in a core's cache; the few from COMMON on are looked up by themselves."""
    out, size = np.empty((len(words), draws), np.uint8), max(1, CACHED // draws)
    above = np.empty((size, draws), bool)
    for at in range(0, len(words), size):
        x, w = numbers_of(words[at : at + size], first, draws), out[at : at + size]
        more = above[: len(x)]
        np.greater_equal(x, np.uint32(CUTS[0]), out=w.view(bool))
        for c in CUTS[1:COMMON]:
            np.greater_equal(x, np.uint32(c), out=more)
            w += more.view(np.uint8)
        np.greater_equal(x, np.uint32(CUTS[COMMON - 1]), out=more)
        rare = np.flatnonzero(more)
        w.reshape(-1)[rare] = np.searchsorted(CUTS, x.reshape(-1)[rare], "right")
    return out


def segments(begins: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The beginnings of runs of equal scores without those that need not be told apart: runs of negatives between the first
    and the last run, side by side, are one."""
    keep = np.logical_or.reduceat(positive, begins)
    keep[[0, -1]] = True
    starts = keep.copy()
    starts[1:] |= keep[:-1]
    return begins[starts]


def ap_draws(df: DataFrame, key: str, method: str, score: str | dict[str, Column], label: str, draws: int, seed: int) -> DataFrame:
    """(draw, method, ap) of `draws` valid draws a method: weights depend on (draw, key) alone, so methods share them.

    `score` names the column of a row's score, and `method` that of its method; or it holds by method the score that each row
    has in it, so that a row is made and its key hashed once for all methods, and `method` only names the column returned.

    A draw is valid if it has positives and negatives; others are passed over and later draws take their place, so the
    numbers of the draws may have gaps. A method that has rows of one class alone has none; one that has still too few
    after DRAWN_ON times as many draws has fewer rows here.

    The scores are put in order once, in ranges, and written in pieces: up to PACKED rows of a method, packed into one row
    of scores, labels and the words of their keys' digests. For each BLOCK of draws the pieces are then read twice: for
    the sums of weights of each piece, and, with the sums of the pieces before it, for the precisions at the ends of the
    runs of equal scores. A piece of few runs, as where positives are rare, is read and weighted once: its runs' sums are
    written too, and the precisions come from these. Rows are neither shuffled nor hashed again for that. Only a few vectors of BLOCK numbers leave
    a piece: the weighted precisions within it, and its first and last run, which the neighbouring pieces may share.
    """
    digest = F.unhex(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("None")))), 1, 16))
    wide = score if isinstance(score, dict) else {}
    scores = [c.cast("double").alias(f"score{i}") for i, c in enumerate(wide.values())] or [F.col(score).cast("double").alias("score0"), F.col(method).cast("string").alias("method")]
    placed = in_order(df.select(digest.alias("words"), F.col(label).cast("int").alias("label"), *scores), list(wide))
    kind = "string" if wide else df.schema[method].dataType.simpleString()
    classes = placed.groupBy("method").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p > 0 AND n > 0")
    able = classes.count()
    parts, first, more = [], 0, draws
    while more and first < DRAWN_ON * draws:
        for at in range(first, first + more, BLOCK):
            parts.append(staged(_block(placed, at, min(BLOCK, first + more - at)), "draws"))
        first += more
        done = reduce(lambda a, b: a.unionByName(b), parts)
        counts = [r.n for r in done.groupBy("method").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row a method
        lacks = max([draws - n for n in counts] + [draws] * (len(counts) < able), default=0)
        more = 0 if lacks <= 0 else 2 * lacks
    if not parts:
        return df.sparkSession.createDataFrame([], f"draw int, {method} {kind}, ap double")
    # a row for each draw and method
    out = done.withColumn("nth", F.row_number().over(Window.partitionBy("method").orderBy("draw"))).where(F.col("nth") <= draws)
    return out.select("draw", F.col("method").cast(kind).alias(method), "ap")


def in_order(rows: DataFrame, methods: list[str]) -> DataFrame:
    """rows (words, label, and score0, score1, ... of the methods; or, where none are named, score0 and method), from the highest
    score of a method to the lowest, in pieces: (range, method, scores, words, labels, p, n), where range numbers a method's
    pieces in their order.

    Rows are made once: each task puts those it holds in order and writes them packed, with a mark for every MARKED of
    them. The marks alone give the bounds of the ranges. Packed rows are then cut at the bounds and shuffled as they are,
    and a range is put in order from the cuts that meet in it. Rows of a score on which several bounds fall are dealt
    evenly to all the ranges that may hold it.
    """
    held, marked, most = HELD, MARKED, PACKED
    blocks = staged(rows.mapInArrow(lambda batches: _blocks(batches, methods, held, marked), BLOCK_ROW + ", marks array<long>, rows long"), "blocks")
    total = blocks.agg(F.sum("rows")).first()[0] or 0
    size = min(max(total // SPREAD, most), RANGED)
    # a row for each mark, then one for each range, then one for each method
    before = Window.partitionBy("method").orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)
    marks = blocks.select("method", F.explode("marks").alias("mark"), (F.col("rows") / F.size("marks")).alias("_n"))
    marks = marks.withColumn("_at", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0.0)) / size)).groupBy("method", "_at").agg(F.min("mark").alias("mark"))
    bounds = marks.groupBy("method").agg(F.sort_array(F.collect_list(F.when(F.col("_at") > 0, F.col("mark")))).alias("bounds"))
    ranges = F.sum(F.size("bounds") + 1).over(Window.orderBy("method").rowsBetween(Window.unboundedPreceding, -1))
    bounds = bounds.select(F.col("method").alias("_method"), "bounds", F.coalesce(ranges, F.lit(0)).alias("first"))
    cuts = blocks.drop("marks", "rows").join(F.broadcast(bounds), F.col("method").eqNullSafe(F.col("_method"))).drop("_method").mapInArrow(_cuts, "range long, " + BLOCK_ROW)
    pieces = cuts.repartition(max(1, math.ceil(total / size)), "range").groupBy("range").applyInArrow(lambda cut: _pieces(cut, most), f"range long, {BLOCK_ROW}, p long, n long")
    return staged(pieces, "order")


def places_of(scores: pa.Array) -> np.ndarray:
    """Whole numbers that rise as the scores (double) fall: NaN comes first and null last; 0 and -0 are the same."""
    x = scores.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    places = ~np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)
    if scores.null_count:
        places[scores.is_null().to_numpy(zero_copy_only=False)] = 2**63 - 1
    return places


def _blocks(batches: Iterator[pa.RecordBatch], methods: list[str], most: int, marked: int) -> Iterator[pa.RecordBatch]:
    """A row for each method among the next `most` rows or somewhat more: theirs, in order, and evenly spaced scores of them."""
    held: dict[str | None, list[tuple[np.ndarray, ...]]] = {}
    rows = 0

    def made() -> pa.RecordBatch:
        out = []
        for name, parts in held.items():
            scores, words, labels = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(scores)
            scores, n = scores[order], len(order)
            k = -(-n // marked)
            out.append((name, scores.tobytes(), words[order].tobytes(), labels[order].tobytes(), scores[(2 * np.arange(k) + 1) * n // (2 * k)], n))
        kinds = {"method": pa.string(), "scores": pa.binary(), "words": pa.binary(), "labels": pa.binary(), "marks": pa.list_(pa.int64()), "rows": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    for batch in batches:
        if not batch.num_rows:
            continue
        labels = batch.column("label").fill_null(-1).to_numpy(zero_copy_only=False)
        labels = np.where((labels == 0) | (labels == 1), labels, -1).astype(np.int8)
        # both words of a row as one number of eight bytes
        raw = batch.column("words").cast(pa.binary(8))
        words = np.frombuffer(raw.buffers()[1], ">u4")[2 * raw.offset :][: 2 * len(raw)].astype(np.uint32).view(np.uint64)
        for i, name in enumerate(methods):
            held.setdefault(name, []).append((places_of(batch.column(f"score{i}")), words, labels))
        if not methods:
            scores, code = places_of(batch.column("score0")), batch.column("method").dictionary_encode()
            index = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            order = np.argsort(index, kind="stable")
            index = index[order]
            begins = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]])).tolist()
            for lo, hi in zip(begins, [*begins[1:], len(index)], strict=True):
                at, name = order[lo:hi], None if index[lo] < 0 else code.dictionary[int(index[lo])].as_py()
                held.setdefault(name, []).append((scores[at], words[at], labels[at]))
        rows += batch.num_rows * max(1, len(methods))
        if rows >= most:
            yield made()
            held, rows = {}, 0
    if held:
        yield made()


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows: those of each range, packed. Rows on a bound that others equal are dealt evenly to the ranges around these."""
    names = ["range", "method", "scores", "words", "labels"]
    for batch in batches:
        for row in range(batch.num_rows):
            method, scores, words, labels, bounds, first = (batch.column(c)[row] for c in (*names[1:], "bounds", "first"))
            scores, words, labels = (x.as_buffer() for x in (scores, words, labels))
            places, bounds, first = np.frombuffer(scores, np.int64), bounds.values.to_numpy(zero_copy_only=False), first.as_py()
            lo, hi = (np.searchsorted(places, bounds, side) for side in ("left", "right"))
            same = np.searchsorted(bounds, bounds, "left")
            share = np.searchsorted(bounds, bounds, "right") - same + 1
            ends = [0, *(lo + (hi - lo) * (np.arange(len(bounds)) - same + 1) // share).tolist(), len(places)]
            found = [(first + i, a, b) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]
            binary = [pa.array([x[a * width : b * width].to_pybytes() for _, a, b in found], pa.binary()) for x, width in ((scores, 8), (words, 8), (labels, 1))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([method.as_py()] * len(found), pa.string()), *binary], names)


def _pieces(cut: pa.Table, most: int) -> pa.Table:
    """Of one range: a row for each piece, numbered in the order of the ranges and in them."""
    kinds = (("scores", np.int64), ("words", np.uint64), ("labels", np.int8))
    scores, words, labels = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in cut.column(c)]) for c, kind in kinds)
    order = np.argsort(scores)
    first, method, out = cut.column("range")[0].as_py() << 33, cut.column("method")[0].as_py(), []
    for nth, lo in enumerate(range(0, len(order), most)):
        at = order[lo : lo + most]
        y = labels[at]
        out.append((first + nth, method, scores[at].tobytes(), words[at].tobytes(), y.tobytes(), int((y == 1).sum()), int((y == 0).sum())))
    types = (pa.int64(), pa.string(), *[pa.binary()] * 3, pa.int64(), pa.int64())
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["range", "method", "scores", "words", "labels", "p", "n"])


def begins_of(scores: np.ndarray) -> np.ndarray:
    """Where runs of equal scores begin."""
    return np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))


def run_sums(weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the weights (rows by draws) from each beginning to the next; long runs are summed up one by one, many short ones together."""
    if len(weights) < LONG * len(begins):
        return np.add.reduceat(weights, begins, dtype=np.uint32)
    out = np.empty((len(begins), weights.shape[1]), np.uint32)
    for row, lo, hi in zip(out, begins.tolist(), [*begins[1:].tolist(), len(weights)], strict=True):
        np.add.reduce(weights[lo:hi], 0, np.uint32, row)
    return out


def _block(placed: DataFrame, first: int, draws: int) -> DataFrame:
    numbers = lambda raw: np.frombuffer(raw, float)
    size, most = max(1, WEIGHTS // draws), KEPT * ROW_BYTES

    def few(piece: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(weights, positive, scores) of a piece's rows, WEIGHTS weights at a time."""
        words, y, s = np.frombuffer(piece.words, np.uint32).reshape(-1, 2), np.frombuffer(piece.labels, np.int8) == 1, np.frombuffer(piece.scores, np.int64)
        for at in range(0, len(y), size):
            yield weights_of(words[at : at + size], first, draws), y[at : at + size], s[at : at + size]

    def runs(w: np.ndarray, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, sums of weights, of positives' weights) of the runs that need to be told apart."""
        begins = segments(begins_of(s), y)
        n = run_sums(w, begins)
        p = np.zeros_like(n)
        if y.any():
            at, firsts = np.unique(np.searchsorted(begins, np.flatnonzero(y), "right") - 1, return_index=True)
            p[at] = np.add.reduceat(w[y], firsts, dtype=np.uint32)
        return s[begins], n, p

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for piece in batch.itertuples():
                sums, parts = np.zeros((2, draws)), []
                y = np.frombuffer(piece.labels, np.int8) == 1
                keeps = len(segments(begins_of(np.frombuffer(piece.scores, np.int64)), y)) * draws * RUN_BYTES <= most * len(y)
                for w, y, s in few(piece):
                    sums += [w.sum(0, dtype=np.uint32), w[y].sum(0, dtype=np.uint32)]
                    if keeps:
                        parts.append(runs(w, y, s))
                kept = [np.concatenate(x) for x in zip(*parts, strict=True)] if keeps else []
                if keeps:  # a run may go on from one part to the next
                    begins = begins_of(kept[0])
                    kept = [kept[0][begins], *(np.add.reduceat(x, begins) for x in kept[1:])]
                # sums in as few bytes as the largest takes
                kept = [x.astype(np.min_scalar_type(x.max())).tobytes() if i else x.tobytes() for i, x in enumerate(kept)] or [None] * 3
                out.append((piece.range, piece.method, sums[0].tobytes(), sums[1].tobytes(), *kept))
            yield pd.DataFrame(out, columns=["range", "method", "n", "p", "run_scores", "run_n", "run_p"])

    def before(group: pd.DataFrame) -> pd.DataFrame:
        """Of one method: the sums of all ranges before each, and (range null) those of all ranges."""
        group = group.groupby("range")[["n", "p"]].agg(lambda raws: sum(map(numbers, raws))).sort_index()
        n, p = np.stack(group["n"].to_numpy()), np.stack(group["p"].to_numpy())
        zero = np.zeros((1, draws))
        n, p = np.concatenate([zero, np.cumsum(n, 0)]), np.concatenate([zero, np.cumsum(p, 0)])
        return pd.DataFrame({"range": [*group.index, None], "n": [x.tobytes() for x in n], "p": [x.tobytes() for x in p]}).astype({"range": "Int64"})

    def named(group: pd.DataFrame) -> pd.DataFrame:
        return before(group).assign(method=group["method"].iloc[0])

    rows = placed.select("range", "method", "scores", "words", "labels")
    sums = staged(rows.mapInPandas(totals, "range long, method string, n binary, p binary, run_scores binary, run_n binary, run_p binary"), "sums")
    offsets = staged(sums.select("range", "method", "n", "p").groupBy("method").applyInPandas(named, "range long, n binary, p binary, method string"), "offsets")

    def runs_in(piece: tuple) -> Iterator[tuple[np.ndarray, ...]]:
        """The runs of a piece, which are kept or made from its rows."""
        if hasattr(piece, "run_n"):
            s = np.frombuffer(piece.run_scores, np.int64)
            yield s, *(np.frombuffer(x, f"u{len(x) // len(s) // draws}").reshape(len(s), draws).astype(float) for x in (piece.run_n, piece.run_p))
        else:
            for w, y, s in few(piece):
                s, n, p = runs(w, y, s)
                yield s, n.astype(float), p.astype(float)

    def precisions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for piece in batch.itertuples():
                run_n, run_p, inside, held, is_first = numbers(piece.n), numbers(piece.p), np.zeros(draws), None, True
                for s, n, p in runs_in(piece):
                    if held is not None:
                        if held[0] == s[0]:
                            n[0] += held[1]
                            p[0] += held[2]
                        else:
                            n, p, s = np.vstack([held[1], n]), np.vstack([held[2], p]), np.concatenate([[held[0]], s])
                    held = (s[-1], n[-1], p[-1])
                    n, p = n[:-1], p[:-1]
                    if len(n):
                        all_n, all_p = run_n + np.cumsum(n, 0), run_p + np.cumsum(p, 0)
                        if is_first:
                            out.append(("edge", piece.method, s[0], p[0].tobytes(), all_n[0].tobytes(), all_p[0].tobytes()))
                        gain = p * all_p / np.maximum(all_n, 1)
                        inside += gain[is_first:].sum(0)
                        run_n, run_p, is_first = all_n[-1], all_p[-1], False
                # another piece may go on with the last run
                out.append(("edge", piece.method, held[0], held[2].tobytes(), (run_n + held[1]).tobytes(), (run_p + held[2]).tobytes()))
                # no null score, which would make pandas round the places to doubles
                out.append(("sum", piece.method, 0, inside.tobytes(), None, None))
            yield pd.DataFrame(out, columns=["kind", "method", "score", "p", "all_n", "all_p"])

    columns = "kind string, method string, score long, p binary, all_n binary, all_p binary"
    at = offsets.select("range", "n", "p")
    found = sums.where("run_n IS NOT NULL").select("range", "method", "run_scores", "run_n", "run_p").join(at, "range").mapInPandas(precisions, columns)
    others = sums.where("run_n IS NULL").select("range")
    if not others.isEmpty():
        found = found.unionByName(rows.join(at.join(others, "range"), "range").mapInPandas(precisions, columns))
    found = staged(found, "precisions")

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        """One run of equal scores, from the ranges that hold it."""
        p = sum(map(numbers, group["p"]))
        n, q = (np.max([numbers(x) for x in group[c]], 0) for c in ("all_n", "all_p"))
        return pd.DataFrame({"method": group["method"].iloc[:1], "p": [(p * q / np.maximum(n, 1)).tobytes()]})

    def ended(group: pd.DataFrame) -> pd.DataFrame:
        whole, rows = (numbers(group[c].dropna().iloc[0]) for c in ("whole", "rows"))
        gain = sum(map(numbers, group["p"].dropna()), np.zeros(draws))
        at = np.flatnonzero((whole > 0) & (rows > whole))
        return pd.DataFrame({"draw": first + at, "method": group["method"].iloc[0], "ap": gain[at] / whole[at]})

    edges = found.where("kind = 'edge'").groupBy("method", "score").applyInPandas(joined, "method string, p binary")
    both = edges.unionByName(found.where("kind = 'sum'").select("method", "p")).withColumns({"whole": F.lit(None).cast("binary"), "rows": F.lit(None).cast("binary")})
    both = both.unionByName(offsets.where("range IS NULL").select("method", F.lit(None).cast("binary").alias("p"), F.col("p").alias("whole"), F.col("n").alias("rows")))
    return both.groupBy("method").applyInPandas(ended, "draw int, method string, ap double")


def binned_ap_draws(df: DataFrame, method: str, score: str, label: str, draws: int, seed: int, bins: int = 1000) -> DataFrame:
    """(draw, method, ap) at a cost of draws times bins: rows are summed up by score bin and class, and a bin of n rows
    draws Poisson(n), by its normal approximation from 30 on. Exact for scores that tie within a bin; methods don't share weights."""
    span = df.groupBy(method).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    b = F.floor((F.col(score) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300)) * (bins - 1))
    g = df.join(F.broadcast(span), method).groupBy(method, b.alias("bin"), label).agg(F.count(F.lit(1)).alias("n"))
    d = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    bin_key = F.concat_ws("/", method, F.col("bin").cast("string"), F.col(label).cast("string"))
    each = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(30)).cast("int")), lambda i: S.keyed_poisson(seed, "draw", F.concat_ws("#", F.col("_k"), i.cast("string")))), F.lit(0), lambda a, x: a + x)
    many = F.greatest(F.lit(0), F.round(F.col("n") + F.sqrt("n") * S.keyed_normal(seed, "draw", "_k")).cast("int"))
    d = d.withColumn("_k", bin_key).withColumn("weight", F.when(F.col("n") < 30, each).otherwise(many)).where("weight > 0")
    return ap_tie_aware(d, "bin", label, ("draw", method), "weight").where("ap IS NOT NULL")


def interval(draws: DataFrame, value: str, groups: tuple[str, ...] = (), level: float = 0.95) -> DataFrame:
    """(groups, mean, low, high): percentile interval."""
    a = (1 - level) / 2
    p = F.percentile(value, F.array(F.lit(a), F.lit(1 - a)))
    return draws.groupBy(*groups).agg(F.avg(value).alias("mean"), p.alias("_p")).select(*groups, "mean", F.get("_p", 0).alias("low"), F.get("_p", 1).alias("high"))


def paired_deltas(draws: DataFrame, method: str, value: str, reference: str) -> DataFrame:
    """(draw, method, delta) to the reference method within each draw."""
    ref = draws.where(F.col(method) == reference).select("draw", F.col(value).alias("_ref"))
    return draws.where(F.col(method) != reference).join(ref, "draw").select("draw", method, (F.col(value) - F.col("_ref")).alias("delta"))


def centred_pvalue(deltas: DataFrame, observed: DataFrame, method: str) -> DataFrame:
    """(method, p): (1 + draws whose delta strays from the observed one by as much as that is from 0) / (draws + 1)."""
    d = deltas.join(F.broadcast(observed), method)
    return d.groupBy(method).agg(((1 + F.count_if(F.abs(F.col("delta") - F.col("observed")) >= F.abs(F.col("observed")))) / (F.count(F.lit(1)) + 1)).alias("p"))


def holm(ps: DataFrame, method: str, p: str) -> DataFrame:
    """ps with adjusted: step-down, never falling, at most 1. One row per hypothesis goes through one task."""
    order = Window.orderBy(p, method)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    raw = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1))
    return ps.withColumn("_raw", raw).withColumn("adjusted", F.max("_raw").over(order)).drop("_raw")


def least_effect(deltas: DataFrame, method: str, hypotheses: int, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """(method, se, mde): the effect found with `power` at level alpha shared by all hypotheses."""
    z = NormalDist().inv_cdf(1 - alpha / (2 * hypotheses)) + NormalDist().inv_cdf(power)
    return deltas.groupBy(method).agg(F.stddev_samp("delta").alias("se")).withColumn("mde", z * F.col("se"))


def equivalence(deltas: DataFrame, method: str, margin: float) -> DataFrame:
    """(method, low, high, equivalent): whether the 90 % interval lies within the margin."""
    i = interval(deltas, "delta", (method,), 0.9)
    return i.select(method, "low", "high", ((F.col("low") > -margin) & (F.col("high") < margin)).alias("equivalent"))


def verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, "HIGHER").when(high < 0, "LOWER").otherwise("NOT_RESOLVED")


def practical(low: Column, high: Column, margin: float) -> Column:
    return F.when((low > -margin) & (high < margin), "PRACTICAL_TIE").when(low > 0, "LEFT").when(high < 0, "RIGHT").otherwise("NOT_RESOLVED")


def gates(contrasts: DataFrame, method: str, margin: float, harm: float) -> DataFrame:
    """contrasts (method, role, mean, low, high; role candidate or control) to one row: interval excludes 0, effect of the
    margin at least, better than every control, no harm, and all of them together."""
    c = contrasts.agg(
        F.max(F.when(F.col("role") == "candidate", F.col("mean"))).alias("mean"), F.max(F.when(F.col("role") == "candidate", F.col("low"))).alias("low"),
        F.max(F.when(F.col("role") == "candidate", F.col("high"))).alias("high"), F.max(F.when(F.col("role") == "control", F.col("mean"))).alias("best_control"),
    )
    word = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    g1, g2 = (F.col("low") > 0) | (F.col("high") < 0), F.col("mean") >= margin
    g3, g4 = F.coalesce(F.col("mean") > F.col("best_control"), F.lit(True)), F.col("low") > -harm
    return c.select(word(g1).alias("interval"), word(g2).alias("size"), word(g3).alias("controls"), word(g4).alias("harm"), word(g1 & g2 & g3 & g4).alias("verdict"))


def selection_frequency(draws: DataFrame, choice: str, value: str) -> DataFrame:
    """(choice, share): how often each grid value has the best value in a draw, the smallest on ties."""
    best = draws.groupBy("draw").agg(F.max_by(choice, F.struct(F.col(value), -F.col(choice))).alias(choice))
    return best.groupBy(choice).agg(F.count(F.lit(1)).alias("_n")).join(best.agg(F.count(F.lit(1)).alias("_a"))).select(choice, (F.col("_n") / F.col("_a")).alias("share"))
