"""Average precision over noisy readouts, counted on the grid of the rounded scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import Tails

#: Cells of the grid that are sent and summed up together.
CELLS = 1 << 16


def packed(counts: np.ndarray) -> bytes:
    """Counts of up to CELLS cells in the fewest bytes: one number a cell, or one cell number for each that is counted."""
    most = int(counts.max(initial=0))
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    if 2 * int(counts.sum()) < size * len(counts):
        return b"\0" + np.repeat(np.arange(len(counts), dtype=np.uint16), counts).tobytes()
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if raw[0] == 0:
        return np.bincount(np.frombuffer(raw, np.uint16, offset=1), minlength=CELLS)
    counts = np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)
    return np.pad(counts, (0, CELLS - len(counts)))


def readout_ap(df: DataFrame, key: str, p: str, label: str, shots: list[int], draws: int, seed: int, places: int = 6) -> DataFrame:
    """(draw, shots, ap): tie-aware average precision of binomial_readout(p, shots, seed, draw, key) rounded to `places`, in each
    of `draws` draws; none without positives. The label is 1 or 0.

    Rounded scores between 0 and 1 have 10^places + 1 values at most. A task counts its rows and positives by score, draw
    and shots, and sends these counts only, so neither rows nor scores are multiplied by draws in a shuffle. Counts of
    CELLS scores are summed up together; running sums over those above them carry the totals on.
    """
    top, one = 10**places, np.uint32(1)
    tail = F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit(":"), F.col(key).cast("string")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, positive = np.zeros((2, draws, len(shots), top + 1), np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            tails, y = Tails(batch.column("tail")), pc.fill_null(pc.equal(batch.column("y"), 1), False).to_numpy(zero_copy_only=False)
            p, none = batch.column("p").to_numpy(zero_copy_only=False), batch.column("p").is_null().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore"):
                spread = [np.sqrt(p * (1 - p) / s) for s in shots]
            for d in range(draws):
                u, v = (tails.uniforms(f"{seed}:{d}{c}".encode()) for c in ("", "'"))
                noise = np.sqrt(-2 * np.log(u + 2.0**-33)) * np.cos(2 * np.pi * v)
                for k, by in enumerate(spread):
                    # as in SQL's least(1, greatest(0, x)), no number is the greatest and null is passed over
                    score = np.clip(np.nan_to_num(p + noise * by, nan=1.0), 0.0, 1.0)
                    score[none] = 0.0
                    cell = np.floor(score * top + 0.5).astype(np.int64)
                    np.add.at(rows[d, k], cell, one)
                    np.add.at(positive[d, k], cell[y], one)
        for d in range(draws):
            for k, s in enumerate(shots):
                out = [(d, s, at // CELLS, packed(n), packed(positive[d, k, at : at + CELLS])) for at in range(0, top + 1, CELLS) if (n := rows[d, k, at : at + CELLS]).any()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*out)] or [[]] * 5, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["draw", "shots", "part", "n", "pos"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        """Of one part: its sums, and for scores with positives, best first, these and the running sums."""
        n, pos = (sum(map(unpacked, group[c]), np.zeros(CELLS, np.int64))[::-1] for c in ("n", "pos"))
        at, n, all_pos = np.flatnonzero(pos), np.cumsum(n), np.cumsum(pos)
        out = group[["draw", "shots", "part"]].iloc[:1].assign(rows=n[-1], positives=all_pos[-1])
        return out.assign(pos=[pos[at].tobytes()], run_n=[n[at].tobytes()], run_pos=[all_pos[at].tobytes()])

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = []
            for r in b.itertuples():
                pos, n, all_pos = (np.frombuffer(x, np.int64) for x in (r.pos, r.run_n, r.run_pos))
                each.append(float((pos * ((all_pos + r.pos_above) / (n + r.rows_above))).sum()))
            yield b[["draw", "shots", "positives"]].assign(gain=np.array(each, float))

    rows = df.select(tail.alias("tail"), F.col(p).cast("double").alias("p"), F.col(label).cast("int").alias("y"))
    sent = rows.mapInArrow(counted, "draw int, shots int, part int, n binary, pos binary")
    parts = sent.groupBy("draw", "shots", "part").applyInPandas(added, "draw int, shots int, part int, rows long, positives long, pos binary, run_n binary, run_pos binary")
    above = Window.partitionBy("draw", "shots").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("*", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(name) for c, name in (("rows", "rows_above"), ("positives", "pos_above"))))
    gained = parts.mapInPandas(gains, "draw int, shots int, positives long, gain double")
    return gained.groupBy("draw", "shots").agg(F.try_divide(F.sum("gain"), F.sum("positives")).alias("ap")).where("ap IS NOT NULL")
