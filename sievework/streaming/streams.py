"""Streaming forms of the routing, monitoring and card operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.routing import region
from ..plans.staging import scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files below a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started here keep their state in RocksDB; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def finished(stream: DataFrame, name: str, mode: str = "append", then: Callable[[], None] | None = None) -> DataFrame:
    """Run the stream over what is there and return what it has written; with `then`, call it and go on with what it adds."""
    out = scratch(stream.sparkSession, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}.state").option("path", out).outputMode(mode).trigger(availableNow=True)
    with rocks(stream.sparkSession):
        writer.start().awaitTermination()
        if then is not None:
            then()
            writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def route(stream: DataFrame, score: str, low: float, high: float) -> DataFrame:
    """Stateless: each row with its region by frozen thresholds."""
    return stream.withColumn("region", region(F.col(score), low, high))


def monitor(stream: DataFrame, time: str, score: str, label: str, low: float, high: float, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Per window: rows, positives, mean score, share in the band. Rows behind the watermark are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    inside = (region(F.col(score), low, high) == "band").cast("int")
    return stream.withWatermark(time, late).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"), F.avg(score).alias("mean_score"), F.avg(inside).alias("in_band")
    ).select(F.col("w.start").alias("start"), "n", "positives", "mean_score", "in_band")


def sessions(stream: DataFrame, time: str, card: str, amount: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a card's activity: start, rows, total. The sessions still open are state; start it within `rocks`."""
    g = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), card)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total")).select(card, F.col("w.start").alias("start"), "n", "total")


def deduplicated(stream: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def card_deviation(stream: DataFrame, card: str, amount: str, time: str, key: str, late: str = "1 day") -> DataFrame:
    """(card, row_id, seen, deviation) of every row, by a stateful processor; start it within `rocks`.

    The rows of a card count in the order of time and key: a row's deviation is from all the card's rows before it, at
    least 0.05 wide and clipped to 20; the first row has 0. A row waits in its card's list state until the watermark has
    passed it, so that none can still come before it; a timer then takes those that are due, in order. So the result
    depends neither on the order of the files nor on how the rows are cut into batches. Rows behind the watermark are
    dropped, as are rows without a card or a time. State holds what came within `late`, and three sums a card.
    """

    # defined here, so that it is sent by value: the process that sets up the state may not find this package
    class Deviation(StatefulProcessor):
        """Keeps a card's waiting rows, and (n, sum, sum of squares) of the log amounts of those that were taken."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.sums = handle.getValueState("sums", "n long, s double, q double")
            self.waiting = handle.getListState("waiting", "at long, row_id long, x double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows))
            self.waiting.appendList(list(zip(batch["at"].tolist(), batch["row_id"].tolist(), batch["x"].tolist(), strict=True)))
            # the first moment at which one of these rows is due; timers that are no longer needed find nothing due
            self.handle.registerTimer(int(batch["at"].min()) // 1000 + 1)
            yield pd.DataFrame({"card": [], "row_id": [], "seen": [], "deviation": []})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            rows = sorted(tuple(r) for r in self.waiting.get())
            due = [r for r in rows if r[0] // 1000 < now]
            left = rows[len(due) :]
            if not due:
                return
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(left[0][0] // 1000 + 1)
            else:
                self.waiting.clear()
            n, s, q = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0)
            x = np.array([r[2] for r in due])
            before = np.arange(n, n + len(x))
            sums, squares = s + np.concatenate([[0.0], np.cumsum(x)]), q + np.concatenate([[0.0], np.cumsum(x * x)])
            mean = sums[:-1] / np.maximum(before, 1)
            spread = np.sqrt(np.maximum(0.0, squares[:-1] - before * mean * mean) / np.maximum(before - 1, 1))
            deviation = np.clip((x - mean) / np.maximum(0.05, np.where(before > 1, spread, 0.0)), -20, 20)
            self.sums.update((n + len(x), float(sums[-1]), float(squares[-1])))
            yield pd.DataFrame({"card": key[0], "row_id": [r[1] for r in due], "seen": before, "deviation": np.where(before > 0, deviation, 0.0)})

        def close(self) -> None:
            pass

    rows = stream.withWatermark(time, late).select(F.col(time).alias("when"), F.col(card).alias("card"), F.col(key).alias("row_id"), F.unix_micros(time).alias("at"), F.log1p(amount).alias("x"))
    rows = rows.where("`when` IS NOT NULL").withColumns({"card": F.coalesce("card", F.lit(NO_CARD)), "row_id": F.coalesce("row_id", F.lit(0)), "x": F.coalesce("x", F.lit(0.0))})
    out = rows.groupBy("card").transformWithStateInPandas(Deviation(), "card long, row_id long, seen long, deviation double", "append", "EventTime")
    return out.where(F.col("card") != NO_CARD)


#: Stands for a missing card, whose rows are left out; they still move the watermark.
NO_CARD = -(1 << 63)


def psi_windows(stream: DataFrame, time: str, bin_of: Column, reference: dict[int, float], width: str, late: str = "1 day", eps: float = 1e-6) -> DataFrame:
    """(start, n, psi) of each window of event time as it closes: the population stability index of its histogram over the
    bins of a frozen reference (bin to share). The histograms are the stream's state; shares below eps count as eps."""
    bins = sorted(reference)
    counts = [F.count_if(F.col("_bin") == b).alias(f"_n{i}") for i, b in enumerate(bins)]
    binned = stream.withWatermark(time, late).withColumn("_bin", bin_of)
    windows = binned.groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), *counts)

    def term(i: int, share: float) -> Column:
        p, q = F.greatest(F.col(f"_n{i}") / F.col("n"), F.lit(eps)), max(share, eps)
        return (p - q) * F.ln(p / q)

    total = sum((term(i, reference[b]) for i, b in enumerate(bins)), F.lit(0.0))
    return windows.select(F.col("w.start").alias("start"), "n", total.alias("psi"))
