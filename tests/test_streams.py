"""Windowed streams against the aggregation of all events at once."""

import os
from collections import defaultdict

import duckdb
import pytest

from sievework.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
DAY, STEP, GAP = 86400, 6 * 3600, 30 * 60 * 1_000_000


@pytest.fixture(scope="module")
def events():
    """(microseconds, card, amount, y) of every event."""
    return duckdb.sql(f"SELECT epoch_us(ts::TIMESTAMP), user_id, value, (event_type = 'error')::INT FROM read_parquet('{SF}/events.parquet')").fetchall()


@pytest.mark.parametrize("name, step, windows", [("stream_monitor_tumbling", DAY, 1), ("stream_monitor_sliding", STEP, DAY // STEP)])
def test_windows_hold_all_events(spark, events, name, step, windows):
    want = defaultdict(list)
    for us, _, amount, y in events:
        last = us // 1_000_000 // step * step
        for k in range(windows):
            want[last - k * step].append((amount, y))
    got = {r.start: r for r in QUERIES[name](spark, SF).collect()}
    assert sorted(got) == sorted(want)
    assert sum(r.n for r in got.values()) == windows * len(events)
    for start, rows in want.items():
        r = got[start]
        assert (r.n, r.positives) == (len(rows), sum(y for _, y in rows))
        assert r.mean_score == pytest.approx(sum(a for a, _ in rows) / len(rows))
        assert r.in_band == pytest.approx(sum(40 < a <= 80 for a, _ in rows) / len(rows))


def test_sessions_hold_all_events(spark, events):
    want, last = [], {}
    for us, card, amount, _ in sorted(events):
        if card in last and us - last[card][0] < GAP:
            last[card][1][2] += 1
            last[card][1][3] += amount
        else:
            last[card] = [us, [card, us // 1_000_000, 1, amount]]
            want.append(last[card][1])
        last[card][0] = us
    got = sorted((r.card, r.start, r.n, r.total) for r in QUERIES["stream_card_session"](spark, SF).collect())
    assert [g[:3] for g in got] == sorted(tuple(w[:3]) for w in want)
    assert sum(g[3] for g in got) == pytest.approx(sum(w[3] for w in want))


@pytest.mark.parametrize("files", [1, 7])
def test_deviations_do_not_depend_on_files_and_batches(spark, events, files):
    """Rows that come in any order and cut, with ties in time, against the rows in order."""
    import math
    import random

    from pyspark.sql import functions as F

    from sievework.plans.q_models import EVENTS
    from sievework.plans.staging import scratch
    from sievework.streaming import streams as T

    rows = [(i, us // 10_000_000 * 10_000_000, card, amount) for i, (us, card, amount, _) in enumerate(sorted(events))]
    path = scratch(spark, "events")
    df = spark.createDataFrame(random.Random(files).sample(rows, len(rows)), "row_id long, us long, card long, amount double")
    df = df.select("row_id", F.timestamp_micros("us").alias("ts"), "card", F.lit("c").alias("category"), "amount", F.lit(0).alias("y"))
    df.repartition(files).write.parquet(path)
    last = max(r[1] for r in rows)

    def close():
        end = spark.createDataFrame([(None, last + 400 * DAY * 1_000_000, None, None)], "row_id long, us long, card long, amount double")
        end.select("row_id", F.timestamp_micros("us").alias("ts"), "card", F.lit("c").alias("category"), "amount", F.lit(0).alias("y")).write.mode("append").parquet(path)

    out = T.finished(T.card_deviation(T.stream_of(spark, path, EVENTS, 1), "card", "amount", "ts", "row_id", "90 days"), "deviation", then=close)
    got = {r.row_id: (r.seen, r.deviation) for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    before = defaultdict(list)
    for i, _, card, amount in sorted(rows, key=lambda r: (r[1], r[0])):
        x, own = math.log1p(amount), before[card]
        n = len(own)
        mean = sum(own) / n if n else 0.0
        spread = math.sqrt(sum((a - mean) ** 2 for a in own) / (n - 1)) if n > 1 else 0.0
        want = max(-20, min(20, (x - mean) / max(0.05, spread))) if n else 0.0
        assert got[i][0] == n and got[i][1] == pytest.approx(want, abs=1e-6)
        own.append(x)
