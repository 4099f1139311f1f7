"""Noisy readouts counted on their grid against the readout row by row."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.operators import metrics as M
from sievework.operators import readouts as O
from sievework.operators import sampling as P
from sievework.functions.digests import Tails
from sievework.plans import q_metrics


def test_digests():
    texts = ["", ":a", ":é" * 9, "x" * 48, "y" * 49, "z" * 55, "w" * 56, "v" * 200]
    for prefix in (b"", b"65:3", b"65:12'", b"q" * 60):
        want = [int(hashlib.md5(prefix + t.encode()).hexdigest()[:8], 16) / 2**32 for t in texts]
        assert Tails(pa.array(["cut", *texts]).slice(1)).uniforms(prefix).tolist() == want


def test_packed_counts():
    for counts in ([0] * 9, [3, 0, 255], [256, 1, 0], [70_000], [0] * 40_000 + [7, 0, 1]):
        x = O.unpacked(O.packed(np.array(counts, np.uint32)))
        assert len(x) == O.CELLS and x[: len(counts)].tolist() == counts and not x[len(counts) :].any()


@pytest.mark.parametrize("places", [3, 6])
def test_readouts_equal_rows(spark, places):
    rng = np.random.default_rng(3)
    rows = [(f"k{i}" * (1 + 9 * (i % 50 == 0)), float(np.round(rng.random(), 2)), int(rng.random() < 0.2)) for i in range(700)]
    odd = [("null p", None, 1), ("one", 1.0, 1), ("zero", 0.0, 0), ("nan", float("nan"), 0), (None, 0.5, 1), ("no label", 0.9, None)]
    df = spark.createDataFrame(rows + odd, "id string, p double, y int").repartition(3)
    got = {(r.draw, r.shots): r.ap for r in O.readout_ap(df, "id", "p", "y", [4, 90], 12, 8, places).collect()}
    long = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("draw")).select("*", F.explode(F.array(F.lit(4), F.lit(90))).alias("shots"))
    # SQL has least(1, greatest(0, null)) = 0
    score = F.when(F.col("p").isNull(), 0.0).otherwise(F.round(P.binomial_readout(F.col("p"), F.col("shots"), 8, "draw", "id"), places))
    long = long.withColumn("score", score)
    want = {(r.draw, r.shots): r.ap for r in M.ap_tie_aware(long, "score", "y", ("draw", "shots")).collect()}
    assert len(want) == 24 and got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert O.readout_ap(df.where("y = 0"), "id", "p", "y", [4], 2, 8, places).count() == 0


def test_query_multiplies_no_rows(spark):
    plan = q_metrics.shot_noise_distribution(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
