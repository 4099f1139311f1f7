"""Operators on rows made by hand: ties, one class, empty input, nulls, and properties that hold for any partitioning."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.operators import aggregates as A
from sievework.operators import bootstrap as B
from sievework.operators import contracts as C
from sievework.operators import encode as E
from sievework.operators import metrics as M
from sievework.operators import models as L
from sievework.operators import report as T
from sievework.operators import routing as G
from sievework.operators import sampling as P
from sievework.operators import scores as K
from sievework.plans import ordered as O
from sievework.sources import scans


def scores(spark, pairs):
    return spark.createDataFrame([(i, float(s), y) for i, (s, y) in enumerate(pairs)], "row_id long, s double, y int")


def test_constant_score_gives_prevalence_and_a_half(spark):
    df = scores(spark, [(0.5, int(i < 3)) for i in range(12)])
    assert M.ap_tie_aware(df, "s", "y").first().ap == pytest.approx(0.25)
    assert M.auroc(df, "s", "y").first().auc == pytest.approx(0.5)
    assert M.ap_stable_order(df, "s", "y", "row_id").first().ap == pytest.approx(1.0)


def test_ap_and_auc_by_hand(spark):
    df = scores(spark, [(9, 1), (8, 0), (8, 1), (7, 0), (1, 1)])
    assert M.ap_tie_aware(df, "s", "y").first().ap == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert M.auroc(df, "s", "y").first().auc == pytest.approx((2 + 1.5 + 0) / 6)


def test_metrics_of_one_class_and_of_nothing(spark):
    one = scores(spark, [(1, 0), (2, 0)])
    assert M.ap_tie_aware(one, "s", "y").first().ap is None and M.auroc(one, "s", "y").first().auc is None
    none = scores(spark, [])
    assert M.ap_tie_aware(none, "s", "y", ("row_id",)).count() == 0
    assert M.confusion(none, F.col("s") > 0, "y").first().f1 == 0


def test_monotone_transform_and_partitioning_change_nothing(spark):
    rng = random.Random(1)
    df = scores(spark, [(rng.randrange(40), int(rng.random() < 0.2)) for _ in range(400)])
    want = M.ranking_metrics(df, "s", "y").first()
    for other in (df.repartition(7), df.withColumn("s", F.exp(F.col("s") / 10) - 5)):
        got = M.ranking_metrics(other, "s", "y").first()
        assert (got.ap, got.auc) == pytest.approx((want.ap, want.auc))


def test_ranges_carry_ranks_over(spark, monkeypatch):
    monkeypatch.setattr(O, "MOST_SENT", 1)
    rng = random.Random(2)
    vals = [rng.choice([None, 1.0, 2.0, 2.0, rng.random() * 100]) for _ in range(300)]
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(vals)], "id long, v double, g int").repartition(5)
    for desc in (False, True):
        got = {r.id: r for r in O.ordered(df, "v", ("id",), ("g",), desc, {"w": F.col("id")}).collect()}
        for g in range(3):
            own = [(i, v) for i, v in enumerate(vals) if i % 3 == g]
            low = lambda v: -math.inf if v is None else v
            order = sorted(own, key=lambda r: (-low(r[1]) if desc else low(r[1]), r[0]))
            run = 0
            for k, (i, v) in enumerate(order, 1):
                run += i
                assert (got[i].position, got[i].total, got[i].run_w, got[i].ties) == (k, len(own), run, sum(x == v for _, x in own))
                assert got[i].below == sum((low(x) > low(v)) if desc else (low(x) < low(v)) for _, x in own)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.999, 1.0])
def test_quantile_higher(spark, q):
    vals = [3.0, 1.0, 2.0, 2.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert A.quantile_higher(df, "v", q).first().threshold == sorted(vals)[math.ceil(q * 4 - 1e-12)]


def test_splits_cover_and_are_disjoint(spark):
    df = spark.range(101).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("t"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    chrono = {r.split: r["count"] for r in P.split_chronological(df, "t", "row_id").groupBy("split").count().collect()}
    assert chrono == {"train": 60, "val": 20, "test": 21}
    strat = P.split_stratified(df, "y", "row_id", 1)
    assert strat.count() == 101 and C.split_check(df, strat, "row_id", "y").first().asDict() == {"missing": 0, "unknown": 0, "overlapping": 0, "label_differs": 0}
    assert {r["count"] for r in P.kfold(df, "row_id", 5, 1).groupBy("fold").count().collect()} == {20, 21}
    assert P.ntile(df, "t", "row_id", 8, "w").groupBy("w").count().orderBy("w").first()["count"] == 13
    assert P.split_chronological(df.limit(0), "t", "row_id").count() == 0


def test_keyed_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    draw = lambda d: sorted(map(tuple, P.poisson_draws(d, "row_id", 3, 9).select("row_id", "draw", "weight").collect()))
    assert draw(df.repartition(1)) == draw(df.repartition(6))
    z = df.select(S.keyed_normal(1, 0, "row_id").alias("z")).agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(z.m) < 0.15 and abs(z.s - 1) < 0.1
    counts = P.multinomial_draws(df, "row_id", 4, 2).groupBy("draw").agg(F.sum("weight").alias("n")).collect()
    assert [r.n for r in counts] == [500] * 4


def test_first_codes_and_frequencies_leave_unseen_out(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (5, "new")], "row_id long, c string")
    fit = F.col("row_id") < 5
    assert {(r.c, r.code) for r in E.first_codes(df, "c", fit, "row_id").collect()} == {("b", 0), ("a", 1)}
    joined = C.dictionary_join(df, "c", E.frequency(df, "c", fit), "n", F.lit(-1))
    assert {r.row_id: r.n for r in joined.collect()} == {1: 2, 2: -1, 3: 1, 4: 2, 5: -1}


def test_card_with_one_row_has_no_deviation(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (2, 5.0)], "card long, amount double")
    got = {r.card: r for r in A.card_profile(df, "card", "amount").collect()}
    assert got[1].sd == 0.0 and got[2].sd > 0


def test_band_rerank_keeps_the_bands_scores(spark):
    df = spark.createDataFrame([(1, 0.9, 1.0), (2, 0.7, 1.0), (3, 0.6, 9.0), (4, 0.1, 99.0)], "row_id long, p double, h double")
    got = {r.row_id: r.reranked for r in G.band_rerank(df, "p", "h", 0.5, 0.8).collect()}
    assert got == {1: 0.9, 2: 0.6, 3: 0.7, 4: 0.1}
    update = C.scatter_update(df, df.where("row_id = 2").withColumn("p", F.lit(0.05)), "row_id", "p").collect()
    assert {r.row_id: r.final for r in update} == {1: 0.9, 2: 0.05, 3: 0.6, 4: 0.1} and not any(r.changed_off_band for r in update)


def test_walsh_form_equals_the_cells(spark):
    table = K.energy_table([0.3, -0.2], {(0, 1): 0.5})
    df = spark.createDataFrame([(0.1, 0.8), (0.0, 1.0), (0.5, 0.5)], "u0 double, u1 double")
    cells = E.cell_probabilities([F.col("u0"), F.col("u1")])
    direct = S.dot(cells, F.array(*map(F.lit, table)))
    for r in df.select(K.expectation([F.col("u0"), F.col("u1")], table).alias("a"), direct.alias("b")).collect():
        assert r.a == pytest.approx(r.b, abs=1e-12)
    coarse, fine = K.filter_errors(table, 1.0, 20, 0.5), K.filter_errors(table, 1.0, 400, 0.1)
    assert fine["sup_error"] < coarse["sup_error"] < 0.2


def test_holm_never_falls_and_stops_at_one(spark):
    ps = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "m string, p double")
    got = {r.m: r.adjusted for r in B.holm(ps, "m", "p").collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9})


def test_binned_and_exact_bootstrap_agree(spark):
    rng = random.Random(3)
    rows = [(f"r{i}", "m", float(rng.randrange(30)) + 10 * y, y) for i in range(800) for y in [int(rng.random() < 0.2)]]
    df = spark.createDataFrame(rows, "row_id string, method string, score double, y int")
    exact = B.interval(B.ap_draws(df, "row_id", "method", "score", "y", 60, 1), "ap").first()
    binned = B.interval(B.binned_ap_draws(df, "method", "score", "y", 60, 1), "ap").first()
    assert binned.mean == pytest.approx(exact.mean, abs=0.03) and (binned.high - binned.low) == pytest.approx(exact.high - exact.low, rel=0.5)


def test_result_diff_tells_reasons(spark):
    def leaves(rows):
        return spark.createDataFrame(rows, "path string, type string, value string, number double")

    a = leaves([("x", "double", "1.0", 1.0), ("t", "int", "1", 1.0), ("s", "string", "a", None), ("gone", "int", "1", 1.0), ("run.seconds", "double", "1", 1.0)])
    b = leaves([("x", "double", "1.1", 1.1), ("t", "string", "1", None), ("s", "string", "b", None), ("new", "int", "1", 1.0), ("run.seconds", "double", "2", 2.0)])
    assert {(r.path, r.reason) for r in T.result_diff(a, b).collect()} == {("x", "float"), ("t", "type"), ("s", "value"), ("gone", "missing"), ("new", "unexpected")}


def test_write_once_and_sealed_paths(spark, tmp_path):
    df = spark.range(5).withColumn("split", F.when(F.col("id") < 3, "train").otherwise("test"))
    scans.write_once(df, f"file://{tmp_path}/a")
    with pytest.raises(Exception, match="(?i)exists"):
        scans.write_once(df, f"file://{tmp_path}/a")
    scans.write_sealed(df, f"file://{tmp_path}/open", f"file://{tmp_path}/sealed")
    read = scans.guarded_reader(spark, (f"{tmp_path}/sealed",))
    assert read(f"file://{tmp_path}/open").count() == 3
    with pytest.raises(PermissionError):
        read(f"file://{tmp_path}/sealed/part-0")


def test_finite_methods_drop_a_whole_method(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 2.0), ("c", float("inf")), ("d", None)], "method string, score double")
    assert {r.method for r in C.finite_methods(df).collect()} == {"b"}
    assert {(r.method, r.valid) for r in scans.checked_bundle(df, 1).collect()} == {("a", False), ("b", True), ("c", False), ("d", False)}


def test_models_beat_chance(spark):
    rng = random.Random(5)
    rows = [(i, y, rng.gauss(2 * y, 1), rng.gauss(-y, 1)) for i in range(400) for y in [int(i % 5 == 0)]]
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double")
    out = L.oof(df, ["a", "b"], "y", "row_id", 4)
    assert out.count() == 400 and out.where("score IS NULL").count() == 0
    assert M.auroc(out, "score", "y").first().auc > 0.85
    forest = L.isolation_forest(df.where("y = 0"), ["a", "b"], "row_id", 20, 64)
    assert M.auroc(L.isolation_score(df, forest, ["a", "b"]), "score", "y").first().auc > 0.7
    model = L.gmm_diag(df.where("y = 0"), ["a", "b"], 2, 8)
    assert M.auroc(df.withColumn("score", -L.gmm_log_density(["a", "b"], model)), "score", "y").first().auc > 0.7
    assert [s for _, s, _ in L.guarded({"ok": lambda: 1, "bad": lambda: 1 / 0})] == ["ok", "failed"]
