"""Queries: aggregations, windows, top-k, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import contracts as C
from ..operators import sampling as P
from . import views as V
from .ordered import midranks, ordered
from .q_tables import LS, split_of
from .views import poisson_sql, query, table, u_sql

R = F.round
L = ("line_scored",)
B = ("line_scored", "score_bundle")


@query("SELECT split, count(*) AS n, sum(y) AS positives, round(avg(y), 9) AS prevalence, round((count(*) - sum(y)) / sum(y), 6) AS neg_pos_ratio FROM line_split GROUP BY split", *LS)
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    out = A.split_counts(split_of(V.line_scored(spark, d)), "split")
    return out.withColumn("prevalence", R("prevalence", 9)).withColumn("neg_pos_ratio", R("neg_pos_ratio", 6))


@query("SELECT category, count(*) AS n, round(count(*) / (SELECT count(*) FROM txn), 9) AS share FROM txn GROUP BY category", "txn")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.value_counts(V.txn(spark, d), "category").withColumn("share", R("share", 9))


@query("""SELECT card, round(avg(x), 8) AS mean, round(coalesce(stddev_samp(x), 0), 8) AS sd, (SELECT round(avg(ln(1 + amount)), 8) FROM txn WHERE category <> 'error') AS all_mean,
    (SELECT round(stddev_pop(ln(1 + amount)), 8) FROM txn WHERE category <> 'error') AS all_sd FROM (SELECT card, ln(1 + amount) AS x FROM txn WHERE category <> 'error') GROUP BY card""", "txn")
def card_profile(spark: SparkSession, d: str) -> DataFrame:
    out = A.card_profile(V.txn(spark, d).where("category <> 'error'"), "card", "amount")
    return out.select("card", *(R(c, 8).alias(c) for c in ("mean", "sd", "all_mean", "all_sd")))


@query("SELECT unnest([0.0, 0.5, 0.975, 0.999, 1.0]) AS q, unnest(list_transform(quantile_cont(s_a, [0.0, 0.5, 0.975, 0.999, 1.0]), lambda x: round(x, 6))) AS value FROM line_scored", *L)
def quantile_linear(spark: SparkSession, d: str) -> DataFrame:
    return A.quantile_linear(V.line_scored(spark, d), "s_a", [0.0, 0.5, 0.975, 0.999, 1.0]).withColumn("value", R("value", 6))


@query("""SELECT part, s_a AS threshold FROM (SELECT part, s_a, row_number() OVER (PARTITION BY part ORDER BY s_a) AS k, count(*) OVER (PARTITION BY part) AS n FROM line_scored)
    WHERE k = ceil(round(0.99 * (n - 1), 9)) + 1""", *L)
def quantile_higher(spark: SparkSession, d: str) -> DataFrame:
    return A.quantile_higher(V.line_scored(spark, d), "s_a", 0.99, ("part",))


@query("""SELECT median, iqr, round(v / (iqr * iqr), 8) AS robust_variance FROM (SELECT quantile_cont(s_a, 0.5) AS median,
    greatest(quantile_cont(s_a, 0.75) - quantile_cont(s_a, 0.25), 1e-12) AS iqr, var_pop(s_a) AS v FROM line_scored)""", *L)
def robust_spread(spark: SparkSession, d: str) -> DataFrame:
    return A.robust_spread(V.line_scored(spark, d), "s_a").withColumn("robust_variance", R("robust_variance", 8))


@query("SELECT bin, count(t.row_id) AS n FROM (SELECT unnest(range(12)) AS bin) LEFT JOIN vectors t ON kind = bin GROUP BY bin", "vectors")
def bincount(spark: SparkSession, d: str) -> DataFrame:
    return A.bincount(V.vectors(spark, d), "kind", 12)


@query("SELECT count(DISTINCT card) AS cards, count(DISTINCT t) AS times, count(DISTINCT category) AS categories FROM txn", "txn")
def count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return V.txn(spark, d).agg(F.count_distinct("card").alias("cards"), F.count_distinct("t").alias("times"), F.count_distinct("category").alias("categories"))


@query("SELECT seed, cell - 1 AS cell, round(avg(p[cell]), 9) AS mean FROM patterns, (SELECT unnest(range(1, 9)) AS cell) GROUP BY seed, cell", "patterns")
def vector_mean(spark: SparkSession, d: str) -> DataFrame:
    return A.vector_mean(V.patterns(spark, d), "p", ("seed",)).withColumn("mean", R("mean", 9))


@query(" UNION ALL ".join(f"SELECT 'x{i}' AS i, 'x{j}' AS j, round(avg(x{i}), 4) AS mean_i, round(avg(x{j}), 4) AS mean_j, round(covar_pop(x{i}, x{j}) / 1000, 2) + 0.0 AS cov_k FROM features WHERE y = 0" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j), "features")
def moments_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = A.moments(V.features(spark, d).where("y = 0"), ["x1", "x2", "x3"])
    return m.select("i", "j", R("mean_i", 4).alias("mean_i"), R("mean_j", 4).alias("mean_j"), R(F.col("cov") / 1000, 2).alias("cov_k"))


@query("""SELECT card, row_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY amount DESC, row_id) AS k FROM txn) WHERE k = 1""", "txn")
def arg_best(spark: SparkSession, d: str) -> DataFrame:
    return A.arg_best(V.txn(spark, d).select("card", "row_id", "amount"), "amount", "row_id", ("card",))


@query("""SELECT row_id, CASE WHEN count(s) = 2 THEN round(avg(s), 9) END AS score, count(s) AS n FROM (
    SELECT row_id, CASE WHEN NOT (seed = 2 AND row_id % 7 = 0) THEN p[1] END AS s FROM patterns) GROUP BY row_id""", "patterns")
def seed_mean_ensemble(spark: SparkSession, d: str) -> DataFrame:
    s = V.patterns(spark, d).withColumn("s", F.when(~((F.col("seed") == 2) & (F.col("row_id") % 7 == 0)), F.get("p", 0)))
    return A.seed_mean(s, "row_id", "s", 2).withColumn("score", R("score", 9))


@query("""SELECT card, count(*) FILTER (category <> 'error') AS done, count(*) AS n, CASE WHEN count(*) FILTER (category <> 'error') = count(*) THEN 'COMPLETE'
    WHEN count(*) FILTER (category <> 'error') > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM txn GROUP BY card""", "txn")
def seed_family_status(spark: SparkSession, d: str) -> DataFrame:
    return A.seed_status(V.txn(spark, d), "card", F.col("category") != "error")


@query("""SELECT category, round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS sd, round(quantile_cont(amount, 0.5), 6) AS median, round(quantile_cont(amount, 0.025), 6) AS low,
    round(quantile_cont(amount, 0.975), 6) AS high FROM txn GROUP BY category""", "txn")
def draw_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.draw_summary(V.txn(spark, d), "amount", ("category",)).select("category", *(R(c, 6).alias(c) for c in ("mean", "sd", "median", "low", "high")))


@query("SELECT row_id, round(avg(p[1]), 9) AS mean, list(round(p[1], 9) ORDER BY seed) AS by_seed, round(min(p[1]), 9) AS low, round(max(p[1]), 9) AS high FROM patterns GROUP BY row_id", "patterns")
def seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    x = F.get("p", 0)
    out = V.patterns(spark, d).groupBy("row_id").agg(R(F.avg(x), 9).alias("mean"), F.sort_array(F.collect_list(F.struct("seed", R(x, 9).alias("x")))).alias("s"), R(F.min(x), 9).alias("low"), R(F.max(x), 9).alias("high"))
    return out.select("row_id", "mean", F.col("s.x").alias("by_seed"), "low", "high")


@query("SELECT row_id, row_number() OVER (ORDER BY t, row_id) AS position FROM txn", "txn")
def chrono_rank(spark: SparkSession, d: str) -> DataFrame:
    return P.chrono_rank(V.txn(spark, d).select("row_id", "t"), "t", "row_id").select("row_id", "position")


@query("SELECT row_id, rank() OVER (ORDER BY s_b) + (count(*) OVER (PARTITION BY s_b) - 1) / 2.0 AS midrank FROM line_scored", *L)
def midrank(spark: SparkSession, d: str) -> DataFrame:
    return midranks(V.line_scored(spark, d).select("row_id", "s_b"), "s_b").select("row_id", (F.col("below") + (F.col("ties") + 1) / 2).alias("midrank"))


@query("""SELECT row_id, round((count(*) FILTER (split = 'train') OVER (ORDER BY s_a RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    + count(*) FILTER (split = 'train') OVER (ORDER BY s_a RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) - (split = 'train')::INT) / 2.0
    / (SELECT count(*) FROM line_split WHERE split = 'train'), 9) AS u FROM line_split""", *LS)
def ecdf_midrank(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.encode import ecdf

    rows = split_of(V.line_scored(spark, d).select("row_id", "t", "s_a"))
    return ecdf(rows.select("row_id", "s_a", "split"), "s_a", F.col("split") == "train").select("row_id", R("u", 9).alias("u"))


@query("""SELECT row_id, n_lt, n_le FROM (SELECT row_id, split, count(*) FILTER (split = 'train') OVER (ORDER BY s_c RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_le,
    count(*) FILTER (split = 'train') OVER (ORDER BY s_c RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) FILTER (split = 'train') OVER (PARTITION BY s_c) AS n_lt FROM line_split) WHERE split <> 'train'""", *LS)
def rank_range_join(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.encode import ecdf

    rows = split_of(V.line_scored(spark, d).select("row_id", "t", "s_c"))
    return ecdf(rows.select("row_id", "s_c", "split"), "s_c", F.col("split") == "train").where("split <> 'train'").select("row_id", "n_lt", "n_le")


@query("""SELECT row_id, sum(y) OVER w AS tp, row_number() OVER w AS n, round(sum(y) OVER w / row_number() OVER w, 9) AS precision FROM line_scored
    WINDOW w AS (ORDER BY s_a DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", *L)
def cum_precision(spark: SparkSession, d: str) -> DataFrame:
    o = ordered(V.line_scored(spark, d).select("row_id", "s_a", "y"), "s_a", ("row_id",), desc=True, sums={"y": F.col("y")}, ranks=False)
    return o.select("row_id", F.col("run_y").alias("tp"), F.col("position").alias("n"), R(F.col("run_y") / F.col("position"), 9).alias("precision"))


@query("SELECT s_c AS score, count(*) AS n, sum(count(*)) OVER (ORDER BY s_c DESC)::BIGINT AS last_position FROM line_scored GROUP BY s_c", *L)
def tie_group_end(spark: SparkSession, d: str) -> DataFrame:
    g = V.line_scored(spark, d).groupBy(F.col("s_c").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return ordered(g, "score", desc=True, sums={"n": F.col("n")}, ranks=False).select("score", "n", F.col("run_n").alias("last_position"))


@query("SELECT row_id, ntile(10) OVER (ORDER BY p, row_id) AS bin FROM line_scored", *L)
def equal_frequency_bins(spark: SparkSession, d: str) -> DataFrame:
    return P.ntile(V.line_scored(spark, d).select("row_id", "p"), "p", "row_id", 10, "bin").select("row_id", "bin")


@query("SELECT row_id, row_number() OVER (ORDER BY s_a DESC, row_id) AS band_position FROM line_scored WHERE p > 0.4 AND p <= 0.8", *L)
def band_rank(spark: SparkSession, d: str) -> DataFrame:
    o = ordered(V.line_scored(spark, d).where("p > 0.4 AND p <= 0.8"), "s_a", ("row_id",), desc=True, ranks=False)
    return o.select("row_id", F.col("position").alias("band_position"))


@query("""SELECT row_id, run::DOUBLE AS run FROM (SELECT row_id, sum(s_b) OVER (ORDER BY s_a DESC, row_id) AS run FROM line_scored) WHERE run <= 5000""", *L)
def cum_weight_budget(spark: SparkSession, d: str) -> DataFrame:
    o = ordered(V.line_scored(spark, d).select("row_id", "s_a", "s_b"), "s_a", ("row_id",), desc=True, sums={"w": F.col("s_b")}, ranks=False)
    return o.where("run_w <= 5000").select("row_id", F.col("run_w").alias("run"))


@query("SELECT count(*) FILTER (amount < before) AS falls FROM (SELECT amount, lag(amount) OVER (ORDER BY row_id) AS before FROM txn)", "txn")
def monotone_check(spark: SparkSession, d: str) -> DataFrame:
    return C.falls(V.txn(spark, d), "amount", "row_id")


@query("""SELECT category, w, round(max(m) OVER (PARTITION BY category ORDER BY w), 6) AS running_max FROM (SELECT category, t // 86400 AS w, avg(amount) AS m FROM txn GROUP BY 1, 2)""", "txn")
def running_max(spark: SparkSession, d: str) -> DataFrame:
    daily = V.txn(spark, d).groupBy("category", F.floor(F.col("t") / 86400).alias("w")).agg(F.avg("amount").alias("m"))
    return daily.select("category", "w", R(F.max("m").over(Window.partitionBy("category").orderBy("w")), 6).alias("running_max"))


@query("SELECT category, min(w) FILTER (m > 50) AS first_window FROM (SELECT category, t // 86400 AS w, avg(amount) AS m FROM txn GROUP BY 1, 2) GROUP BY category", "txn")
def first_detection(spark: SparkSession, d: str) -> DataFrame:
    daily = V.txn(spark, d).groupBy("category", F.floor(F.col("t") / 86400).alias("w")).agg(F.avg("amount").alias("m"))
    return daily.groupBy("category").agg(F.min(F.when(F.col("m") > 50, F.col("w"))).alias("first_window"))


@query("SELECT row_id, t, s_a FROM line_scored ORDER BY t, row_id", *L)
def stable_sort(spark: SparkSession, d: str) -> DataFrame:
    return V.line_scored(spark, d).orderBy("t", "row_id").select("row_id", "t", "s_a")


@query("SELECT row_id, t, s_c FROM line_scored ORDER BY s_c DESC, t, row_id LIMIT 1", *L)
def multi_key_pick(spark: SparkSession, d: str) -> DataFrame:
    return V.line_scored(spark, d).orderBy(F.desc("s_c"), "t", "row_id").limit(1).select("row_id", "t", "s_c")


@query("SELECT part, row_id, s_a FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY s_a DESC, row_id) AS k FROM line_scored) WHERE k <= 4", *L)
def topk_per_view(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("part").orderBy(F.desc("s_a"), "row_id")
    return V.line_scored(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 4").select("part", "row_id", "s_a")


@query("""SELECT k, count(*) AS n, sum(y) AS positives FROM (SELECT y, row_number() OVER (ORDER BY s_a DESC, row_id) AS r FROM line_scored WHERE p > 0.4 AND p <= 0.8),
    (SELECT unnest([25, 50, 100]) AS k) WHERE r <= k GROUP BY k""", *L)
def topk_budget(spark: SparkSession, d: str) -> DataFrame:
    top = V.line_scored(spark, d).where("p > 0.4 AND p <= 0.8").orderBy(F.desc("s_a"), "row_id").limit(100)
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("s_a"), "row_id")))  # at most 100 rows
    return ranked.select("y", "r", F.explode(F.array(F.lit(25), F.lit(50), F.lit(100))).alias("k")).where("r <= k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query("SELECT row_id, s_a FROM line_scored WHERE y = 1 ORDER BY s_a DESC, row_id LIMIT 5", *L)
def top_scored_positives(spark: SparkSession, d: str) -> DataFrame:
    return V.line_scored(spark, d).where("y = 1").orderBy(F.desc("s_a"), "row_id").limit(5).select("row_id", "s_a")


@query("""SELECT l_orderkey, l_linenumber, err, margin FROM (SELECT l_orderkey, l_linenumber, round(abs(l_discount - 0.05), 6) AS err, l_quantity AS margin,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY round(abs(l_discount - 0.05), 6), l_quantity DESC, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1""")
def candidate_order(spark: SparkSession, d: str) -> DataFrame:
    """Per order the line with the smallest error, then the largest margin, then the lowest index."""
    c = table(spark, d, "lineitem").withColumn("err", R(F.abs(F.col("l_discount") - 0.05), 6))
    best = F.min_by(F.struct("l_linenumber", "err", F.col("l_quantity").alias("margin")), F.struct("err", -F.col("l_quantity"), "l_linenumber", "l_partkey"))
    return c.groupBy("l_orderkey").agg(best.alias("e")).select("l_orderkey", "e.*")


CHRONO = "CASE WHEN r <= floor(round(n * 0.6, 9)) THEN 'train' WHEN r <= floor(round(n * 0.8, 9)) THEN 'val' ELSE 'test' END"


@query(f"SELECT row_id, {CHRONO} AS split FROM (SELECT row_id, row_number() OVER (ORDER BY t, row_id) AS r, count(*) OVER () AS n FROM line_scored)", *L)
def split_chronological(spark: SparkSession, d: str) -> DataFrame:
    return P.split_chronological(V.line_scored(spark, d), "t", "row_id").select("row_id", "split")


@query("SELECT row_id, CASE WHEN r <= floor(round(n * 0.8, 9)) THEN 'fit' ELSE 'val' END AS split FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS r, count(*) OVER () AS n FROM txn)", "txn")
def split_head_fraction(spark: SparkSession, d: str) -> DataFrame:
    return P.split_head(V.txn(spark, d), "row_id").select("row_id", "split")


def keyed_rank_sql(seed, source: str, part: str = "") -> str:
    by = f"PARTITION BY {part}" if part else ""
    return f"(SELECT *, row_number() OVER ({by} ORDER BY {u_sql(seed, 0, 'row_id')}, row_id) AS r, count(*) OVER ({by}) AS n FROM {source})"


@query(f"SELECT row_id, CASE WHEN r <= round_even(n * 0.6, 0) THEN 'train' WHEN r <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'val' ELSE 'test' END AS split FROM {keyed_rank_sql(31, 'line_scored', 'y')}", *L)
def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return P.split_stratified(V.line_scored(spark, d), "y", "row_id", 31).select("row_id", "split")


@query(f"SELECT row_id, y FROM {keyed_rank_sql(32, 'line_scored', 'y')} WHERE r <= round_even(2000.0::DOUBLE * n / (SELECT count(*) FROM line_scored), 0)", *L)
def sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_stratified(V.line_scored(spark, d), "y", "row_id", 2000, 32).select("row_id", "y")


@query(f"SELECT row_id, y FROM {keyed_rank_sql(33, 'line_scored', 'y')} WHERE y = 1 OR r <= 800", *L)
def sample_class_cap(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_class_cap(V.line_scored(spark, d), "y", "row_id", 800, 33).select("row_id", "y")


@query(f"SELECT row_id, y FROM {keyed_rank_sql(34, 'line_scored', 'y')} WHERE y = 1 OR r <= 256", *L)
def sample_minority_majority(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_minority_majority(V.line_scored(spark, d), "y", "row_id", 256, 34).select("row_id", "y")


@query(f"SELECT row_id, y FROM {keyed_rank_sql(35, 'line_scored', 'y')} WHERE r <= 16", *L)
def sample_landmarks(spark: SparkSession, d: str) -> DataFrame:
    return P.landmarks(V.line_scored(spark, d), "row_id", 16, 35, ("y",)).select("row_id", "y")


@query(f"""WITH e AS (SELECT *, unnest([0, 1, 2]) AS replicate FROM line_split WHERE split <> 'test'),
    k AS (SELECT *, row_number() OVER (PARTITION BY replicate, split ORDER BY {u_sql('replicate', 'split', 'row_id')}, row_id) AS r FROM e WHERE y = 1)
    SELECT replicate, split, count(*) AS n, sum(y) AS positives FROM (SELECT replicate, split, y FROM e WHERE y = 0 UNION ALL
        SELECT replicate, split, y FROM k WHERE r <= CASE WHEN split = 'train' THEN 16 ELSE 4 END) GROUP BY replicate, split""", *LS)
def label_budget(spark: SparkSession, d: str) -> DataFrame:
    out = P.label_budget(split_of(V.line_scored(spark, d)), "y", "row_id", "split", 20, 3)
    return out.groupBy("replicate", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query(f"SELECT row_id, ((r - 1) % 5)::INT AS fold FROM {keyed_rank_sql(36, 'line_scored')}", *L)
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return P.kfold(V.line_scored(spark, d), "row_id", 5, 36).select("row_id", "fold")


@query("SELECT row_id, CASE WHEN r <= n // 2 THEN 'thresholds' ELSE 'evaluated' END AS half FROM (SELECT row_id, row_number() OVER (ORDER BY t, row_id) AS r, count(*) OVER () AS n FROM line_scored)", *L)
def rolling_origin(spark: SparkSession, d: str) -> DataFrame:
    return P.rolling_origin(V.line_scored(spark, d), "t", "row_id").select("row_id", "half")


@query("""SELECT row_id, CASE WHEN r <= floor(round(n * 0.8, 9)) THEN 'fit' ELSE 'tune' END AS inner_split FROM (SELECT row_id, row_number() OVER (ORDER BY t, row_id) AS r, count(*) OVER () AS n
    FROM line_split WHERE split = 'train')""", *LS)
def split_nested_tune(spark: SparkSession, d: str) -> DataFrame:
    inner = P.split_chronological(split_of(V.line_scored(spark, d)).where("split = 'train'").drop("split"), "t", "row_id", 0.8, 1.0)
    return inner.select("row_id", F.when(F.col("split") == "train", "fit").otherwise("tune").alias("inner_split"))


@query(f"""SELECT row_id, w FROM (SELECT row_id, w, row_number() OVER (PARTITION BY w ORDER BY {u_sql(37, 0, 'row_id')}, row_id) AS k FROM
    (SELECT row_id, ntile(8) OVER (ORDER BY t, row_id)::INT AS w FROM txn)) WHERE k <= 100""", "txn")
def time_windows(spark: SparkSession, d: str) -> DataFrame:
    return P.time_windows(V.txn(spark, d), "t", "row_id", 8, 100, 37).select("row_id", "w")


@query(f"""SELECT row_id, round(sqrt(-2 * ln({u_sql(38, 0, 'row_id')} + {2.0**-33!r})) * cos(2 * pi() * {u_sql(38, "'0'''", 'row_id')}), 7) AS z FROM txn""", "txn")
def keyed_noise(spark: SparkSession, d: str) -> DataFrame:
    return V.txn(spark, d).select("row_id", R(S.keyed_normal(38, 0, "row_id"), 7).alias("z"))


@query(f"""SELECT draw, count(*) AS rows, sum(y)::BIGINT AS positives FROM (SELECT draw, floor({u_sql(39, 'draw', 'slot')} * (SELECT count(*) FROM vectors)) + 1 AS place FROM
    (SELECT unnest(range(20)) AS draw), (SELECT unnest(range((SELECT count(*) FROM vectors))) AS slot)) JOIN (SELECT y, row_number() OVER (ORDER BY row_id) AS place FROM vectors) USING (place) GROUP BY draw""", "vectors")
def bootstrap_multinomial(spark: SparkSession, d: str) -> DataFrame:
    draws = P.multinomial_draws(V.vectors(spark, d).select("row_id", "y"), "row_id", 20, 39)
    return draws.groupBy("draw").agg(F.sum("weight").alias("rows"), F.sum(F.col("weight") * F.col("y")).alias("positives"))


@query(f"""SELECT draw, sum(w)::BIGINT AS rows, sum(w * y)::BIGINT AS positives FROM (SELECT y, draw, {poisson_sql(u_sql(40, 'draw', 'row_id'))} AS w
    FROM line_scored, (SELECT unnest(range(10)) AS draw)) WHERE w > 0 GROUP BY draw HAVING sum(w * y) > 0 AND sum(w * (1 - y)) > 0""", *L)
def bootstrap_poisson(spark: SparkSession, d: str) -> DataFrame:
    draws = P.poisson_draws(V.line_scored(spark, d).select("row_id", "y"), "row_id", 10, 40)
    out = draws.groupBy("draw").agg(F.sum("weight").alias("rows"), F.sum(F.col("weight") * F.col("y")).alias("positives"))
    return out.where("positives > 0 AND positives < rows")


@query(f"""SELECT row_id, round(least(1.0, greatest(0.0, p + z * sqrt(p * (1 - p) / 256))), 7) AS readout FROM (SELECT row_id, p,
    sqrt(-2 * ln({u_sql(41, 0, 'row_id')} + {2.0**-33!r})) * cos(2 * pi() * {u_sql(41, "'0'''", 'row_id')}) AS z FROM line_scored)""", *L)
def binomial_readout(spark: SparkSession, d: str) -> DataFrame:
    return V.line_scored(spark, d).select("row_id", R(P.binomial_readout(F.col("p"), 256, 41, 0, "row_id"), 7).alias("readout"))


@query(f"""SELECT least(7, len(list_filter(edges, lambda e: e <= u)))::INT AS cell, count(*) AS n FROM (SELECT list_transform(range(1, 9), lambda k: list_sum(p[1:k])) AS edges, {u_sql(42, 'shot', 'row_id')} AS u
    FROM patterns, (SELECT unnest(range(16)) AS shot) WHERE seed = 1) GROUP BY 1""", "patterns")
def multinomial_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.multinomial_counts(V.patterns(spark, d, 1), "row_id", "p", 16, 42).groupBy("cell").agg(F.sum("n").alias("n"))


@query(f"""SELECT permutation, sum(permuted)::BIGINT AS ones, sum(permuted * row_id)::BIGINT AS id_sum FROM (SELECT permutation, row_id, (row_number() OVER (PARTITION BY permutation
    ORDER BY {u_sql(43, 'permutation', 'row_id')}, row_id) <= sum(y) OVER (PARTITION BY permutation))::INT AS permuted FROM vectors, (SELECT unnest(range(20)) AS permutation)) GROUP BY permutation""", "vectors")
def permute_labels(spark: SparkSession, d: str) -> DataFrame:
    p = P.permuted_labels(V.vectors(spark, d).select("row_id", "y"), "row_id", "y", 20, 43)
    return p.groupBy("permutation").agg(F.sum("permuted").alias("ones"), F.sum(F.col("permuted") * F.col("row_id")).alias("id_sum"))
