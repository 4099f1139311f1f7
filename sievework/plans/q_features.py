"""Queries: encoders and features."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import encode as E
from ..operators import features as X
from ..operators import sampling as P
from . import views as V
from .q_ranks import keyed_rank_sql
from .q_tables import LS, split_of
from .views import query, u_sql

R = F.round
L = ("line_scored",)
XS = [f"x{i}" for i in range(1, 9)]


@query("SELECT row_id, ((t // 3600) % 24)::INT AS hour, ((t // 86400) % 7)::INT AS weekday, round(amount - floor(amount), 6) AS decimals FROM txn", "txn")
def feat_time(spark: SparkSession, d: str) -> DataFrame:
    return V.txn(spark, d).select("row_id", S.hour_of(F.col("t")).alias("hour"), S.weekday_of(F.col("t")).alias("weekday"), R(S.fraction(F.col("amount")), 6).alias("decimals"))


@query("SELECT row_id, coalesce(n, -1) AS n FROM txn LEFT JOIN (SELECT card, count(*) AS n FROM txn WHERE row_id % 3 = 0 GROUP BY card) USING (card)", "txn")
def feat_frequency(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.contracts import dictionary_join as look_up

    rows = V.txn(spark, d)
    return look_up(rows, "card", E.frequency(rows, "card", F.col("row_id") % 3 == 0), "n", F.lit(-1)).select("row_id", "n")


@query("""SELECT row_id, coalesce(code, -1) AS code FROM txn LEFT JOIN (SELECT card, row_number() OVER (ORDER BY min(row_id)) - 1 AS code FROM txn WHERE row_id % 3 = 0 GROUP BY card) USING (card)""", "txn")
def feat_label_code(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.contracts import dictionary_join as look_up

    rows = V.txn(spark, d)
    return look_up(rows, "card", E.first_codes(rows, "card", F.col("row_id") % 3 == 0, "row_id"), "code", F.lit(-1)).select("row_id", "code")


KM = "2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(mlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(mlat)) * pow(sin(radians(mlon - lon) / 2), 2)))))"


@query(f"""WITH f AS (SELECT * FROM txn WHERE row_id % 3 <> 0), p AS (SELECT card, avg(ln(1 + amount)) AS m, coalesce(stddev_samp(ln(1 + amount)), 0) AS s FROM f GROUP BY card),
    o AS (SELECT avg(ln(1 + amount)) AS am, stddev_pop(ln(1 + amount)) AS asd, count(*) AS na FROM f), c AS (SELECT category, count(*) AS nc FROM f GROUP BY category),
    s AS (SELECT card, min(t) AS t0, count(*) AS k FROM txn GROUP BY card), g AS (SELECT row_id AS card, {KM} AS km FROM geo)
    SELECT row_id, round(ln(1 + amount), 7) AS log_amount, round(sin(2 * pi() * (t % 86400) / 86400.0), 7) + 0.0 AS hour_sin, round(cos(2 * pi() * (t % 86400) / 86400.0), 7) + 0.0 AS hour_cos,
        round((t - t0) / 86400.0, 6) AS card_age_days, round(ln(1 + coalesce(km, 0)), 5) AS log_km, round(ln(1 + k), 7) AS log_rows, round(coalesce(nc / na, 0.0), 7) AS category_rate,
        round(least(20.0, greatest(-20.0, (ln(1 + amount) - coalesce(m, am)) / greatest(coalesce(s, asd), 0.05))), 5) AS deviation
    FROM txn LEFT JOIN p USING (card) CROSS JOIN o LEFT JOIN c USING (category) JOIN s USING (card) LEFT JOIN g USING (card)""", "txn", "geo")
def feat_geo_card(spark: SparkSession, d: str) -> DataFrame:
    out = X.geo_card(V.txn(spark, d), V.geo(spark, d), F.col("row_id") % 3 != 0)
    places = {"log_km": 5, "deviation": 5, "card_age_days": 6}
    return out.select("row_id", *(R(c, places.get(c, 7)).alias(c) for c in out.columns if c != "row_id"))


@query("SELECT row_id, round(ln(1 + amount), 7) AS log_amount, round(sin(2 * pi() * (t % 86400) / 86400.0), 7) + 0.0 AS hour_sin, round(cos(2 * pi() * (t % 86400) / 86400.0), 7) + 0.0 AS hour_cos FROM txn", "txn")
def feat_shared_coords(spark: SparkSession, d: str) -> DataFrame:
    s, c = S.cyclic_hour(F.pmod("t", F.lit(86400)) / 3600)
    return V.txn(spark, d).select("row_id", R(F.log1p("amount"), 7).alias("log_amount"), R(s, 7).alias("hour_sin"), R(c, 7).alias("hour_cos"))


AUC_SQL = """WITH r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS k FROM
    (SELECT y, unnest(['x1', 'x2', 'x3', 'x4', 'x5', 'x6', 'x7', 'x8']) AS feature, unnest([x1, x2, x3, x4, x5, x6, x7, x8]) AS v FROM features)),
    a AS (SELECT feature, (sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))) AS auc FROM r GROUP BY feature)"""


@query(f"{AUC_SQL} SELECT feature, round(auc, 8) AS auc FROM a", "features")
def screen_auc(spark: SparkSession, d: str) -> DataFrame:
    return X.screen_auc(V.features(spark, d), XS, "y").withColumn("auc", R("auc", 8))


@query(f"{AUC_SQL} SELECT feature, round(abs(auc - 0.5), 8) AS gap FROM a ORDER BY round(abs(auc - 0.5), 8) DESC, feature LIMIT 3", "features")
def topk_features(spark: SparkSession, d: str) -> DataFrame:
    return X.screen_auc(V.features(spark, d), XS, "y").select("feature", R(F.abs(F.col("auc") - 0.5), 8).alias("gap")).orderBy(F.desc("gap"), "feature").limit(3)


@query("""WITH b AS (SELECT y, x6 AS c FROM features), n AS (SELECT c, y, count(*) AS k FROM b GROUP BY c, y),
    m AS (SELECT k, sum(k) OVER (PARTITION BY c) AS kx, sum(k) OVER (PARTITION BY y) AS ky, sum(k) OVER () AS ka FROM n)
    SELECT round(sum(k / ka * ln(k * ka / (kx * ky))), 8) AS mi FROM m""", "features")
def screen_mutual_info(spark: SparkSession, d: str) -> DataFrame:
    """Exact for the size, a category with few values; numeric columns would come by slices of equal count."""
    return X.mutual_information(V.features(spark, d), "x6", "y").select(R("mi", 8).alias("mi"))


def digamma_sql(n: str) -> str:
    small = ", ".join(repr(sum(1 / i for i in range(1, m)) - X.EULER) for m in range(1, 8))
    return f"CASE WHEN {n} < 8 THEN ([{small}])[{n}::INT] ELSE ln({n}) - 1 / (2 * {n}::DOUBLE) - 1 / (12 * pow({n}, 2)) + 1 / (120 * pow({n}, 4)) - 1 / (252 * pow({n}, 6)) + 1 / (240 * pow({n}, 8)) END"


NEAREST = f"""WITH v AS (SELECT row_id, y, unnest(['x1', 'x2', 'x5']) AS feature, unnest([x1, x2, x5])::DOUBLE AS x FROM features),
    o AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS ny, x - lag(x, 1) OVER w AS a1, x - lag(x, 2) OVER w AS a2, x - lag(x, 3) OVER w AS a3, lead(x, 1) OVER w - x AS b1, lead(x, 2) OVER w - x AS b2, lead(x, 3) OVER w - x AS b3
        FROM v WINDOW w AS (PARTITION BY feature, y ORDER BY x, row_id)),
    r AS (SELECT feature, row_id, x, ny, least(coalesce(a3, 1e300), greatest(coalesce(a2, 1e300), coalesce(b1, 1e300)), greatest(coalesce(a1, 1e300), coalesce(b2, 1e300)), coalesce(b3, 1e300)) AS r FROM o),
    c AS (SELECT feature, x AS at, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature ORDER BY x) AS upto FROM v GROUP BY feature, x),
    h AS (SELECT r.*, c.upto FROM r ASOF LEFT JOIN c ON r.feature = c.feature AND r.x + r.r > c.at), l AS (SELECT h.*, c.upto AS below FROM h ASOF LEFT JOIN c ON h.feature = c.feature AND h.x - h.r >= c.at),
    m AS (SELECT l.feature, ny, CASE WHEN r = 0 THEN c.n ELSE coalesce(l.upto, 0) - coalesce(below, 0) END::BIGINT AS m, count(*) OVER (PARTITION BY l.feature) AS n FROM l JOIN c ON l.feature = c.feature AND l.x = c.at)
    SELECT feature, round({digamma_sql("n")} + avg({digamma_sql("3")} - ({digamma_sql("ny")}) - ({digamma_sql("m")})), 7) AS mi FROM m GROUP BY feature, n"""


@query(NEAREST, "features")
def screen_information_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Three numeric columns by three neighbours of the own class."""
    return X.nearest_information(V.features(spark, d), ["x1", "x2", "x5"], "y", "row_id").withColumn("mi", R("mi", 7))


@query("""SELECT feature, round(var_pop(v) / pow(greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 1e-12), 2), 6) AS robust_variance FROM
    (SELECT unnest(['x1', 'x2', 'x5']) AS feature, unnest([x1, x2, x5]) AS v FROM features WHERE y = 0) GROUP BY feature""", "features")
def screen_robust_variance(spark: SparkSession, d: str) -> DataFrame:
    return X.screen_robust_variance(V.features(spark, d), ["x1", "x2", "x5"], "y").withColumn("robust_variance", R("robust_variance", 6))


@query("SELECT s_c AS value, n_below, n_at FROM (SELECT s_c, count(*) AS n_at, (sum(count(*)) OVER (ORDER BY s_c) - count(*))::BIGINT AS n_below FROM line_split WHERE split = 'train' GROUP BY s_c)", *LS)
def ecdf_fit(spark: SparkSession, d: str) -> DataFrame:
    from .ordered import ordered

    g = split_of(V.line_scored(spark, d)).where("split = 'train'").groupBy(F.col("s_c").alias("value")).agg(F.count(F.lit(1)).alias("n_at"))
    return ordered(g, "value", sums={"n": F.col("n_at")}, ranks=False).select("value", (F.col("run_n") - F.col("n_at")).alias("n_below"), "n_at")


@query("""SELECT row_id, round((n_lt + n_le) / 2.0 / n, 9) AS u FROM (SELECT row_id, split, count(*) FILTER (split = 'train') OVER (ORDER BY s_c RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_le,
    count(*) FILTER (split = 'train') OVER (ORDER BY s_c RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) FILTER (split = 'train') OVER (PARTITION BY s_c) AS n_lt,
    count(*) FILTER (split = 'train') OVER () AS n FROM line_split) WHERE split = 'test'""", *LS)
def ecdf_apply(spark: SparkSession, d: str) -> DataFrame:
    rows = split_of(V.line_scored(spark, d))
    return E.ecdf(rows, "s_c", F.col("split") == "train").where("split = 'test'").select("row_id", R("u", 9).alias("u"))


@query("SELECT row_id, (u0 > 0.5)::INT AS b0, (u1 > 0.5)::INT AS b1, (u2 > 0.5)::INT AS b2, (u3 > 0.5)::INT AS b3 FROM vectors", "vectors")
def median_bits(spark: SparkSession, d: str) -> DataFrame:
    return V.vectors(spark, d).select("row_id", *((F.col(f"u{i}") > 0.5).cast("int").alias(f"b{i}") for i in range(4)))


CELL = "(" + " * ".join(f"(CASE WHEN (cell >> {i}) & 1 = 1 THEN pow(sin(pi() / 2 * u{i}), 2) ELSE 1 - pow(sin(pi() / 2 * u{i}), 2) END)" for i in range(3)) + ")"


@query(f"SELECT row_id, cell, round({CELL}, 9) AS p FROM vectors, (SELECT unnest(range(8))::INT AS cell)", "vectors")
def cell_probability(spark: SparkSession, d: str) -> DataFrame:
    return V.vectors(spark, d).select("row_id", F.posexplode(E.cell_probabilities([F.col(f"u{i}") for i in range(3)])).alias("cell", "p")).withColumn("p", R("p", 9))


@query("""SELECT row_id, round((x1 - m1) / s1, 7) AS z_x1, round((x5 - m5) / s5, 6) AS z_x5 FROM features, (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x5) AS m5, stddev_pop(x5) AS s5 FROM features WHERE y = 0)""", "features")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    return E.standardised(V.features(spark, d), ["x1", "x5"], F.col("y") == 0).select("row_id", R("z_x1", 7).alias("z_x1"), R("z_x5", 6).alias("z_x5"))


@query("SELECT row_id, " + ", ".join([f"round(cos(pi() * u{i}), 8) AS z{i}" for i in range(3)] + [f"round(cos(pi() * u{i}) * cos(pi() * u{j}), 8) AS z{i}z{j}" for i in range(3) for j in range(i + 1, 3)]) + " FROM vectors", "vectors")
def feat_pairwise_products(spark: SparkSession, d: str) -> DataFrame:
    return V.vectors(spark, d).select("row_id", *(R(c, 8).alias(k) for k, c in X.pairwise_products(["u0", "u1", "u2"]).items()))


def _product_sql(k: int, terms: list[tuple[str, str]]) -> str:
    x = " * ".join(f"{f}(pi() * {u})" for f, u in terms)
    sign = lambda draw: f"(CASE WHEN {u_sql(k, draw, 'row_id')} < ({x} + 1) / 2 THEN 1 ELSE -1 END)"
    return f"({sign(0)} + {sign(1)}) / 2 AS r{k}"


@query("SELECT row_id, " + ", ".join(_product_sql(k, t) for k, t in enumerate(X.random_terms(["u0", "u1", "u2", "u3"], 64, 9))) + " FROM vectors", "vectors")
def feat_random_products(spark: SparkSession, d: str) -> DataFrame:
    """64 random products, read out with two draws each: a mean of two signs with the product as expectation."""
    out = V.vectors(spark, d)
    sign = lambda x, k, draw: F.when(S.keyed_uniform(k, draw, "row_id") < (x + 1) / 2, 1).otherwise(-1)
    return out.select("row_id", *(((sign(x, k, 0) + sign(x, k, 1)) / 2).alias(name) for k, (name, x) in enumerate(X.random_products(["u0", "u1", "u2", "u3"], 64, 9).items())))


MARKS_SQL = f"SELECT * FROM {keyed_rank_sql(51, 'vectors')} WHERE r <= 8"
V.VIEW_SQL["marks"] = MARKS_SQL
PROD = " * ".join(f"pow(cos(pi() * (v.u{i} - m.u{i}) / 2), 2)" for i in range(3))


def marks_of(spark: SparkSession, d: str, each: int = 8) -> DataFrame:
    return P.landmarks(V.vectors(spark, d), "row_id", each, 51)


@query(f"SELECT v.row_id, m.row_id AS mark, round({PROD}, 8) AS k FROM vectors v, marks m", "vectors", "marks")
def landmark_cross_join(spark: SparkSession, d: str) -> DataFrame:
    return X.landmark_kernel(V.vectors(spark, d), marks_of(spark, d), ["u0", "u1", "u2"], S.product_kernel).withColumn("k", R("k", 8))


@query("SELECT v.row_id, m.row_id AS mark, round(exp(-2.0 * (pow(v.u0 - m.u0, 2) + pow(v.u1 - m.u1, 2))), 8) AS k FROM vectors v, marks m", "vectors", "marks")
def feat_kernel_landmarks(spark: SparkSession, d: str) -> DataFrame:
    return X.landmark_kernel(V.vectors(spark, d), marks_of(spark, d), ["u0", "u1"], lambda u, v: S.rbf_kernel(u, v, 2.0)).withColumn("k", R("k", 8))


@query()
def feat_nystrom(spark: SparkSession, d: str) -> DataFrame:
    return X.nystrom(V.vectors(spark, d), marks_of(spark, d, 64), ["u0", "u1", "u2"], lambda u, v: S.rbf_kernel(u, v, 2.0))


@query("SELECT round(1 / (4 * var_pop(v)), 7) AS gamma FROM (SELECT unnest([u0, u1, u2, u3]) AS v FROM vectors)", "vectors")
def rbf_gamma_scale(spark: SparkSession, d: str) -> DataFrame:
    return X.gamma_scale(V.vectors(spark, d), ["u0", "u1", "u2", "u3"]).withColumn("gamma", R("gamma", 7))


@query()
def feat_cross_view_overlap(spark: SparkSession, d: str) -> DataFrame:
    return X.cross_view(V.written_features(spark, d, "row_id", "y", "x1", "x2", "x3", "x5", "x6", "x7"), ["x1", "x2", "x3"], ["x5", "x6", "x7"], F.col("y") == 0, ("row_id",))


@query("SELECT row_id, round(CASE WHEN y = 1 THEN 0.7 * u0 + 0.15 ELSE u0 END, 8) AS u0 FROM vectors", "vectors")
def bounded_shift(spark: SparkSession, d: str) -> DataFrame:
    return V.vectors(spark, d).select("row_id", R(X.bounded_shift(F.col("u0"), F.col("y"), 0.3), 8).alias("u0"))


@query("SELECT y, count(*) AS n, round(CASE WHEN y = 1 THEN 0.02 / 0.98 * (SELECT count(*) - sum(y) FROM line_scored) / (SELECT sum(y) FROM line_scored) ELSE 1 END, 9) AS weight FROM line_scored GROUP BY y", *L)
def prevalence_weight(spark: SparkSession, d: str) -> DataFrame:
    w = X.prevalence_weight(V.line_scored(spark, d), "y", 0.02)
    return w.groupBy("y").agg(F.count(F.lit(1)).alias("n"), R(F.max("weight"), 9).alias("weight"))


@query("""SELECT mask, round(sum(v * (1 - 2 * (bit_count(cell & mask) % 2))) / 8, 8) AS coefficient FROM (SELECT cell, avg(p[cell + 1]) AS v FROM patterns, (SELECT unnest(range(8)) AS cell) GROUP BY cell),
    (SELECT unnest(range(8)) AS mask) GROUP BY mask""", "patterns")
def walsh_coefficients(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.aggregates import vector_mean as mean

    cells = mean(V.patterns(spark, d), "p").select(F.col("cell").cast("long").alias("cell"), F.col("mean").alias("value"))
    return X.walsh(cells, 3).withColumn("coefficient", R("coefficient", 8))
