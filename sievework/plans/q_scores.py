"""Queries: closed-form scores, drift."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import drift as D
from ..operators import encode as E
from ..operators import metrics as M
from ..operators import sampling as P
from ..operators import scores as C
from . import views as V
from .q_features import marks_of
from .q_metrics import ap_sql
from .q_ranks import keyed_rank_sql
from .q_tables import LS, split_of
from .views import query, u_sql

R = F.round
U3 = ["u0", "u1", "u2"]
A3, B3 = [0.4, -0.3, 0.2], {(0, 1): 0.25, (0, 2): -0.15, (1, 2): 0.1}
TABLE = C.energy_table(A3, B3)
FILTER = [math.exp(-2 * 1.5 * e) for e in TABLE]
VEC = ("vectors",)


def energy_sql(s: list[str]) -> str:
    return "-(" + " + ".join([f"{a} * {x}" for a, x in zip(A3, s, strict=True)] + [f"{w} * {s[i]} * {s[j]}" for (i, j), w in B3.items()]) + ")"


PROB = ["pow(sin(pi() / 2 * u{0}), 2)".format(i) for i in range(3)]


def cells_sql(table: list[float]) -> str:
    """Sum over cells of probability times table value: the definition, not the Walsh form."""
    return " + ".join(repr(v) + " * " + " * ".join(PROB[i] if c >> i & 1 else f"(1 - {PROB[i]})" for i in range(3)) for c, v in enumerate(table))


def us(names: list[str] = U3):
    return [F.col(u) for u in names]


@query("SELECT row_id, round(" + energy_sql([f"(1 - 2 * (u{i} > 0.5)::INT)" for i in range(3)]) + ", 9) AS energy FROM vectors", *VEC)
def energy_hard(spark: SparkSession, d: str) -> DataFrame:
    return V.vectors(spark, d).select("row_id", R(C.energy(C.hard_signs([(u > 0.5).cast("int") for u in us()]), A3, B3), 9).alias("energy"))


@query("SELECT cell, round(v, 9) AS energy, count(*) AS rows FROM vectors JOIN (SELECT unnest(range(8))::INT AS cell, unnest([" + ", ".join(map(repr, TABLE)) + "]) AS v) ON cell = (u0 > 0.5)::INT + 2 * (u1 > 0.5)::INT + 4 * (u2 > 0.5)::INT GROUP BY cell, v", *VEC)
def energy_table(spark: SparkSession, d: str) -> DataFrame:
    """The normalised table, and how many rows lie in each cell."""
    cell = C.add([(u > 0.5).cast("int") * (1 << i) for i, u in enumerate(us())])
    rows = V.vectors(spark, d).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("cell", R(F.get(F.array(*map(F.lit, TABLE)), F.col("cell")), 9).alias("energy"), "rows")


@query("SELECT row_id, round(" + energy_sql([f"cos(pi() * u{i})" for i in range(3)]) + ", 9) AS energy FROM vectors", *VEC)
def energy_soft(spark: SparkSession, d: str) -> DataFrame:
    return V.vectors(spark, d).select("row_id", R(C.energy(C.soft_signs(us()), A3, B3), 9).alias("energy"))


@query(f"SELECT row_id, round(-({cells_sql(FILTER)}), 9) AS score FROM vectors", *VEC)
def score_filter_expectation(spark: SparkSession, d: str) -> DataFrame:
    return V.vectors(spark, d).select("row_id", R(C.filter_score(us(), TABLE, 1.5), 9).alias("score"))


CAUCHY = [sum(w * math.cos(3.0 * e * t) for t, w in C.cauchy_nodes(40, 0.25)) for e in TABLE]


@query(f"SELECT row_id, round(-({cells_sql(CAUCHY)}), 9) AS score FROM vectors", *VEC)
def score_cauchy_filter(spark: SparkSession, d: str) -> DataFrame:
    return V.vectors(spark, d).select("row_id", R(C.cauchy_score(us(), TABLE, 1.5), 9).alias("score"))


CELLS = ", ".join(" * ".join(PROB[i] if c >> i & 1 else f"(1 - {PROB[i]})" for i in range(3)) for c in range(8))


@query(f"""WITH e AS (SELECT row_id, y, unnest(range(8)) AS cell, unnest([{CELLS}]) AS p FROM vectors), m AS (SELECT cell, ln(greatest(avg(p), 1e-12)) AS l FROM e WHERE y = 0 GROUP BY cell)
    SELECT row_id, round(-sum(p * l), 8) AS score FROM e JOIN m USING (cell) GROUP BY row_id""", *VEC)
def score_cell_density(spark: SparkSession, d: str) -> DataFrame:
    return C.cell_density(V.vectors(spark, d), E.cell_probabilities(us()), F.col("y") == 0).select("row_id", R("score", 8).alias("score"))


BITS = " + ".join(f"(CASE WHEN {u_sql(f"'71.{i}'", 'draw', 'row_id')} < {PROB[i]} THEN {1 << i} ELSE 0 END)" for i in range(3))
LIST = "[" + ", ".join(map(repr, FILTER)) + "]"


@query(f"SELECT row_id, round(avg({LIST}[({BITS}) + 1]), 8) AS estimate FROM vectors, (SELECT unnest(range(32)) AS draw) GROUP BY row_id", *VEC)
def mc_expectation(spark: SparkSession, d: str) -> DataFrame:
    return C.monte_carlo(V.vectors(spark, d), U3, FILTER, 32, 71).withColumn("estimate", R("estimate", 8))


CBITS = " + ".join(f"(CASE WHEN {u_sql(f"'72.{i}'", 'draw', 'row_id')} < {PROB[i]} THEN {1 << i} ELSE 0 END)" for i in range(3))


@query(f"""SELECT round(regr_slope(ln(rmse), ln(n)), 6) AS slope FROM (SELECT n, sqrt(avg(pow(estimate - exact, 2))) AS rmse FROM (SELECT n, row_id, avg({LIST}[({CBITS}) + 1]) AS estimate, max({cells_sql(FILTER)}) AS exact
    FROM vectors, (SELECT unnest([4, 16, 64]) AS n), (SELECT unnest(range(64)) AS draw) WHERE draw < n GROUP BY n, row_id) GROUP BY n)""", *VEC)
def mc_convergence(spark: SparkSession, d: str) -> DataFrame:
    """Slope of ln RMSE on ln N of the estimate; near -1/2."""
    rows = V.vectors(spark, d).withColumn("exact", C.expectation(us(), FILTER)).select("row_id", *U3, "exact")
    out = None
    for n in (4, 16, 64):
        e = C.monte_carlo(rows, U3, FILTER, n, 72).join(rows, "row_id").agg(F.sqrt(F.avg(F.pow(F.col("estimate") - F.col("exact"), 2))).alias("rmse")).select(F.lit(n).alias("n"), "rmse")
        out = e if out is None else out.unionByName(e)
    return out.agg(R(F.regr_slope(F.ln("rmse"), F.ln("n")), 6).alias("slope"))


REJ = f"SELECT floor({u_sql("'73.c'", 'draw', 'row_id')} * 8)::INT AS cell, {u_sql("'73.k'", 'draw', 'row_id')} AS u FROM vectors, (SELECT unnest(range(16)) AS draw)"


@query(f"SELECT cell, count(*) FILTER (u < {LIST}[cell + 1] / {max(FILTER)!r}) AS n, count(*) AS tried FROM ({REJ}) GROUP BY cell", *VEC)
def rejection_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.rejection_cells(V.vectors(spark, d).select("row_id"), FILTER, 16, 73)


@query(f"""WITH r AS (SELECT (u0 > 0.5)::INT + 2 * (u1 > 0.5)::INT + 4 * (u2 > 0.5)::INT AS cell, {u_sql("'74.r'", 0, 'row_id')} AS u FROM vectors),
    c AS (SELECT cell, count(*) AS tried, count(*) FILTER (u < {LIST}[cell + 1] / {max(FILTER)!r}) AS n, count(*) * {LIST}[cell + 1] AS w FROM r GROUP BY cell),
    s AS (SELECT cell, tried, n, n / sum(n) OVER () AS accepted, w / sum(w) OVER () AS expected, sum(n) OVER () / sum(tried) OVER () AS rate FROM c)
    SELECT cell, tried, n, round(accepted, 8) AS accepted, round(expected, 8) AS expected, round(rate, 8) AS rate, round(sum(abs(accepted - expected)) OVER () / 2, 8) AS distance FROM s""", *VEC)
def rejection_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each row kept by its own cell's filter value; the kept rows' histogram against the expected one."""
    cell = C.add([(u > 0.5).cast("int") * (1 << i) for i, u in enumerate(us())])
    out = C.rejection_rows(V.vectors(spark, d), cell, FILTER, 74)
    return out.select("cell", "tried", "n", *(R(c, 8).alias(c) for c in ("accepted", "expected", "rate", "distance")))


@query("""WITH l AS (SELECT row_id, split, unnest(['s_b', 's_c']) AS feature, unnest([s_b, s_c]) AS v FROM line_split),
    k AS (SELECT *, count(*) FILTER (split = 'train') OVER (PARTITION BY feature ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le, count(*) FILTER (split = 'train') OVER (PARTITION BY feature, v) AS here,
        count(*) FILTER (split = 'train') OVER (PARTITION BY feature) AS n FROM l), f AS (SELECT row_id, n, ((le - here + le) / 2.0 + 0.5) / (n + 1) AS f FROM k)
    SELECT row_id, round(sum(-ln(greatest(2 * least(f, 1 - f), 1.0 / (n + 1)))), 8) AS score FROM f GROUP BY row_id""", *LS)
def score_tail_ecdf(spark: SparkSession, d: str) -> DataFrame:
    rows = split_of(V.line_scored(spark, d))
    return C.tail_score(rows, ["s_b", "s_c"], "row_id", F.col("split") == "train").withColumn("score", R("score", 8))


@query("""WITH m AS (SELECT avg(u0) AS m0, avg(u1) AS m1, var_pop(u0) AS a, var_pop(u1) AS b, covar_pop(u0, u1) AS c FROM vectors WHERE y = 0)
    SELECT row_id, round((b * pow(u0 - m0, 2) - 2 * c * (u0 - m0) * (u1 - m1) + a * pow(u1 - m1, 2)) / (a * b - c * c), 6) AS score FROM vectors, m""", *VEC)
def score_mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    return C.mahalanobis(V.vectors(spark, d), ["u0", "u1"], F.col("y") == 0).select("row_id", R("score", 6).alias("score"))


V.VIEW_SQL["marks5000"] = f"SELECT * FROM {keyed_rank_sql(51, 'vectors')} WHERE r <= {C.MOST_LANDMARKS}"
V.VIEW_SQL["refs"] = f"SELECT * FROM {keyed_rank_sql(51, 'vectors')} WHERE r <= {C.MOST_REFERENCES}"
V.VIEW_SQL["halved"] = f"SELECT *, {u_sql(94, 0, 'row_id')} < 0.5 AS val FROM vectors"


@query("""WITH k AS (SELECT v.row_id, -(pow(v.u0 - m.u0, 2) + pow(v.u1 - m.u1, 2)) / (2 * 0.1 * 0.1) AS e FROM vectors v, marks5000 m), t AS (SELECT row_id, max(e) AS top FROM k GROUP BY row_id)
    SELECT row_id, round(max(top) + ln(sum(exp(e - top))) - ln(count(*)) - 2 * ln(0.1 * sqrt(2 * pi())), 6) AS log_density FROM k JOIN t USING (row_id) GROUP BY row_id""", *VEC, "marks5000")
def score_kde(spark: SparkSession, d: str) -> DataFrame:
    return C.kde(V.vectors(spark, d), marks_of(spark, d, C.MOST_LANDMARKS), ["u0", "u1"], 0.1).withColumn("log_density", R("log_density", 6))


WIDTHS = [0.02, 0.05, 0.1, 0.2]


@query(f"""WITH k AS (SELECT h, v.row_id, -(pow(v.u0 - m.u0, 2) + pow(v.u1 - m.u1, 2)) / (2 * h * h) AS e FROM halved v, (SELECT * FROM {keyed_rank_sql(95, '(SELECT * FROM halved WHERE NOT val)')} WHERE r <= {C.MOST_LANDMARKS}) m,
    (SELECT unnest({WIDTHS}::DOUBLE[]) AS h) WHERE v.val), t AS (SELECT h, row_id, max(e) AS top FROM k GROUP BY h, row_id),
    l AS (SELECT h, row_id, max(top) + ln(sum(exp(e - top))) - ln(count(*)) - 2 * ln(h * sqrt(2 * pi())) AS l FROM k JOIN t USING (h, row_id) GROUP BY h, row_id), g AS (SELECT h AS bandwidth, avg(l) AS likelihood FROM l GROUP BY h)
    SELECT bandwidth, round(likelihood, 6) AS likelihood, likelihood = (SELECT max(likelihood) FROM g) AS best FROM g""", *VEC, "halved")
def kde_bandwidth_choice(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood of the validation half under kernels at landmarks of the other, by bandwidth."""
    rows = V.vectors(spark, d).withColumn("val", S.keyed_uniform(94, 0, "row_id") < 0.5)
    marks = P.landmarks(rows.where("NOT val"), "row_id", C.MOST_LANDMARKS, 95)
    return C.best_bandwidth(rows.where("val"), marks, ["u0", "u1"], WIDTHS).withColumn("likelihood", R("likelihood", 6))


NEIGHBOURS = 35
NN = f"""SELECT row_id, mark, d FROM (SELECT v.row_id, m.row_id AS mark, sqrt(pow(v.u0 - m.u0, 2) + pow(v.u1 - m.u1, 2)) AS d, row_number() OVER (PARTITION BY v.row_id ORDER BY sqrt(pow(v.u0 - m.u0, 2) + pow(v.u1 - m.u1, 2)), m.row_id) AS r
    FROM {{0}} v, refs m WHERE v.row_id <> m.row_id) WHERE r <= {NEIGHBOURS}"""


@query(f"""WITH am AS ({NN.format('refs')}), nn AS ({NN.format('vectors')}), kd AS (SELECT row_id AS mark, max(d) AS kd FROM am GROUP BY row_id),
    lm AS (SELECT row_id AS mark, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM am JOIN kd USING (mark) GROUP BY row_id), lv AS (SELECT row_id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nn JOIN kd USING (mark) GROUP BY row_id)
    SELECT row_id, round(avg(lm.lrd) / max(lv.lrd), 6) AS score FROM nn JOIN lm USING (mark) JOIN lv USING (row_id) GROUP BY row_id""", *VEC, "refs")
def score_lof(spark: SparkSession, d: str) -> DataFrame:
    return C.lof(V.vectors(spark, d), marks_of(spark, d, C.MOST_REFERENCES), ["u0", "u1"], NEIGHBOURS).withColumn("score", R("score", 6))


MOVED = "least(1.0, greatest(0.0, u0 {0} 0.02))"


def diff_sql(u: str) -> str:
    e = energy_sql([f"cos(pi() * u{i})" for i in range(3)])
    moved = MOVED.replace("u0", u)
    return f"(({e.replace(u, moved.format('+'))}) - ({e.replace(u, moved.format('-'))})) / 0.04"


PAIRS = {f"u{i}*u{j}": f"-({w}) * cos(pi() * u{i}) * cos(pi() * u{j})" for (i, j), w in B3.items()}


@query("SELECT row_id, " + ", ".join(f"round({diff_sql(u)}, 7) AS {u}" for u in U3) + f", list_position(ts, list_max(ts)) AS top_pair, round(ps[list_position(ts, list_max(ts))], 7) AS top_term FROM (SELECT *, list_transform(ps, lambda x: abs(x)) AS ts FROM (SELECT *, [{', '.join(PAIRS.values())}] AS ps FROM vectors))", *VEC)
def attribution_fd(spark: SparkSession, d: str) -> DataFrame:
    """The slope along every feature, and the pair term that counts most (its number, from 1, and its value)."""
    each = C.attribution(lambda xs: C.energy(C.soft_signs(xs), A3, B3), U3)
    rows = V.vectors(spark, d).withColumn("ps", F.array(*C.pair_terms(U3, B3).values()))
    size = F.transform("ps", lambda x: F.abs(x))
    top = F.array_position(size, F.array_max(size))
    return rows.select("row_id", *(R(each[u], 7).alias(u) for u in U3), top.alias("top_pair"), R(F.element_at("ps", top.cast("int")), 7).alias("top_term"))


TAUS = [0.25, 0.5, 1.0, 1.5, 3.0]


def filter_of(tau: float) -> list[float]:
    return [math.exp(-2 * tau * e) for e in TABLE]


V.VIEW_SQL["tau_scored"] = "SELECT y, unnest(" + str(TAUS) + "::DOUBLE[]) AS tau, unnest([" + ", ".join(f"round(-({cells_sql(filter_of(t))}), 9)" for t in TAUS) + "]) AS score FROM halved WHERE val"
V.VIEW_SQL["tau_ap"] = ap_sql("tau_scored", "tau")


@query("SELECT tau, round(ap, 9) AS ap, tau = (SELECT arg_max(tau, (round(ap, 9), tau)) FROM tau_ap) AS best FROM tau_ap", *VEC, "halved", "tau_scored", "tau_ap")
def filter_tau_choice(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of the filter on the validation half, by tau."""
    rows = V.vectors(spark, d).where(S.keyed_uniform(94, 0, "row_id") < 0.5)
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tau"), R(C.filter_score(us(), TABLE, t), 9).alias("score")) for t in TAUS)))
    ap = M.ap_tie_aware(rows.select("y", each.alias("e")).select("y", "e.*"), "score", "y", ("tau",)).withColumn("ap", R("ap", 9))
    return C.with_best(ap, "tau", "ap")


ERRORS = C.filter_errors(TABLE, 1.5, 40, 0.25)


@query(f"""SELECT count(*) AS rows, round(max(abs(({cells_sql(FILTER)}) - ({cells_sql(CAUCHY)}))), 9) AS worst_row, round({ERRORS['sup_error']!r}::DOUBLE, 9) AS sup_error, round(1 - 2 / pi() * atan(40 * 0.25), 9) AS tail, round(2 * pi() / 0.25, 9) AS period,
    max(abs(({cells_sql(FILTER)}) - ({cells_sql(CAUCHY)}))) <= {ERRORS['sup_error']!r} + 1e-12 AS within FROM vectors""", *VEC)
def cauchy_filter_errors(spark: SparkSession, d: str) -> DataFrame:
    """The finite filter against the exact one: largest difference over the rows and over all cells, mass beyond the grid, alias period."""
    gap = F.max(F.abs(C.filter_score(us(), TABLE, 1.5) - C.cauchy_score(us(), TABLE, 1.5)))
    out = V.vectors(spark, d).agg(F.count(F.lit(1)).alias("rows"), gap.alias("gap"))
    return out.select("rows", R("gap", 9).alias("worst_row"), *(R(F.lit(v), 9).alias(k) for k, v in ERRORS.items()), (F.col("gap") <= ERRORS["sup_error"] + 1e-12).alias("within"))


V.VIEW_SQL["blend_scored"] = "SELECT y, unnest(['a', 'b', 'mean']) AS model, unnest([s_b / 50, s_c * 5, (s_b / 50 + s_c * 5) / 2]) AS score FROM line_scored WHERE part = 'val'"
V.VIEW_SQL["blend_ap"] = ap_sql("blend_scored", "model")


@query("SELECT model, round(ap, 9) AS ap, model = (SELECT arg_max(model, (round(ap, 9), model)) FROM blend_ap) AS best FROM blend_ap", "line_scored", "blend_scored", "blend_ap")
def blend_choice(spark: SparkSession, d: str) -> DataFrame:
    """Average precision on the validation part of two models and their mean, and the best of them."""
    a, b = F.col("s_b") / 50, F.col("s_c") * 5
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), x.alias("score")) for n, x in (("a", a), ("b", b), ("mean", (a + b) / 2)))))
    rows = V.line_scored(spark, d).where("part = 'val'").select("y", each.alias("e")).select("y", "e.*")
    return C.with_best(M.ap_tie_aware(rows, "score", "y", ("model",)).withColumn("ap", R("ap", 9)), "model", "ap")


@query("SELECT row_id, round((s_b / 50 + s_c * 5) / 2, 9) AS score FROM line_scored", "line_scored")
def model_mean_blend(spark: SparkSession, d: str) -> DataFrame:
    return V.line_scored(spark, d).select("row_id", R((F.col("s_b") / 50 + F.col("s_c") * 5) / 2, 9).alias("score"))


@query("SELECT row_id, round(1 / (1 + exp(-(-3.0 + 0.8 * ln(q / (1 - q)) + 0.05 * s_b - 2.0 * s_c))), 8) AS score FROM (SELECT *, least(1 - 1e-7, greatest(1e-7, p)) AS q FROM line_scored)", "line_scored")
def head_apply(spark: SparkSession, d: str) -> DataFrame:
    """Frozen coefficients on the logit of the base probability and two features."""
    from ..operators.models import head_apply as apply

    return V.line_scored(spark, d).select("row_id", R(apply("p", {"s_b": 0.05, "s_c": -2.0}, 0.8, -3.0), 8).alias("score"))


V.VIEW_SQL["pool"] = f"SELECT *, (y = 1)::INT AS l FROM {keyed_rank_sql(81, 'vectors', 'y')} WHERE r <= 40"
POOL = ("vectors", "pool")
ED = "(2 * avg(d) FILTER (a.l = 1 AND b.l = 0) - avg(d) FILTER (a.l = 1 AND b.l = 1) - avg(d) FILTER (a.l = 0 AND b.l = 0))"


def pool_of(spark: SparkSession, d: str) -> DataFrame:
    return P.landmarks(V.vectors(spark, d), "row_id", 40, 81, ("y",))


@query(f"SELECT round({ED.replace('avg(d)', 'avg(sqrt(pow(a.u0 - b.u0, 2) + pow(a.u1 - b.u1, 2)))')}, 8) AS statistic FROM pool a, pool b", *POOL)
def energy_distance(spark: SparkSession, d: str) -> DataFrame:
    return D.energy_distance(pool_of(spark, d), "row_id", "y", ["u0", "u1"]).withColumn("statistic", R("statistic", 8))


EACH, PERMUTATIONS = 200, 99
V.VIEW_SQL["drift_rows"] = f"""SELECT w, row_id, ln(1 + amount) AS x FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY {u_sql(82, 0, 'row_id')}, row_id) AS k FROM
    (SELECT *, ntile(8) OVER (ORDER BY t, row_id)::INT AS w FROM txn)) WHERE k <= {EACH}"""
V.VIEW_SQL["drift_pool"] = """SELECT w, row_id, x, 1 AS late FROM drift_rows WHERE w > 1 UNION ALL SELECT k.w, f.row_id, f.x, 0 FROM drift_rows f, (SELECT DISTINCT w FROM drift_rows WHERE w > 1) k WHERE f.w = 1"""
V.VIEW_SQL["drift_labels"] = f"""SELECT -1 AS permutation, w, row_id, x, late AS l FROM drift_pool UNION ALL SELECT permutation, w, row_id, x, (row_number() OVER (PARTITION BY permutation, w ORDER BY {u_sql(83, 'permutation', 'row_id')}, row_id)
    <= sum(late) OVER (PARTITION BY permutation, w))::INT FROM drift_pool, (SELECT unnest(range({PERMUTATIONS})) AS permutation)"""


@query("""WITH e AS (SELECT permutation, w, 2 * avg(abs(a.x - b.x)) FILTER (a.l = 1 AND b.l = 0) - avg(abs(a.x - b.x)) FILTER (a.l = 1 AND b.l = 1) - avg(abs(a.x - b.x)) FILTER (a.l = 0 AND b.l = 0) AS s
    FROM drift_labels a JOIN drift_labels b USING (permutation, w) GROUP BY permutation, w), o AS (SELECT w, s AS seen FROM e WHERE permutation = -1)
    SELECT w, round(seen, 8) AS statistic, (1 + count(*) FILTER (s >= seen - 1e-12)) / (count(*) + 1) AS p FROM e JOIN o USING (w) WHERE permutation >= 0 GROUP BY w, seen""", "txn", "drift_rows", "drift_pool", "drift_labels")
def drift_permutation_test(spark: SparkSession, d: str) -> DataFrame:
    """Eight windows of the events against the first one: EACH rows of each, PERMUTATIONS permutations."""
    w = P.time_windows(V.txn(spark, d).withColumn("x", F.log1p("amount")), "t", "row_id", 8, EACH, 82).select("w", "row_id", "x")
    first = w.where("w = 1").select("row_id", "x", F.lit(0).alias("late"), F.explode(F.sequence(F.lit(2), F.lit(8))).alias("w"))
    pooled = w.where("w > 1").withColumn("late", F.lit(1)).unionByName(first)
    return D.permutation_test(pooled, "row_id", "late", ["x"], PERMUTATIONS, 83, ("w",)).withColumn("statistic", R("statistic", 8))


@query()
def drift_permutation_views(spark: SparkSession, d: str) -> DataFrame:
    """Eight windows of the events against the first one, 2,000 rows of each, 200 permutations, in three representations."""
    rows = V.txn(spark, d).withColumn("x", F.log1p("amount")).withColumns(dict(zip(("sin", "cos"), S.cyclic_hour(F.pmod("t", F.lit(86400)) / 3600), strict=True)))
    w = P.time_windows(rows, "t", "row_id", 8, 2000, 82).select("w", "row_id", "x", "sin", "cos")
    first = w.where("w = 1").select("row_id", "x", "sin", "cos", F.lit(0).alias("late"), F.explode(F.sequence(F.lit(2), F.lit(8))).alias("w"))
    pooled = w.where("w > 1").withColumn("late", F.lit(1)).unionByName(first)
    views = {"amount": ["x"], "hour": ["sin", "cos"], "both": ["x", "sin", "cos"]}
    return D.permutation_tests(pooled, "row_id", "late", views, 200, 83, ("w",)).withColumn("statistic", R("statistic", 8))


@query("""SELECT w, count(*) AS n, round(avg((category = 'error')::INT), 9) AS rate, round(avg(amount), 6) AS mean, (SELECT min(w) FROM (SELECT w, avg(amount) AS m FROM (SELECT *, ntile(8) OVER (ORDER BY t, row_id)::INT AS w FROM txn) GROUP BY w)
    WHERE m > 40) AS first_high FROM (SELECT *, ntile(8) OVER (ORDER BY t, row_id)::INT AS w FROM txn) GROUP BY w""", "txn")
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    w = P.ntile(V.txn(spark, d), "t", "row_id", 8, "w").groupBy("w").agg(F.count(F.lit(1)).alias("n"), R(F.avg((F.col("category") == "error").cast("int")), 9).alias("rate"), F.avg("amount").alias("mean"))
    first = w.agg(F.min(F.when(F.col("mean") > 40, F.col("w"))).alias("first_high"))
    return w.join(F.broadcast(first)).withColumn("mean", R("mean", 6))
