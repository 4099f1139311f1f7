"""Feature engineering and screening."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.ordered import ordered
from ..plans.staging import staged
from .aggregates import card_profile, robust_spread
from .contracts import unpivot


def screen_auc(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, auc): the rank form of the area, ties averaged, for each feature by itself."""
    long = unpivot(df, columns, "feature", "value", (label,))
    # values first: one row per feature and value carries the counts
    g = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    o = ordered(g, "value", groups=("feature",), sums={"n": F.col("n"), "pos": F.col("pos")}, ranks=False)
    rank_sum = F.sum(F.col("pos") * (F.col("run_n") - F.col("n") + (F.col("n") + 1) / 2))
    a = o.groupBy("feature").agg(rank_sum.alias("r"), F.max("all_pos").alias("p"), F.max("all_n").alias("n"))
    return a.select("feature", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def mutual_information(df: DataFrame, column: str, label: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Information (nats) between two discrete columns from their contingency table."""
    c = df.groupBy(*groups, column, label).agg(F.count(F.lit(1)).alias("n"))
    x = c.groupBy(*groups, column).agg(F.sum("n").alias("nx")).withColumnsRenamed({g: f"_x{g}" for g in groups} | {column: "_xc"})
    y = c.groupBy(*groups, label).agg(F.sum("n").alias("ny")).withColumnsRenamed({g: f"_y{g}" for g in groups} | {label: "_yl"})
    a = c.groupBy(*groups).agg(F.sum("n").alias("na")).withColumnsRenamed({g: f"_a{g}" for g in groups})
    same = lambda k, *extra: reduce(lambda p, q: p & q, [*(F.col(g).eqNullSafe(F.col(f"_{k}{g}")) for g in groups), *extra], F.lit(True))
    t = c.join(x, same("x", F.col(column).eqNullSafe(F.col("_xc")))).join(y, same("y", F.col(label).eqNullSafe(F.col("_yl")))).join(F.broadcast(a), same("a"))
    term = F.col("n") / F.col("na") * F.ln(F.col("n") * F.col("na") / (F.col("nx") * F.col("ny")))
    return t.groupBy(*groups).agg(F.sum(term).alias("mi"))


#: digamma(1) to digamma(7) are sums of 1 / i less this constant.
EULER = 0.5772156649015329


def digamma(n: Column) -> Column:
    """The digamma function of a whole number from 1 on: exact sums below 8, then the usual series."""
    small = [sum(1 / i for i in range(1, m)) - EULER for m in range(1, 8)]
    x = n.cast("double")
    series = F.ln(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    return F.when(n < 8, F.get(F.array(*map(F.lit, small)), (n - 1).cast("int"))).otherwise(series)


def nearest_information(df: DataFrame, columns: list[str], label: str, key: str, k: int = 3, span: int = 10_000) -> DataFrame:
    """(feature, mi): information (nats) between each numeric column and the label, by nearest neighbours.

    A row's radius r is the distance to its k-th neighbour of its class (of a class of fewer rows, the last); m counts rows of
    any class strictly between x - r and x + r, or equal to x where r is 0. The estimate is digamma(n) plus the means of
    digamma(neighbours) - digamma(rows of the class) - digamma(m). Rows without a finite value or a label, and those of
    classes of one row, are left out; a column without others has no result.

    r and m depend on class and value alone, so rows are counted by these first and their keys go nowhere; key only names
    the rows. The values of each class are put in order once and cut into spans of positions, which take k values of the
    spans beside them along, so lag and lead see every neighbour. m is the difference of two counts, from one order of
    values and interval ends.
    """
    span = max(span, k)
    long = unpivot(df.select(label, *(F.col(c).cast("double").alias(c) for c in columns)), columns, "feature", "value", (label,))
    long = long.select("feature", F.col(label).alias("y"), "value").where(F.col("y").isNotNull() & (F.abs(F.col("value")) < F.lit(float("inf"))))
    values = long.groupBy("feature", "y", "value").agg(F.count(F.lit(1)).alias("copies"))
    rows = ordered(values, "value", (), ("feature", "y"), sums={"n": F.col("copies")}, ranks=False).where("all_n > 1")
    rows = rows.select("feature", "y", "value", "copies", "position", F.col("all_n").alias("of_class"), F.floor((F.col("position") - 1) / span).alias("part"))
    inside = (F.col("position") - 1) % span
    beside = F.array(F.col("part"), F.when(inside < k, F.col("part") - 1), F.when(inside >= span - k, F.col("part") + 1))
    spread = rows.select("*", F.explode(F.filter(beside, lambda p: p.isNotNull())).alias("at"))
    w = Window.partitionBy("feature", "y", "at").orderBy("position")
    x = F.col("value")
    shifted = {f"_{f.__name__}_{c}_{j}": f(c, j).over(w) for f in (F.lag, F.lead) for c in ("value", "copies") for j in range(1, k + 1)}
    near = spread.select("*", *(c.alias(name) for name, c in shifted.items())).where(F.col("at") == F.col("part"))
    far = F.lit(float("inf"))
    away = lambda side, j: F.coalesce(F.abs(x - F.col(f"_{side}_value_{j}")), far) if j else F.lit(0.0)
    upto = lambda side, j: reduce(lambda a, b: a + b, [F.coalesce(f"_{side}_copies_{i}", F.lit(0)) for i in range(1, j + 1)], F.lit(0))
    found = F.least(F.lit(k), F.col("of_class") - 1)
    # the least reach over i values to the left and j to the right that hold enough rows together
    enough = lambda i, j: F.col("copies") - 1 + upto("lag", i) + upto("lead", j) >= F.col("found")
    reach = F.least(*(F.when(enough(i, j), F.greatest(away("lag", i), away("lead", j))).otherwise(far) for i in range(k + 1) for j in range(k + 1 - i)))
    near = near.withColumn("found", found).withColumn("r", reach)
    near = staged(near.select("feature", "y", "value", "copies", "r", "of_class", "found"), "radii")
    # at equal values: ends that count what is below come first, then rows, then ends that count what is equal too
    low, high, tied = x - F.col("r"), x + F.col("r"), F.col("r") == 0
    ends = F.array(
        F.struct(F.when(tied, x).otherwise(low).alias("end"), F.when(tied, 0).otherwise(2).alias("turn"), F.lit(-1).alias("sign")),
        F.struct(x.alias("end"), F.lit(1).alias("turn"), F.lit(0).alias("sign")),
        F.struct(F.when(tied, x).otherwise(high).alias("end"), F.when(tied, 2).otherwise(0).alias("turn"), F.lit(1).alias("sign")),
    )
    events = near.select("feature", "y", "value", "copies", "of_class", "found", F.inline(ends))
    counted = ordered(events, "end", ("turn",), ("feature",), sums={"rows": F.when(F.col("turn") == 1, F.col("copies")).otherwise(0)}, ranks=False).where("turn <> 1")
    m = counted.groupBy("feature", "y", "value", "copies", "of_class", "found", "all_rows").agg(F.sum(F.col("sign") * F.col("run_rows")).alias("m"))
    term = digamma(F.col("found")) - digamma(F.col("of_class")) - digamma(F.col("m"))
    mean = F.sum(F.col("copies") * term) / F.col("all_rows")
    return m.groupBy("feature", "all_rows").agg(mean.alias("mean")).select("feature", (digamma(F.col("all_rows")) + F.col("mean")).alias("mi"))


def screen_robust_variance(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, robust_variance) over the rows of label 0."""
    return robust_spread(unpivot(df.where(F.col(label) == 0), columns, "feature", "value"), "value", ("feature",)).select("feature", "robust_variance")


def geo_card(txn: DataFrame, geo: DataFrame, fit: Column) -> DataFrame:
    """Eight engineered columns: log amount, hour sine and cosine, age of the card in days, log distance, log of the card's
    rows, category rate and the row's clipped deviation from its card's mean (deviation at least 0.05, within 20)."""
    profile = card_profile(txn.where(fit), "card", "amount")
    overall = profile.select("all_mean", "all_sd").limit(1)
    rate = txn.where(fit).groupBy("category").agg((F.count(F.lit(1)) / F.lit(1.0)).alias("_n")).join(txn.where(fit).agg(F.count(F.lit(1)).alias("_a")))
    rate = rate.select("category", (F.col("_n") / F.col("_a")).alias("category_rate"))
    seen = txn.groupBy("card").agg(F.min("t").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    where = geo.select(F.col("row_id").alias("card"), S.haversine(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon")).alias("_km"))
    rows = txn.join(profile.select("card", "mean", "sd"), "card", "left").join(overall).join(rate, "category", "left").join(seen, "card").join(where, "card", "left")
    log_amount = F.log1p("amount")
    sin, cos = S.cyclic_hour(F.pmod("t", F.lit(86400)) / 3600)
    deviation = (log_amount - F.coalesce("mean", "all_mean")) / F.greatest(F.coalesce("sd", "all_sd"), F.lit(0.05))
    return rows.select(
        "row_id", log_amount.alias("log_amount"), sin.alias("hour_sin"), cos.alias("hour_cos"), ((F.col("t") - F.col("_first")) / 86400).alias("card_age_days"), F.log1p(F.coalesce("_km", F.lit(0.0))).alias("log_km"),
        F.log1p("_rows").alias("log_rows"), F.coalesce("category_rate", F.lit(0.0)).alias("category_rate"), S.clip(deviation, -20.0, 20.0).alias("deviation"),
    )


def pairwise_products(us: list[str]) -> dict[str, Column]:
    """z_i = cos(pi u_i) and every product z_i z_j with i < j."""
    z = [F.cos(math.pi * F.col(u)) for u in us]
    return {f"z{i}": c for i, c in enumerate(z)} | {f"z{i}z{j}": z[i] * z[j] for i in range(len(z)) for j in range(i + 1, len(z))}


def random_terms(us: list[str], count: int, seed: int) -> list[list[tuple[str, str]]]:
    """`count` products, each as one to three (sin or cos, column), drawn by a seeded generator."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        picked = rng.choice(len(us), size=int(rng.integers(1, 4)), replace=False)
        out.append([("sin" if rng.random() < 0.5 else "cos", us[int(i)]) for i in picked])
    return out


def random_products(us: list[str], count: int, seed: int) -> dict[str, Column]:
    """`count` products of one to three sines or cosines of pi u, as `random_terms` draws them."""
    wave = {"sin": F.sin, "cos": F.cos}
    return {f"r{k}": reduce(lambda a, b: a * b, [wave[f](math.pi * F.col(u)) for f, u in terms]) for k, terms in enumerate(random_terms(us, count, seed))}


def landmark_kernel(df: DataFrame, marks: DataFrame, columns: list[str], kernel, most: int = 5000) -> DataFrame:
    """(row_id, mark, k): kernel(columns of the row, columns of the landmark) for each row and landmark.

    marks: a stated set of at most `most` landmarks, which are sent to every task; more are an error.
    """
    if marks.limit(most + 1).count() > most:
        raise ValueError(f"over {most} landmarks")
    m = F.broadcast(marks.select(F.col("row_id").alias("mark"), *(F.col(c).alias(f"_{c}") for c in columns)))
    pairs = df.crossJoin(m)
    return pairs.select("row_id", "mark", kernel([F.col(c) for c in columns], [F.col(f"_{c}") for c in columns]).alias("k"))


def nystrom(df: DataFrame, marks: DataFrame, columns: list[str], kernel, least: float = 1e-10) -> DataFrame:
    """row_id and f0, f1, ...: kernel values to the landmarks times the inverse square root of the landmarks' Gram matrix,
    whose eigenvalues up to least times the largest are dropped. The matrix (landmarks squared) is small and fixed."""
    gram = landmark_kernel(marks, marks, columns, kernel).orderBy("row_id", "mark").collect()  # landmarks squared
    ids = sorted({r.row_id for r in gram})
    at = {r: i for i, r in enumerate(ids)}
    g = np.zeros((len(ids), len(ids)))
    for r in gram:
        g[at[r.row_id], at[r.mark]] = r.k
    w, v = np.linalg.eigh(g)
    keep = w > least * w.max()
    root = v[:, keep] @ np.diag(w[keep] ** -0.5) @ v[:, keep].T
    k = landmark_kernel(df, marks, columns, kernel).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("mark", "k"))).alias("_k"))
    row = F.col("_k.k")
    return k.select("row_id", *(S.total(F.zip_with(row, F.array(*map(F.lit, map(float, root[:, i]))), lambda a, b: a * b)).alias(f"f{i}") for i in range(len(ids))))


def gamma_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, gamma: 1 / (number of columns * variance of all values)."""
    return unpivot(df, columns, "c", "v").agg((1 / (len(columns) * F.var_pop("v"))).alias("gamma"))


def cross_view(df: DataFrame, left: list[str], right: list[str], fit: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """df, or its columns `keep`, with overlap = 1 - (1 + prod cos(pi (a_k - b_k) / 2)) / 2 of the canonical variates of two views, each mapped by its
    empirical distribution. Covariance blocks come from one aggregation; the small decomposition is done on the driver. df is
    read twice."""
    from .block_ranks import block_ecdf

    cols = [*left, *right]
    one = df.where(fit).agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols))).first()
    n, k = len(cols), len(left)
    cov = np.array([[one[f"c{i}_{j}"] for j in range(n)] for i in range(n)]) + 1e-9 * np.eye(n)

    def inverse_root(m: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(m)
        return v @ np.diag(w**-0.5) @ v.T

    a, b = inverse_root(cov[:k, :k]), inverse_root(cov[k:, k:])
    u, _, vt = np.linalg.svd(a @ cov[:k, k:] @ b)
    r = min(k, n - k)
    wa, wb = a @ u[:, :r], b @ vt.T[:, :r]
    signs = np.sign(wa[np.abs(wa).argmax(0), range(r)])
    wa, wb = wa * signs, wb * signs
    centred = [F.col(c) - one[f"m{i}"] for i, c in enumerate(cols)]
    mixed = lambda xs, w: reduce(lambda p, q: p + q, [x * float(c) for x, c in zip(xs, w, strict=True)])
    mix = {f"_a{i}": mixed(centred[:k], wa[:, i]) for i in range(r)} | {f"_b{i}": mixed(centred[k:], wb[:, i]) for i in range(r)}
    out = block_ecdf(df, mix, fit, tuple(keep or df.columns))
    product = reduce(lambda p, q: p * q, [F.cos(math.pi * (F.col(f"_a{i}u") - F.col(f"_b{i}u")) / 2) for i in range(r)])
    return out.withColumn("overlap", 1 - 0.5 * (1 + product)).drop(*(f"_{s}{i}u" for s in "ab" for i in range(r)))


def bounded_shift(u: Column, label: Column, eps: float) -> Column:
    return F.when(label == 1, (1 - eps) * u + 0.5 * eps).otherwise(u)


def prevalence_weight(df: DataFrame, label: str, target: float) -> DataFrame:
    """df with weight: 1 for negatives, and for positives what makes their weighted share equal to target."""
    c = df.agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n"))
    w = target / (1 - target) * (F.col("_n") - F.col("_p")) / F.col("_p")
    return df.join(F.broadcast(c)).withColumn("weight", F.when(F.col(label) == 1, w).otherwise(1.0)).drop("_p", "_n")


def walsh(cells: DataFrame, width: int) -> DataFrame:
    """(mask, coefficient) of a table (cell, value) over 2^width cells: mean of value times (-1)^(bits of cell in mask)."""
    masks = cells.sparkSession.range(1 << width).withColumnRenamed("id", "mask")
    sign = 1 - 2 * S.parity(F.col("cell"), F.col("mask"))
    return cells.join(F.broadcast(masks)).groupBy("mask").agg((F.sum(F.col("value") * sign) / (1 << width)).alias("coefficient"))
