"""Fitted models: MLlib where it has them, compositions of jobs where it has not."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..plans.staging import staged
from . import metrics as M
from .bootstrap import row_numbers
from .isotonic import calibrated, pools
from .sampling import kfold, landmarks


def assembled(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name).transform(df)


def positive(column: str = "probability") -> Column:
    return F.get(vector_to_array(column), 1)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df with w: half the rows' number divided by the number in the row's class."""
    c = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p"))
    w = F.col("_n") / (2 * F.when(F.col(label) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p")))
    return df.join(F.broadcast(c)).withColumn("w", w).drop("_n", "_p")


def logistic(fit: DataFrame, columns: list[str], label: str, c: float = 1.0, weight: str | None = None):
    """L2-penalised logistic regression with strength 1 / (c n), unstandardised."""
    lr = LogisticRegression(labelCol=label, regParam=1 / (c * max(1, fit.count())), standardization=False, tol=1e-8, maxIter=100)
    return (lr.setWeightCol(weight) if weight else lr).fit(assembled(fit, columns))


def scored(model, df: DataFrame, columns: list[str], name: str = "score") -> DataFrame:
    out = model.transform(assembled(df, columns))
    return out.withColumn(name, positive()).drop("features", "rawPrediction", "probability", "prediction")


def ising_fit(bits: DataFrame, columns: list[str], c: float = 1.0) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Couplings (a, b) of hard signs: each bit's logistic regression on the other signs, over grouped patterns with their
    counts as weights, so that a fit sees 2^n rows at most; b is the mean of both directions."""
    grouped = bits.groupBy(*columns).agg(F.count(F.lit(1)).alias("w"))
    signs = [f"_s{i}" for i in range(len(columns))]
    g = grouped.withColumns({s: 1.0 - 2 * F.col(x) for s, x in zip(signs, columns, strict=True)}).cache()
    total = g.agg(F.sum("w")).first()[0]
    a, b = [], np.zeros((len(columns), len(columns)))
    for i, x in enumerate(columns):
        others = [s for j, s in enumerate(signs) if j != i]
        lr = LogisticRegression(labelCol="_y", weightCol="w", regParam=1 / (c * total), standardization=False, maxIter=60)
        m = lr.fit(assembled(g.withColumn("_y", 1.0 - F.col(x)), others))
        a.append(m.intercept / 2)
        b[i, [j for j in range(len(columns)) if j != i]] = m.coefficients.toArray() / 2
    g.unpersist()
    b = (b + b.T) / 2
    return a, {(i, j): float(b[i, j]) for i in range(len(columns)) for j in range(i + 1, len(columns))}


def pca_error(fit: DataFrame, df: DataFrame, columns: list[str], k: int | None = None, share: float = 0.9, mean: bool = True) -> DataFrame:
    """df with score: mean (or root of the sum of) squared residuals off the first k components, or as many as hold `share`."""
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_c").fit(assembled(fit, columns))
    full = PCA(k=len(columns), inputCol="_c", outputCol="_p").fit(scaler.transform(assembled(fit, columns)))
    variance = full.explainedVariance.toArray()
    k = k or int(np.searchsorted(np.cumsum(variance), share) + 1)
    pc = full.pc.toArray()[:, :k]
    off = np.eye(len(columns)) - pc @ pc.T
    x = [F.col(c) - float(m) for c, m in zip(columns, scaler.mean.toArray(), strict=True)]
    residual = [reduce(lambda p, q: p + q, [v * float(w) for v, w in zip(x, off[i], strict=True)]) for i in range(len(columns))]
    squares = reduce(lambda p, q: p + q, [r * r for r in residual])
    return df.withColumn("score", squares / len(columns) if mean else F.sqrt(squares))


def tree_samples(fit: DataFrame, columns: list[str], key: str, trees: int, size: int, seed: int) -> DataFrame:
    """(tree, turn, _key, columns): for each tree the rows with the lowest keyed numbers, `size` of them and a few more.

    A row's number for a tree comes from its key alone, and a row belongs to a tree if the number is below the share that
    gives `size` rows and six deviations: no order over the rows and no join, and only trees times size rows are sent.
    """
    n = max(1, fit.count())
    most = min(2**32, math.ceil((size + 6 * math.sqrt(size) + 16) / n * 2**32))
    rows = fit.select(F.col(key).cast("string").alias("_key"), *(F.col(c).cast("double").alias(c) for c in columns))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), 1024):
                turn = row_numbers(seed, 0, trees, ["" if k is None else k for k in keys[at : at + 1024]])
                row, tree = np.nonzero(turn < most)
                picked = batch.take(pa.array(row + at))
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(turn[row, tree].astype(np.int64)), *picked.columns], ["tree", "turn", *batch.schema.names])

    return rows.mapInArrow(thinned, "tree int, turn long, _key string, " + ", ".join(f"`{c}` double" for c in columns))


def isolation_forest(fit: DataFrame, columns: list[str], key: str, trees: int = 300, size: int = 8192, seed: int = 1) -> list[tuple]:
    """Trees over keyed samples of `size` fit rows each (all rows where there are fewer), grown in one task per tree.

    A tree is (feature, cut, left, length, n) by node: a row below the cut goes to left, another to left + 1; a leaf has
    itself as left and an infinite cut, and length is the expected path of a row that ends there.
    """
    depth = math.ceil(math.log2(max(2, min(size, max(2, fit.count())))))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(["turn", "_key"]).drop_duplicates("_key")[columns].to_numpy(float)[:size]
        rng = np.random.default_rng([seed, int(rows["tree"].iloc[0])])
        feature, cut, left, length = [0], [np.inf], [0], [0.0]
        waiting = [(0, x, 0)]
        while waiting:
            node, part, level = waiting.pop()
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
            able = np.flatnonzero(high > low)
            if level >= depth or len(part) < 2 or not len(able):
                length[node] = level + float(expected_path(len(part)))
                continue
            f, first = int(able[rng.integers(len(able))]), len(feature)
            feature[node], cut[node], left[node] = f, low[f] + rng.random() * (high[f] - low[f]), first
            for child in (first, first + 1):
                feature.append(0), cut.append(np.inf), left.append(child), length.append(0.0)
            below = part[:, f] < cut[node]
            waiting += [(first, part[below], level + 1), (first + 1, part[~below], level + 1)]
        packed = (np.array(feature, "<i2"), np.array(cut, "<f8"), np.array(left, "<i4"), np.array(length, "<f4"))
        return pd.DataFrame([[*(a.tobytes() for a in packed), len(x)]], columns=["feature", "cut", "left", "length", "n"])

    grown = tree_samples(fit, columns, key, trees, size, seed).groupBy("tree").applyInPandas(grow, "feature binary, cut binary, left binary, length binary, n int").collect()
    return [(np.frombuffer(r.feature, "<i2"), np.frombuffer(r.cut, "<f8"), np.frombuffer(r.left, "<i4"), np.frombuffer(r.length, "<f4"), r.n) for r in grown]


def expected_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, float), 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def isolation_score(df: DataFrame, forest: list[tuple], columns: list[str]) -> DataFrame:
    """df with score in (0, 1): 2^(-mean path / expected path); higher is more anomalous. All rows of a batch go down a tree
    level by level; one that has come to a leaf stays there. Nulls count as NaN, which is below no cut."""
    shipped = df.sparkSession.sparkContext.broadcast([(f.astype(np.int64), cut, left.astype(np.int64), length, tree_depth((f, cut, left, length, n))) for f, cut, left, length, n in forest])
    usual = float(np.mean([expected_path(n) for *_, n in forest])) if forest else 1.0
    k, names, most = len(columns), [*df.columns, "score"], np.finfo(float).max
    inner = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            flat = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[-k:]], 1).ravel()
            # what is below no cut is above all, and at a leaf, whose cut is infinite, it stays
            flat = np.where(flat < most, flat, most)
            base, total = np.arange(n) * k, np.zeros(n)
            at, x, limit, right = np.empty(n, np.int64), np.empty(n), np.empty(n), np.empty(n, bool)
            for feature, cut, left, length, levels in shipped.value:
                node = np.zeros(n, np.int64)
                for _ in range(levels):
                    # clip does without the check of bounds; all places are within them
                    feature.take(node, out=at, mode="clip")
                    at += base
                    flat.take(at, out=x, mode="clip")
                    cut.take(node, out=limit, mode="clip")
                    np.greater_equal(x, limit, out=right)
                    left.take(node, out=at, mode="clip")
                    np.add(at, right, out=node)
                total += length.take(node)
            score = 2.0 ** (-(total / max(1, len(shipped.value))) / max(usual, 1e-9))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-k], pa.array(score)], names)

    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    return df.select(*df.columns, *inner).mapInArrow(run, schema)


def tree_depth(tree: tuple) -> int:
    """Splits on the longest way down a tree, whose children have higher numbers than their parents."""
    left = tree[2]
    depth = np.zeros(len(left), int)
    for node in np.flatnonzero(left != np.arange(len(left))):
        depth[left[node] : left[node] + 2] = depth[node] + 1
    return int(depth.max(initial=0))


def gmm_diag(fit: DataFrame, columns: list[str], k: int, rounds: int = 10, seed: int = 1, key: str = "row_id", floor: float = 1e-6) -> list[tuple]:
    """(weight, means, variances) of a diagonal Gaussian mixture by EM: an expression for the E step, one aggregation of
    sums for the M step. Starts at k keyed rows with the overall variance."""
    overall = fit.agg(*(F.var_pop(c).alias(c) for c in columns)).first()
    starts = landmarks(fit, key, k, seed).select(*columns).collect()  # k rows
    model = [(1 / len(starts), [float(r[c]) for c in columns], [float(overall[c]) + floor for c in columns]) for r in starts]
    rows = fit.select(*columns).cache()
    for _ in range(rounds):
        logs = [component_log(columns, m) for m in model]
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        dens = rows.withColumn("_l", F.array(*logs)).withColumn("_t", top)
        dens = dens.withColumn("_r", F.transform("_l", lambda v: F.exp(v - F.col("_t")))).withColumn("_r", S.normalised(F.col("_r")))
        sums = []
        for j in range(len(model)):
            r = F.get("_r", j)
            sums += [F.sum(r).alias(f"r{j}")] + [F.sum(r * F.col(c)).alias(f"s{j}_{i}") for i, c in enumerate(columns)] + [F.sum(r * F.col(c) * F.col(c)).alias(f"q{j}_{i}") for i, c in enumerate(columns)]
        one = dens.agg(F.count(F.lit(1)).alias("n"), *sums).first()
        model = []
        for j in range(len(logs)):
            w = max(one[f"r{j}"], 1e-12)
            mean = [one[f"s{j}_{i}"] / w for i in range(len(columns))]
            model.append((w / one.n, mean, [max(floor, one[f"q{j}_{i}"] / w - m * m) for i, m in enumerate(mean)]))
    rows.unpersist()
    return model


def component_log(columns: list[str], m: tuple) -> Column:
    w, mean, var = m
    quad = reduce(lambda p, q: p + q, [F.pow(F.col(c) - mu, 2) / v for c, mu, v in zip(columns, mean, var, strict=True)])
    return math.log(w) - 0.5 * (len(columns) * math.log(2 * math.pi) + sum(map(math.log, var))) - 0.5 * quad


def gmm_log_density(columns: list[str], model: list[tuple]) -> Column:
    logs = [component_log(columns, m) for m in model]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    return top + F.ln(S.total(F.transform(F.array(*logs), lambda v: F.exp(v - top))))


def kmeans_modes(fit: DataFrame, df: DataFrame, columns: list[str], k: int, seed: int = 1) -> tuple[DataFrame, list[list[float]]]:
    """df with mode, and the centres."""
    model = KMeans(k=k, seed=seed, featuresCol="features").fit(assembled(fit, columns))
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    return assign(df, columns, centres), centres


def assign(df: DataFrame, columns: list[str], centres: list[list[float]]) -> DataFrame:
    """df with mode: the nearest centre, the first on ties."""
    d = [reduce(lambda p, q: p + q, [F.pow(F.col(c) - m, 2) for c, m in zip(columns, centre, strict=True)]) for centre in centres]
    return df.withColumn("mode", F.array_min(F.array(*(F.struct(x.alias("d"), F.lit(i).alias("i")) for i, x in enumerate(d))))["i"])


def dominant_holdout(fit: DataFrame, test: DataFrame, columns: list[str], label: str, k: int, seed: int = 1) -> tuple[DataFrame, DataFrame, list[list[float]], int]:
    """(fit without the dominant kind, evaluation, centres, dominant): positives are clustered on fit, the largest cluster there,
    the first of equals, is dominant. Its positives are kept from the fit and are the only positives of the evaluation, which
    has all negatives of test. Without positives in fit nothing is kept out and the evaluation has its negatives alone."""
    positives = fit.where(F.col(label) == 1)
    if positives.isEmpty():
        return fit, test.where(F.col(label) == 0), [], -1
    sizes, centres = kmeans_modes(positives, positives, columns, k, seed)
    counts = {r.mode: r["count"] for r in sizes.groupBy("mode").count().collect()}  # at most k rows
    dominant = min(counts, key=lambda m: (-counts[m], m))
    novel = (F.col(label) == 1) & (F.col("mode") == dominant)
    left = assign(fit, columns, centres).where(~novel).drop("mode")
    evaluation = assign(test, columns, centres).where((F.col(label) == 0) | novel).drop("mode")
    return left, evaluation, centres, dominant


def oof(df: DataFrame, columns: list[str], label: str, key: str, folds: int = 5, seed: int = 1) -> DataFrame:
    """(key, label, fold, score): each row scored once, by the model of the other folds."""
    f = kfold(df.select(key, label, *columns), key, folds, seed).drop("position", "total").cache()
    parts = [scored(logistic(f.where(F.col("fold") != k), columns, label), f.where(F.col("fold") == k), columns) for k in range(folds)]
    return reduce(lambda a, b: a.unionByName(b), parts).select(key, label, "fold", "score")


def residual_head(fit: DataFrame, df: DataFrame, base: str, columns: list[str], label: str, c: float = 1.0) -> DataFrame:
    """df with head: logistic on the logit of the base probability and standardised features, fitted on fit."""
    from .encode import standardised

    both = fit.withColumn("_fit", F.lit(True)).unionByName(df.withColumn("_fit", F.lit(False)))
    z = standardised(both.withColumn("_logit", S.logit(F.col(base))), ["_logit", *columns], F.col("_fit"))
    cols = ["z__logit", *(f"z_{x}" for x in columns)]
    model = logistic(z.where("_fit"), cols, label, c)
    return scored(model, z.where("NOT _fit"), cols, "head").drop("_fit", "_logit", *cols)


def strength_grid(fit: DataFrame, pool: DataFrame, base: str, columns: list[str], label: str, strengths: list[float]) -> DataFrame:
    """(c, ap, best): average precision on the pool of the residual head by its strength."""
    from .scores import with_best

    each = [M.ap_tie_aware(residual_head(fit, pool, base, columns, label, c), "head", label).select(F.lit(c).alias("c"), "ap") for c in strengths]
    return with_best(reduce(lambda a, b: a.unionByName(b), each), "c", "ap")


def head_apply(base: str, weights: dict[str, float], on_logit: float, intercept: float) -> Column:
    return S.sigmoid(intercept + on_logit * S.logit(F.col(base)) + reduce(lambda p, q: p + q, [w * F.col(c) for c, w in weights.items()]))


def mlp(fit: DataFrame, df: DataFrame, columns: list[str], label: str, hidden: int = 8, seed: int = 1) -> DataFrame:
    from .encode import standardised

    both = standardised(fit.withColumn("_fit", F.lit(True)).unionByName(df.withColumn("_fit", F.lit(False))), columns, F.col("_fit"))
    cols = [f"z_{c}" for c in columns]
    model = MultilayerPerceptronClassifier(layers=[len(cols), hidden, 2], labelCol=label, seed=seed, maxIter=60).fit(assembled(both.where("_fit"), cols))
    return scored(model, both.where("NOT _fit"), cols).drop("_fit", *cols)


def isotonic(fit: DataFrame, df: DataFrame, score: str, label: str) -> DataFrame:
    """df with calibrated: the isotonic regression of label on score, fitted on fit."""
    return calibrated(df, pools(fit, score, label), score)


def guarded(methods: dict[str, object]) -> list[tuple[str, str, str]]:
    """(method, status, reason) of callables: a failing one is a record, not the end of the run."""
    out = []
    for name, run in methods.items():
        try:
            run()
            out.append((name, "ok", ""))
        except Exception as e:  # noqa: BLE001
            out.append((name, "failed", f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"))
    return out
