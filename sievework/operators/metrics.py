"""Ranking, calibration and decision metrics by group, from one row per distinct score wherever ties allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.ordered import midranks, ordered
from ..plans.selection import written_first_rows
from .aggregates import exploded, quantile_higher, quantiles
from .sampling import ntile


def score_steps(df: DataFrame, score: str, label: str, groups: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """One row per group and distinct score, best first: n, pos, run_n, run_pos, all_n, all_pos (weighted where asked)."""
    w = F.col(weight) if weight else F.lit(1)
    g = df.groupBy(*groups, F.col(score).alias("score")).agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).alias("pos"))
    return ordered(g, "score", groups=groups, desc=True, sums={"n": F.col("n"), "pos": F.col("pos")}, ranks=False)


def ap_tie_aware(df: DataFrame, score: str, label: str, groups: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(groups, ap): precision at the end of each run of equal scores, weighted by its positives; null without positives."""
    s = score_steps(df, score, label, groups, weight)
    return s.groupBy(*groups).agg(F.try_divide(F.sum(F.col("pos") * F.col("run_pos") / F.col("run_n")), F.max("all_pos")).alias("ap"))


def ap_stable_order(df: DataFrame, score: str, label: str, key: str, groups: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(groups, ap): each row is a step; the row order of key breaks ties."""
    w = F.col(weight) if weight else F.lit(1)
    rows = df.select(*groups, score, key, w.alias("_n"), (w * F.col(label)).alias("_w"))
    o = ordered(rows, score, (key,), groups, desc=True, sums={"n": F.col("_n"), "pos": F.col("_w")}, ranks=False)
    return o.groupBy(*groups).agg(F.try_divide(F.sum(F.col("_w") * F.col("run_pos") / F.col("run_n")), F.max("all_pos")).alias("ap"))


def auroc(df: DataFrame, score: str, label: str, groups: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(groups, auc): positives above negatives, ties by half; null with one class only."""
    s = score_steps(df, score, label, groups, weight)
    below = (F.col("all_n") - F.col("all_pos")) - (F.col("run_n") - F.col("run_pos")) + (F.col("n") - F.col("pos")) / 2
    return s.groupBy(*groups).agg(F.try_divide(F.sum(F.col("pos") * below), F.max(F.col("all_pos") * (F.col("all_n") - F.col("all_pos")))).alias("auc"))


def ranking_metrics(df: DataFrame, score: str, label: str, groups: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(groups, ap, auc, n, positives) in one pass over the score steps."""
    s = score_steps(df, score, label, groups, weight)
    below = (F.col("all_n") - F.col("all_pos")) - (F.col("run_n") - F.col("run_pos")) + (F.col("n") - F.col("pos")) / 2
    return s.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col("pos") * F.col("run_pos") / F.col("run_n")), F.max("all_pos")).alias("ap"),
        F.try_divide(F.sum(F.col("pos") * below), F.max(F.col("all_pos") * (F.col("all_n") - F.col("all_pos")))).alias("auc"), F.max("all_n").alias("n"), F.max("all_pos").alias("positives"),
    )


def confusion(df: DataFrame, flagged: Column, label: str, groups: tuple[str, ...] = ()) -> DataFrame:
    y = F.col(label) == 1
    c = df.groupBy(*groups).agg(F.count_if(flagged & y).alias("tp"), F.count_if(flagged & ~y).alias("fp"), F.count_if(~flagged & y).alias("fn"), F.count_if(~flagged & ~y).alias("tn"))
    return with_rates(c)


def with_rates(c: DataFrame) -> DataFrame:
    """Counts with precision, recall and F1, 0 where they are undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def f1_threshold(df: DataFrame, score: str, label: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, threshold, f1): the score at or above which flagging gives the best F1, the lowest such score on ties."""
    s = score_steps(df, score, label, groups).withColumn("f1", 2 * F.col("run_pos") / (F.col("run_n") + F.col("all_pos")))
    return s.groupBy(*groups).agg(F.max_by(F.struct("score", "f1"), F.struct("f1", -F.col("score"))).alias("e")).select(*groups, F.col("e.score").alias("threshold"), "e.f1")


def f1_best_threshold(df: DataFrame, score: str, label: str, part: str) -> DataFrame:
    """Precision, recall and F1 on part = test at the best threshold of part = val (score >= threshold)."""
    t = f1_threshold(df.where(F.col(part) == "val"), score, label).select("threshold")
    test = df.where(F.col(part) == "test").join(F.broadcast(t))
    return confusion(test, F.col(score) >= F.col("threshold"), label, ("threshold",))


def recall_at_fpr(df: DataFrame, score: str, label: str, fpr: float) -> DataFrame:
    """Recall above the linear (1 - fpr) quantile of the negatives."""
    t = quantiles(df.where(F.col(label) == 0), score, [1 - fpr]).select(F.col("value").alias("threshold"))
    return df.join(F.broadcast(t)).groupBy("threshold").agg((F.count_if((F.col(score) > F.col("threshold")) & (F.col(label) == 1)) / F.sum(label)).alias("recall"))


def operating_point(df: DataFrame, score: str, label: str, part: str, fpr: float) -> DataFrame:
    """threshold ("higher" quantile of val negatives), realised val_fpr and test_fpr, test_recall; flags are score > threshold."""
    t = quantile_higher(df.where((F.col(part) == "val") & (F.col(label) == 0)), score, 1 - fpr)
    hit, neg, val = F.col(score) > F.col("threshold"), F.col(label) == 0, F.col(part) == "val"
    share = lambda c: F.try_divide(F.count_if(c & hit), F.count_if(c))
    return df.join(F.broadcast(t)).groupBy("threshold").agg(share(neg & val).alias("val_fpr"), share(neg & ~val).alias("test_fpr"), share(~neg & ~val).alias("test_recall"))


def recall_at_budget(df: DataFrame, score: str, order: str, label: str, key: str, low: float, high: float, budget: int) -> DataFrame:
    """flagged: positives above the band; reviewed: positives among the band's `budget` best by order; recall of both together."""
    band = df.where((F.col(score) > low) & (F.col(score) <= high)).select(order, key, label)
    best = written_first_rows(band, order, key, budget, desc=True).agg(F.coalesce(F.sum(label), F.lit(0)).alias("reviewed"))
    base = df.agg(F.coalesce(F.sum(F.when(F.col(score) > high, F.col(label))), F.lit(0)).alias("flagged"), F.sum(label).alias("positives"))
    return base.join(best).withColumn("recall", F.try_divide(F.col("flagged") + F.col("reviewed"), F.col("positives")))


def brier(df: DataFrame, p: str, label: str) -> DataFrame:
    """brier, and constant: that of always predicting the prevalence."""
    return df.agg(F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"), F.avg(label).alias("_r")).select("brier", (F.col("_r") * (1 - F.col("_r"))).alias("constant"))


def ece_bins(df: DataFrame, p: str, label: str, key: str, bins: int = 10) -> DataFrame:
    """(bin, n, predicted, observed, gap): consecutive bins of equal count by predicted probability."""
    b = ntile(df, p, key, bins, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(label).alias("observed"))
    return b.withColumn("gap", F.abs(F.col("predicted") - F.col("observed")))


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def weighted_bce(df: DataFrame, p: str, label: str, eps: float = 1e-7) -> DataFrame:
    """Half the mean log loss of each class."""
    q = S.clip(F.col(p), eps, 1 - eps)
    return df.agg((0.5 * F.avg(F.when(F.col(label) == 1, -F.ln(q))) + 0.5 * F.avg(F.when(F.col(label) == 0, -F.ln(1 - q)))).alias("bce"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of midranks."""
    mid = lambda x, c, name: midranks(x, c).withColumn(name, F.col("below") + (F.col("ties") + 1) / 2).drop("below", "ties")
    return mid(mid(df, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("spearman"))


def band_capture(df: DataFrame, orders: list[str], label: str, key: str, ks: list[int]) -> DataFrame:
    """(ordering, k, positives) among the k best of df by each ordering."""
    out = None
    for o in orders:
        top = ordered(written_first_rows(df.select(key, o, label), o, key, max(ks), desc=True), o, (key,), desc=True, ranks=False)
        c = top.select(label, "position", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("position <= k").groupBy("k").agg(F.sum(label).alias("positives"))
        c = c.select(F.lit(o).alias("ordering"), "k", "positives")
        out = c if out is None else out.unionByName(c)
    return out


def prevalence_stress(df: DataFrame, score: str, label: str, targets: list[float]) -> DataFrame:
    """(target, ap): AP with positives weighted to each prevalence, from one table of score steps."""
    s = score_steps(df, score, label).select("*", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    w = F.col("target") / (1 - F.col("target")) * (F.col("all_n") - F.col("all_pos")) / F.col("all_pos")
    precision = w * F.col("run_pos") / (w * F.col("run_pos") + F.col("run_n") - F.col("run_pos"))
    return s.groupBy("target").agg((F.sum(F.col("pos") * precision) / F.max("all_pos")).alias("ap"))


def metric_rollup(df: DataFrame, family: str, seed: str, value: str) -> DataFrame:
    """Mean, least and greatest of a metric by (family, seed), by family and over all; level is Spark's grouping id."""
    return df.rollup(family, seed).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def row_diversity(df: DataFrame, vector: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Mean squared distance between the vectors of different rows, from moments: 2n/(n-1) (sum of mean squares - sum of squared means)."""
    m = exploded(df, vector, groups).groupBy(*groups, "cell").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") * F.col("x")).alias("sq"), F.avg("x").alias("m"))
    return m.groupBy(*groups).agg((2 * F.max("n") / (F.max("n") - 1) * F.sum(F.col("sq") - F.col("m") * F.col("m"))).alias("diversity"))
