"""A document quality score learnt from preference pairs (Bradley-Terry), with a threshold at a quantile of the scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_of

#: Labelled rows that a fit uses at most: those with the smallest hashes of their ids.
MOST_ROWS = 20_000
#: Preference pairs drawn from them.
PAIRS = 200_000
#: Pairs whose differences are held at once.
SLICE = 20_000
#: The score at which a document is taken for label 1.
CUT = 0.3
#: Surface counts of a text, and buckets of its hashed byte trigrams.
COUNTS, TRIGRAMS = 15, 48
FEATURES = COUNTS + TRIGRAMS


def features(text: str) -> np.ndarray:
    """FEATURES numbers from the whole text: shares of kinds of characters, word lengths, repetition and length, and the
    square roots of the shares of its lower-cased byte trigrams by TRIGRAMS hash buckets."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(FEATURES)
    if raw:
        out[:COUNTS] = counts(raw)
        low = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
        if len(low) > 2:
            mixed = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761) >> np.uint32(16)
            out[COUNTS:] = np.sqrt(np.bincount(mixed % TRIGRAMS, minlength=TRIGRAMS) / len(mixed))
    return out


def counts(raw: bytes) -> list[float]:
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = raw.split()
    lines = raw.split(b"\n")
    n_words = max(1, len(words))
    different = len(set(words)) / n_words
    signs = (b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()) / n
    return [
        float(x)
        for x in (
            b[65:91].sum() / n, np.sqrt(b[65:91].sum() / n), b[48:58].sum() / n, signs, np.sqrt(signs),
            (b[44] + b[46]) / n, np.sqrt((b[33] + b[63]) / n), (b[9:14].sum() + b[32]) / n, b[128:].sum() / n,
            different, np.log(different + 1e-3), len(set(lines)) / len(lines), min(n / n_words, 40), np.log1p(n), np.log1p(n) * different,
        )
    ]


@dataclass
class Model:
    """score = sigmoid(slope * (w . x - cut) + logit(CUT)), so that a document at the cut scores CUT."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-2, steps: int = 25, seed: int = 11) -> Model:
    """Weights that make the preferred document of a pair (label 1 against label 0) score higher, by logistic loss on
    feature differences without intercept; then the quantile of the scores that separates the labels best.

    With rows of one label only, every document scores 0.5.
    """
    d = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), np.log(CUT / (1 - CUT)), 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(d)
    for _ in range(steps):
        grad, hess = -ridge * w, ridge * np.eye(d)
        for at in range(0, pairs, SLICE):
            diff = z[better[at : at + SLICE]] - z[worse[at : at + SLICE]]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad += diff.T @ p / pairs
            hess += (diff * (p * (1 - p))[:, None]).T @ diff / pairs
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    cuts = np.quantile(raw, np.linspace(0, 1, 1001))
    of_good, of_bad = np.sort(raw[good]), np.sort(raw[bad])
    rank = lambda s, c: np.searchsorted(s, c) / len(s)
    right = (1 - rank(of_good, cuts)) + rank(of_bad, cuts)
    best = cuts[np.flatnonzero(right >= right.max() - 1e-12)]
    return Model(mean, scale, w, float((best[0] + best[-1]) / 2), 1.0)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """The model from at most most_rows labelled, not held-out rows of docs; rows without label, id or text don't count.

    Of several texts with one id the first in order counts, and of several labels the largest.
    """
    wanted = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(wanted), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [features(t) for t in batch["text"]], "y": batch["quality"].astype(int)})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInPandas(run, f"doc_id {id_type}, x array<double>, y int").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(len(got), FEATURES)
    return fit(x, got["y"].to_numpy())


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the column `name` in (0, 1), from the whole text alone; a null text counts as empty. No shuffle."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], float).reshape(len(texts), FEATURES)))

    return docs.withColumn(name, scored(text_of(text_col)))


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 where score >= CUT).

    A null text scores as an empty one; rows with a null id are scored as any other. Without labels of both kinds every
    score is 0.5. Repeated rows score alike. An empty table gives an empty result. Labels of unknown documents, null
    labels and repeated labels (the larger counts) are allowed. Columns other than doc_id and text, whatever their
    names, neither enter a score nor come back.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, most_rows)).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted as label 1, with all their columns and no others, whatever their names.

    Null and empty texts are scored as empty ones; without labels of both kinds all documents stay; repeated rows and
    an empty table are as in `classify`.
    """
    name = free_name(docs, "quality_score")
    return score(docs, train(docs, labels), name=name).where(F.col(name) >= CUT).drop(name)
