"""Quality classification by naive Bayes support vectors.

Indicators of hashed character n-grams and of text-shape bins are scaled by the log-count ratio
of the two classes; a linear hinge-loss model on them is fitted by dual coordinate descent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams
from .common import bounded_batches, fresh_worker, id_bucket, table
from .sampling import balanced_sample, sampled_texts

ORDERS = (1, 2, 3)
GRAMS = 1 << grams.BITS
EDGES = np.array([0.0, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
BINS = 16
SHAPES = 7
SIZE = GRAMS + SHAPES * BINS
#: Weight of a shape indicator against the n-grams of a text, which weigh one together.
SHAPE_WEIGHT = 0.25


def shape_bins(text: str) -> list[int]:
    """One bin each for repetition of words and lines, variety, capitals, symbols, digits, length."""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = max(1, len(text))
    capitals = sum(text.count(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    digits = sum(text.count(c) for c in "0123456789")
    symbols = sum(text.count(c) for c in "!#$%&*+/;<=>?@[]^_`{|}~")
    again = sum(map(str.__eq__, words, words[1:]))
    shares = [
        again / max(1, len(words)),
        1 - len(set(words)) / max(1, len(words)),
        1 - len(set(lines)) / max(1, len(lines)),
        capitals / n,
        symbols / n,
        digits / n,
    ]
    bins = [int(np.searchsorted(EDGES, s, "left")) for s in shares]
    return [GRAMS + BINS * k + b for k, b in enumerate([*bins, min(BINS - 1, len(words).bit_length())])]


def indicators(text: str) -> np.ndarray:
    """Sorted places of the indicators that the text sets."""
    held = np.zeros(GRAMS, dtype=bool)
    grams.presence(text, ORDERS, held)
    return np.concatenate([np.flatnonzero(held), shape_bins(text)]).astype(np.int32)


def values(places: np.ndarray) -> np.ndarray:
    v = np.full(len(places), 1 / np.sqrt(max(1, len(places) - SHAPES)), dtype=np.float32)
    v[-SHAPES:] = SHAPE_WEIGHT
    return v


@dataclass
class QualityModel:
    weights: np.ndarray  # the linear model's weights times the log-count ratios
    bias: float
    slope: float  # of the logistic curve that turns margins into scores
    shift: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """Weighted sums of sparse indicator rows, all in one product."""
        ends = np.cumsum([0, *map(len, rows)])
        products = self.weights[np.concatenate(rows)] * np.concatenate([values(p) for p in rows])
        return np.add.reduceat(products.astype(np.float64), ends[:-1]) + self.bias

    def scores(self, texts: list[str | None], batch: int = 64) -> list[float]:
        out: list[float] = []
        for start in range(0, len(texts), batch):
            margins = self.margins([indicators(t or "") for t in texts[start : start + batch]])
            out += (1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))).tolist()
        return out


def fit(rows: list[np.ndarray], good: np.ndarray, cost: float = 2.0, epochs: int = 30, smooth: float = 1.0, seed: int = 0) -> QualityModel:
    """Fit on indicator rows and labels (True: good).  With one class or none the score is 0.5."""
    y = np.where(good, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(SIZE, np.float32), 0.0, 1.0, 0.0)
    counts = {c: np.full(SIZE, smooth) for c in (1.0, -1.0)}
    for places, c in zip(rows, y):
        counts[c][places] += 1
    ratio = np.log(counts[1.0] / (smooth + (y > 0).sum())) - np.log(counts[-1.0] / (smooth + (y < 0).sum()))
    ratio = ratio.astype(np.float32)
    scaled = [ratio[p] * values(p) for p in rows]
    limit = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    norm = [float(v @ v) + 1 for v in scaled]
    w, bias, alpha = np.zeros(SIZE, np.float32), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            p, v = rows[i], scaled[i]
            gradient = y[i] * (float(w[p] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[p] += np.float32(step) * v
                bias += step
                alpha[i] = new
    margins = np.array([float(w[p] @ v) + bias for p, v in zip(rows, scaled)])
    slope, shift = calibrate(margins, good)
    return QualityModel(w * ratio, bias, slope, shift)


def calibrate(margins: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic curve through the margins, by Newton's method, with damped targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b += np.clip(np.linalg.solve(h, x.T @ (target - p) - 1e-3 * (b - [1, 0])), -1, 1)
    return float(max(b[0], 1e-3)), float(b[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = 2500,
) -> QualityModel:
    """Fit on a bounded sample (``per_class`` rows a class) of the labelled rows that may be learned.

    ``learn`` is a condition on the id.  Tasks turn whole texts into indicators; only those of
    the sample reach the driver.  Rows without a label, a text row or an id are not learned from;
    an id with several texts or labels counts once a label.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    sample = balanced_sample(known.where(learn & F.col("label").isin(0, 1)), per_class)

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        return texts.map(indicators)

    rows = (
        sampled_texts(bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), sample)
        .select("doc_id", "label", places("text").alias("places"))
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("label", "ascending")])
    )
    held = [x.values.to_numpy() for x in rows["places"]]
    return fit(held, np.array(rows["label"].to_pylist(), dtype=bool))


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """Add the score (0 to 1) of every whole text; null counts as empty.

    A column of that name is replaced, all others kept; all rows stay, repeated ones too; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    known: list[QualityModel] = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not known:  # once a task
            fresh_worker("quality")
            known.append(shared.value)
        return pd.Series(known[0].scores(texts.tolist()), dtype=float)

    return bounded_batches(docs).withColumn(name, score(F.col(text_col)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_bucket("doc_id", 3) == 1
    model = train(docs, labels, ~held_out)
    return with_quality(docs.select("doc_id", "text"), model, name="score").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
