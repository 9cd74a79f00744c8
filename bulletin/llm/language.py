"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of character n-grams (of one to
three, lower-cased, hashed to 2**16) that both hold, over the root of the product of what each
holds.  Nystroem landmarks map texts to vectors whose products approximate the kernel; one ridge
regression against each language's rest scores them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams
from .common import bounded_batches, fresh_names, fresh_worker, id_bucket, table
from .sampling import balanced_sample, sampled_texts

ORDERS = (1, 2, 3)
LETTER = regex.compile(r"\p{L}")
BATCH = 128


@dataclass
class LanguageModel:
    """Scores for a batch X of presence rows: softmax((X L^T / norms) W)."""

    names: list[str]
    columns: np.ndarray  # hashed n-grams that a landmark holds
    landmarks: np.ndarray  # float32, columns x landmarks, each column divided by its norm
    weights: np.ndarray  # landmarks x languages: whitening and ridge weights in one
    sharpness: float = 6.0

    def decide(self, x: np.ndarray) -> np.ndarray:
        held = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float32), 1))[:, None]
        return (x[:, self.columns].astype(np.float32) @ self.landmarks / held) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        told = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.names else []
        for start in range(0, len(told), BATCH):
            some = told[start : start + BATCH]
            margins = self.sharpness * self.decide(grams.rows([texts[i].lower() for i in some], ORDERS))
            p = np.exp(margins - margins.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, best, row in zip(some, p.argmax(axis=1).tolist(), p):
                names[i], scores[i] = self.names[best], float(row[best])
        return names, scores


def places(text: str) -> np.ndarray | None:
    """Sorted places of the n-grams that a text holds; None without a letter."""
    return np.flatnonzero(grams.rows([text.lower()], ORDERS)[0]).astype(np.int32) if LETTER.search(text) else None


def fit(texts: list[str], labels: list[str], ridge: float = 1e-3) -> LanguageModel:
    """:func:`fit_places` on the texts that have a letter."""
    known = [(p, label) for p, label in ((places(t), label) for t, label in zip(texts, labels)) if p is not None]
    return fit_places([p for p, _ in known], [label for _, label in known], ridge=ridge)


def dense(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), 1 << grams.BITS), dtype=bool)
    for i, p in enumerate(rows):
        out[i, p] = True
    return out


def fit_places(rows: list[np.ndarray], labels: list[str], landmarks: int = 192, ridge: float = 1e-3) -> LanguageModel:
    """Kernel ridge regression on presence rows.

    ``landmarks`` of them, or 16 a language if that is more, are Nystroem landmarks, taken from
    all languages in turn.
    """
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros(0, int), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    by_name: dict[str, list[int]] = {n: [] for n in names}
    for i, label in enumerate(labels):
        by_name[label].append(i)
    turn = [by_name[n][k] for k in range(max(map(len, by_name.values()))) for n in names if k < len(by_name[n])]
    chosen = dense([rows[i] for i in turn[: max(landmarks, 16 * len(names))]])
    columns = np.flatnonzero(chosen.any(axis=0))
    norms = np.sqrt(np.maximum(chosen.sum(axis=1), 1)).astype(np.float32)
    basis = (chosen[:, columns] / norms[:, None]).astype(np.float32).T
    model = LanguageModel(names, columns, np.ascontiguousarray(basis), np.eye(basis.shape[1]))
    kernel = np.concatenate([model.decide(dense(rows[k : k + BATCH])) for k in range(0, len(rows), BATCH)])
    values, vectors = np.linalg.eigh(basis.T.astype(float) @ basis)
    large = values > 1e-6 * values.max()
    whiten = vectors[:, large] / np.sqrt(values[large])
    z = kernel @ whiten
    targets = np.where(np.array(labels)[:, None] == np.array(names), 1.0, -1.0)
    share = np.array([1 / len(by_name[label]) for label in labels])[:, None]  # every language counts alike
    normal = (z * share).T @ z + ridge * len(names) * np.eye(z.shape[1])
    model.weights = whiten @ np.linalg.solve(normal, (z * share).T @ targets)
    return model


def train(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = 400, most: int = 100_000) -> LanguageModel:
    """Fit on a bounded sample of the rows where ``learn`` (a column) holds.

    Learns from text and non-null language only, every language of these rows; at most
    ``per_class`` x languages x 5/4 and ``most`` rows.  Tasks turn whole texts into the places of
    their n-grams; only these reach the driver.  Of an id with several texts one is learned from.
    """
    known = bounded_batches(docs).where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    sample = balanced_sample(rows.select("doc_id", "label"), per_class, most).groupBy("doc_id").agg(F.min("label").alias("label"))

    @F.pandas_udf("array<int>")
    def held(texts: pd.Series) -> pd.Series:
        return texts.map(places)

    found = (
        sampled_texts(rows.select("doc_id", "text"), sample)
        .select("doc_id", "label", held("text").alias("places"))
        .where("places IS NOT NULL")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("label", "ascending")])
    )
    return fit_places([x.values.to_numpy() for x in found["places"]], found["label"].to_pylist())


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """Add ``lang_pred`` and ``lang_score`` by the whole text alone.

    A null text or one without a letter is ``und`` with score 0, as is every text if nothing was
    learned.  Columns of those names are replaced, all others kept; all rows stay, repeated ones
    too; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    known: list[LanguageModel] = []
    told_name = fresh_names(docs, "told")[0]

    @F.pandas_udf("pred string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        if not known:  # once a task
            fresh_worker("language")
            known.append(shared.value)
        names, scores = known[0].predict(texts.tolist())
        return pd.DataFrame({"pred": names, "score": scores})

    return bounded_batches(docs).withColumn(told_name, told(F.col(text_col))).withColumns(
        {f"{prefix}pred": F.col(f"{told_name}.pred"), f"{prefix}score": F.col(f"{told_name}.score")}
    ).drop(told_name)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 4) == 2
    model = train(docs, ~held_out)
    return with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
