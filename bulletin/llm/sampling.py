"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small


def balanced_sample(labels: DataFrame, per_class: int, most: int = 100_000) -> DataFrame:
    """About ``per_class`` distinct rows (doc_id, label) of each class, ``most`` rows of all classes at most.

    A row is in by the hash of its id, against a rate that its class's size gives, so no class is
    gathered anywhere; at most ``per_class`` x classes x 5/4 rows come out.
    """
    labels = labels.where("doc_id IS NOT NULL AND label IS NOT NULL")
    sizes = labels.groupBy("label").count()
    classes = max(1, sizes.count())
    per_class = max(1, min(per_class, most // classes))
    rate = F.lit(per_class) / F.col("count")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (
        labels.join(small(sizes), "label")
        .where(draw < rate)
        .select("doc_id", "label")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(min(most, per_class * classes * 5 // 4))
    )


def sampled_texts(texts: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, label, text) of the sample; of an id with several texts, one of them.

    ``texts`` has doc_id and text; the sample is bounded, so it is broadcast.
    """
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label")
    return found.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
