"""Connected components of a link table, by contraction in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(``id``, ``label``) for every id that occurs in the links (``a``, ``b``): the component's smallest id.

    In each round every label hooks to the smallest label beside it, pointers are jumped until
    they are flat, and the links are rewritten to the new labels; links inside one label vanish.
    The number of rounds grows with the logarithm of the longest chain.  Nothing is collected.
    """
    links = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = stored(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(
            both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("old"), F.least("a", "b").alias("new")), "hooks"
        )
        while True:
            beyond = hooks.select(F.col("old").alias("new"), F.col("new").alias("root"))
            jumped = stored(hooks.join(beyond, "new").select("old", F.col("root").alias("new"), (F.col("root") != F.col("new")).alias("moved")), "hooks")
            hooks = jumped.select("old", "new")
            if jumped.where("moved").isEmpty():
                break
        labels = stored(
            labels.join(hooks, labels["label"] == hooks["old"], "left").select("id", F.coalesce("new", "label").alias("label")), "labels"
        )
        left = hooks.select(F.col("old").alias("a"), F.col("new").alias("x"))
        right = hooks.select(F.col("old").alias("b"), F.col("new").alias("y"))
        links = stored(links.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    return labels
