"""A Spark session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "bulletin", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skewed joins split; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
