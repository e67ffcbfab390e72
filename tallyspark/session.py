"""Session builder with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallyspark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session time zone and adaptive execution; ``conf`` keys use double underscores for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
