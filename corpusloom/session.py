"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "corpusloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; anything in settings (dots as double underscores) comes on top."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
