"""A streaming front door for newly fetched pages: stateless screening, then first-seen by address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text, urls


def screened(pages: DataFrame) -> DataFrame:
    """Pages (url, html, fetched_at) with title, visible length and blocked; works on batches and streams."""
    return pages.withColumns({"title": text.title(F.col("html")), "chars": F.length(text.visible_text(F.col("html"))), "blocked": text.challenged(F.col("html"))})


def first_seen(pages: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first page of each normalised address within the watermark; state is bounded by it."""
    keyed = pages.withColumn("url_key", urls.dedup_key(F.col("url"))).withWatermark("fetched_at", lateness)
    return keyed.dropDuplicatesWithinWatermark(["url_key"])
