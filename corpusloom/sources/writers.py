"""Sinks: address lists, records, reports and guarded results."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned_csv(df: DataFrame, path: str) -> None:
    df.select(F.col("url").alias("URL"), F.col("lat_raw").alias("Lat"), F.col("lng_raw").alias("Lng"), "coords_approx").write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_checked(df: DataFrame, path: str) -> None:
    """Appends to a CSV folder; columns that differ from what is there, or their order, are an error."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        have = spark.read.option("header", True).csv(path).columns
        if have != df.columns:
            raise ValueError(f"columns {df.columns} don't match {have}")
    df.write.mode("append").option("header", True).csv(path)


def results(df: DataFrame, path: str, allowed: tuple[str, ...]) -> None:
    """A result under one of the allowed folders, never over another."""
    if not any(path.startswith(a.rstrip("/") + "/") for a in allowed):
        raise ValueError(f"{path} is not among the result folders")
    df.write.mode("errorifexists").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table as Markdown; it is checked to be a report's size."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no report table")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def annotated_json(stats: DataFrame, rows: DataFrame, path: str, rows_file: str = "rows") -> None:
    """{stats} of one row as one JSON object in path/stats, and the rows, an object a line, in path/rows.

    Rows stay a distributed table beside the figures, as one object of all of them would pass through one task.
    """
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    rows.write.mode("overwrite").json(f"{path}/{rows_file}")


def review_report(flagged: DataFrame, path: str) -> None:
    """Counts of missing coordinates, and the addresses to be looked up by hand with reason and action."""
    review = F.count_if("needs_review")
    counts = flagged.agg((F.count_if(F.col("lat") == "") + review).alias("total_missing"), review.alias("unresolved"))
    rows = flagged.filter("needs_review").select("url", F.lit("coordinates could not be found automatically").alias("reason"), F.lit("look the place up and add its coordinates").alias("action"))
    annotated_json(counts, rows, path, "needs_manual_review")


def text_files(documents: DataFrame, path: str) -> None:
    """A file a document (doc_no, slug, text), named 000_slug.txt (wider beyond 999), in a folder that is emptied first.

    Tasks write their own documents by Spark's text writer, one document a file: each goes to a
    folder of its number and slug, which readers of names take for the file's name.
    """
    name = F.concat_ws("_", F.format_string("%03d", F.col("doc_no").cast("long")), F.substring(F.regexp_replace("slug", r"[^A-Za-z0-9_-]", "_"), 1, 60))
    documents.select(name.alias("name"), F.col("text").alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)


def json_document(row: DataFrame, path: str) -> None:
    """One JSON object, such as a summary: row must have one row."""
    if row.limit(2).count() != 1:
        raise ValueError("one row is needed")
    row.coalesce(1).write.mode("overwrite").json(path)


def table(df: DataFrame, path: str, most: int = 1000) -> str:
    """A report table as CSV below path, and as Markdown, which is returned."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return markdown(df, most)


def html_report(title: str, sections: DataFrame, pictures: DataFrame | None = None) -> str:
    """A page of sections (place, heading, body; a blank line parts paragraphs) and pictures (path, caption): a report, so it is built on the driver.

    The tables are checked to be a report's size. A null body leaves its section out.
    """
    def rows(df, *order):
        held = df.orderBy(*order).limit(1001).collect()
        if len(held) > 1000:
            raise ValueError("over 1000 rows are no report")
        return held

    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for r in rows(sections, "place"):
        if r["body"] is not None:
            paragraphs = "".join(f"<p>{html.escape(p.strip())}</p>" for p in r["body"].split("\n\n") if p.strip())
            out.append(f"<h2>{html.escape(r['heading'])}</h2>{paragraphs}")
    for r in rows(pictures, "path") if pictures is not None else ():
        out.append(f"<figure><img src='{html.escape(r['path'], quote=True)}'><figcaption>{html.escape(r['caption'] or '')}</figcaption></figure>")
    return "".join([*out, "</body></html>"])


def integrity(df: DataFrame, key: str, content: Column) -> DataFrame:
    """key and sha256 of each content, for a manifest before and after a run."""
    return df.select(key, F.sha2(content.cast("binary"), 256).alias("sha256"))
