"""URL expressions. All parse by pattern, as parse_url is null on malformed addresses that the rules must still read."""

from __future__ import annotations

import html
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Scheme and host are optional, as addresses are listed in any form: host, path and query as groups.
PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def netloc(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, 1)


def path(url: Column) -> Column:
    """All up to query and fragment where no `//` tells a host, so `example.org/x` is a path."""
    return F.regexp_extract(F.trim(url), PARTS, 2)


def query_string(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, 3)


def dedup_key(url: Column) -> Column:
    """Host and path in lower case without any www., scheme, query, fragment or closing slashes."""
    u = F.lower(F.trim(url))
    return F.concat(F.replace(netloc(u), F.lit("www."), F.lit("")), F.regexp_replace(path(u), "/+$", ""))


def corpus_key(url: Column) -> Column:
    """Host without a leading www., path without one closing slash, and the query."""
    u = F.lower(F.trim(url))
    whole = path(u)
    short = F.when((F.length(whole) > 1) & whole.endswith("/"), F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    q = query_string(u)
    return F.concat(domain(u), short, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def domain(url: Column) -> Column:
    """Host in lower case without a leading www."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


#: Public suffixes of two labels that the addresses met so far need; a parameter wherever it is used.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "co.nz", "com.br", "co.jp")


def registrable_domain(url: Column, double_suffixes: tuple[str, ...] = DOUBLE_SUFFIXES) -> Column:
    """The label before the public suffix and that suffix; double_suffixes are the suffixes of two labels."""
    host = domain(url)
    two, three = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    return F.when(two.isin(*double_suffixes) & (three != ""), three).when(two != "", two).otherwise(host)


def tld(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r"\.([A-Za-z]+)$", 1)


def path_depth(url: Column) -> Column:
    """Non-empty path segments."""
    return F.size(F.filter(F.split(path(url), "/"), lambda x: x != "")).cast("long")


def extension(url: Column) -> Column:
    """From the last point of the last path segment, in lower case; a leading or closing point begins none."""
    return F.regexp_extract(F.regexp_extract(F.lower(path(url)), "([^/]+)/*$", 1), r"^.+(\.[^.]+)$", 1)


def decimal_places(raw: Column) -> Column:
    """Digits after the point of a number as written; 0 without a point, null for null or blank."""
    bare = F.trim(raw)
    return F.when(bare != "", F.length(F.regexp_extract(bare, r"(?s)^[^.]*\.(.*)$", 1)).cast("long"))


def file_slug(url: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/", "_"), 1, most)


def raw_file(url: Column) -> Column:
    """The name that a page is kept under: no scheme, slashes as underscores, nothing cut."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.trim(url), "^https?://", ""), "/", "_"), F.lit(".html"))


def links_within(url: str | None, hrefs: list[str]) -> list[str]:
    """Absolute links of hrefs on url's own host, without fragments, closing slashes and url itself, distinct in order."""
    out: dict[str, None] = {}
    try:
        base = urlsplit((url or "").strip())
        for href in hrefs:
            try:
                link = urljoin(base.geturl(), html.unescape(href).strip()).split("#")[0].rstrip("/")
                to = urlsplit(link)
            except ValueError:
                continue
            if to.scheme in ("http", "https") and to.netloc.lower() == base.netloc.lower() and link != base.geturl().split("#")[0].rstrip("/"):
                out[link] = None
    except ValueError:
        return []
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def internal_links(url: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([links_within(u, [] if h is None else list(h)) for u, h in zip(url, hrefs, strict=True)], index=url.index, dtype=object)


def suffix_rules(rules: DataFrame) -> DataFrame:
    """rules (rule: a public suffix, `*.` before one for any label there, `!` before an exception; # lines and blanks are comments) as key, extra and exception."""
    rule = F.lower(F.trim("rule"))
    kept = rules.select(rule.alias("rule")).filter("rule <> '' AND NOT startswith(rule, '//') AND NOT startswith(rule, '#')")
    extra = F.when(F.startswith("rule", F.lit("*.")), 1).when(F.startswith("rule", F.lit("!")), -1).otherwise(0)
    return kept.select(F.regexp_replace("rule", r"^(\*\.|!)", "").alias("key"), extra.alias("extra")).distinct()


def registrable_domains(rows: DataFrame, host: str, rules: DataFrame, most_sent: int = 100_000) -> DataFrame:
    """rows with registrable: the public suffix of a host by the longest rule that its labels meet, and the label before it.

    rules: see suffix_rules. An exception takes its own first label off the suffix, before all
    other rules. A host that meets no rule has no suffix: its last label stands, an IPv4 address
    whole. A host that is a suffix itself has no label before it, and begins with a dot. Null hosts
    have none. Hosts are looked up once each, by equality of their ends with a rule; few rules
    are sent to all tasks.
    """
    known = suffix_rules(rules)
    known = F.broadcast(known) if known.count() <= most_sent else known
    labels = F.split("host", r"\.")
    hosts = rows.select(F.lower(F.col(host)).alias("host")).filter("host IS NOT NULL").distinct().withColumns({"labels": labels, "n": F.size(labels)})
    ends = hosts.select("host", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("labels", F.col("n") - k + 1, k), ".").alias("key")))).alias("e")).select("host", "n", "e.depth", "e.key")
    met = ends.join(known, "key").withColumn("suffix", F.col("depth") + F.col("extra")).filter("suffix <= n")
    best = met.groupBy("host").agg(F.max(F.struct((F.col("extra") == -1).alias("exception"), "suffix"))["suffix"].alias("suffix"))
    took = F.when(F.col("suffix").isNull(), F.when(F.col("host").rlike(r"^\d+(\.\d+){3}$"), F.col("host")).otherwise(F.element_at("labels", -1)))
    took = took.when(F.col("suffix") == F.col("n"), F.concat(F.lit("."), F.col("host"))).otherwise(F.array_join(F.slice("labels", F.col("n") - F.col("suffix"), F.col("suffix") + 1), "."))
    found = hosts.join(best, "host", "left").select(F.col("host").alias("_host"), took.alias("registrable"))
    return rows.join(found, F.lower(F.col(host)) == F.col("_host"), "left").drop("_host")
