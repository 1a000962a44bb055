"""Operators on record tables: first occurrence, near duplicates, merged documents, levels, facts, leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import stats, text, urls
from corpusloom.operators import nearby
from corpusloom.operators.ordered import numbered, order_statistics, unused


def first_per_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row of least order of each key, null first; order must be unique in a key. Rows are compared before they are shuffled."""
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(order))
    return df.groupBy(key.alias(unused(df, "_key"))).agg(first.alias("_row")).select("_row.*")


def flag_near_duplicates(df: DataFrame, url: str, order: str) -> DataFrame:
    """is_duplicate and duplicate_of: the first address with the same dedup_key, null for that one itself."""
    keyed = df.withColumn("_key", urls.dedup_key(F.col(url)))
    # One row a repeated key; a popular address is split among tasks where the rows meet it.
    first = keyed.groupBy(F.col("_key").alias("_k")).agg(F.min(F.struct(F.col(order).alias("at"), F.col(url).alias("url"))).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    later = F.coalesce(~F.col(order).eqNullSafe(F.col("_first.at")), F.lit(False)) & F.col("_first").isNotNull()
    joined = keyed.join(first, F.col("_key").eqNullSafe(F.col("_k")), "left")
    return joined.withColumns({"is_duplicate": later, "duplicate_of": F.when(later, F.col("_first.url"))}).drop("_key", "_k", "_first", "_n")


def merge_by(df: DataFrame, key: str, body: str, order: str, per_part: int = 1000) -> DataFrame:
    """Documents merged by key: the primary is the longest, then the first; text joins all bodies, primary first.

    A merged text comes in parts of per_part documents (part, from 0), as one key may hold a
    large share of the table: key, part, primary (of the key), n_merged and merged (of the part).
    """
    body_ = F.coalesce(F.col(body), F.lit(""))
    rows = df.select(F.col(key), F.col(order).alias("_o"), body_.alias("_t"), (-F.length(body_)).alias("_l"))
    rows = numbered(rows, ["_l", "_o"], "_rank", [key])
    parts = rows.groupBy(key, F.floor((F.col("_rank") - 1) / per_part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("_rank", "_t"))).alias("p"), F.count("*").alias("n_merged"))
    primary = rows.filter("_rank = 1").select(F.col(key).alias("_k"), F.col("_o").alias("primary"))
    joined = parts.join(primary, F.col(key).eqNullSafe(F.col("_k")))
    return joined.select(key, "part", "primary", "n_merged", F.array_join(F.transform("p", lambda x: x["_t"]), "\n\n").alias("merged"))


def prepared(pages: DataFrame, key: str, order: str) -> DataFrame:
    """A document of each key's pages (url, body): key, part, n_merged and text; the longest page leads with a header, others follow as sections."""
    n = F.length("body")
    lead = pages.groupBy(key).agg(F.min(F.struct((-n).alias("l"), F.col(order).alias("o")))["o"].alias("_lead"))
    first = F.concat(F.lit("# "), "url", F.lit("\n\nFull text:\n"), "body")
    rest = F.concat(F.lit("--- Additional page: "), "url", F.lit(" ---\n"), "body")
    rows = pages.join(lead, key).withColumn("_leads", F.col(order) == F.col("_lead"))
    ranked = numbered(rows.withColumn("_l", -n), ["_l", order], "_rank", [key])
    parts = ranked.groupBy(key, F.floor((F.col("_rank") - 1) / 1000).alias("part")).agg(F.array_sort(F.collect_list(F.struct("_rank", F.when(F.col("_leads"), first).otherwise(rest).alias("t")))).alias("p"), F.count("*").alias("n_merged"))
    return parts.select(key, "part", "n_merged", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def levels(df: DataFrame, value: str, by: list[str] | None = None, shares: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """Adds level by the index order statistics of the whole table, or of each group of by.

    The two thresholds are aggregates joined back, so no partition holds all rows.
    """
    limits = order_statistics(df, value, {"_low": shares[0], "_high": shares[1]}, by)
    joined = df.join(limits, by) if by else df.crossJoin(F.broadcast(limits))  # one row
    return joined.withColumn("level", stats.level(F.col(value), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def popularity(body: Column, high: list[str], medium: list[str], low: list[str]) -> Column:
    """struct(max_quantity, high, medium, low, text_length, has_numbers, score) of a text.

    Words with a space are found as they stand, others at word boundaries. score: 3 for each
    high word, 1 for each medium, -1 for each low one, 2 for a quantity over 100 and 1 over 10,
    1 for more than 1000 characters.
    """
    full = F.coalesce(body, F.lit(""))
    found = F.transform(F.regexp_extract_all(full, F.lit(r"(?i)\b(\d{2,6})\s*(?:people|members|volunteers|families|meals|kg|tonnes)"), F.lit(1)), lambda x: x.cast("long"))
    most = F.coalesce(F.array_max(found), F.lit(0).cast("long"))
    count = lambda words: sum((text.keyword_present(full, w).cast("long") for w in words), F.lit(0).cast("long"))
    h, m, l, n = count(high), count(medium), count(low), F.length(full).cast("long")  # noqa: E741
    score = 3 * h + m - l + F.when(most > 100, 2).otherwise(0) + F.when(most > 10, 1).otherwise(0) + F.when(n > 1000, 1).otherwise(0)
    return F.struct(most.alias("max_quantity"), h.alias("high"), m.alias("medium"), l.alias("low"), n.alias("text_length"), (F.size(found) > 0).alias("has_numbers"), score.cast("long").alias("score"))


def keyword_dimensions(df: DataFrame, body: str, dimensions: dict[str, list[str]], by: list[str] | None = None) -> DataFrame:
    """Long form: dimension, n_docs with any of its words, pct of all; one pass over the texts."""
    by = by or []
    counted = df.groupBy(*by).agg(F.count("*").alias("_all"), *[F.count_if(text.any_keyword(F.col(body), w)).alias(k) for k, w in dimensions.items()])
    stack = ", ".join(f"'{k}', `{k}`" for k in dimensions)
    long = counted.select(*by, "_all", F.expr(f"stack({len(dimensions)}, {stack}) AS (dimension, n_docs)"))
    return long.select(*by, "dimension", "n_docs", F.round(F.when(F.col("_all") > 0, 100.0 * F.col("n_docs") / F.col("_all")).otherwise(0.0), 1).alias("pct"))


def herfindahl(df: DataFrame, key: Column) -> DataFrame:
    n = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return n.agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("hhi"), F.count("*").alias("n_keys"), F.count_if(F.col("n") == 1).alias("n_single"))


def locate(points: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """The box of each point: the containing one of nearest centre, else the nearest of all (`nearest`); no coordinates: `no_coords`.

    boxes: name, min_lng, min_lat, max_lng, max_lat. Ties go to the first name.
    """
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("min_lng", "min_lat"), corner("max_lng", "min_lat"), corner("max_lng", "max_lat"), corner("min_lng", "max_lat"), corner("min_lng", "min_lat"))
    return nearby.locate(points, numbered(boxes.select("name", F.array(ring).alias("rings")), ["name"], "ord"), key)


#: Names' runs of words up to this number are sent to all tasks; more are met by a shuffle.
MOST_SENT = 200_000


def shingle_leaks(docs: DataFrame, doc_key: str, body: str, names: DataFrame, name_key: str, name_body: str, n: int = 5) -> DataFrame:
    """Pairs that share runs of n words, with their number; an equi-join on the runs, after the size of the names' side is checked."""
    left = docs.select(doc_key, F.explode(text.shingles(F.col(body), n)).alias("s"))
    right = names.select(name_key, F.explode(text.shingles(F.col(name_body), n)).alias("s"))
    right = F.broadcast(right) if right.limit(MOST_SENT + 1).count() <= MOST_SENT else right
    return left.join(right, "s").groupBy(doc_key, name_key).agg(F.count("*").alias("n_shared"))


def manifest_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """NEW, DISAPPEARED and CHANGED keys between two tables of digests."""
    b, a = before.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_in_b")), after.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_in_a"))
    change = F.when(F.col("_in_b").isNull(), "NEW").when(F.col("_in_a").isNull(), "DISAPPEARED").when(~F.col("_a").eqNullSafe(F.col("_b")), "CHANGED")
    return b.join(a, key, "full").select(key, change.alias("change")).filter("change is not null")


def edge_degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, degree; a self loop counts twice."""
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def hash_sample(df: DataFrame, key: str, by: list[str], k: int, salt: str = "s") -> DataFrame:
    """k rows of each group, the same for the same salt: the least md5 of key and salt."""
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(salt)).cast("binary"))
    w = Window.partitionBy(*by).orderBy(order, key)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def equal_allocation(strata: DataFrame, keys: list[str], cap: str, total: int) -> DataFrame:
    """strata with alloc: the highest level at which strata of at most their size take no more than total together.

    What is then left over goes one each to strata with rows left, by the md5 of their keys.
    Strata are counted by size first, so the levels meet at most total sizes.
    """
    levels_ = strata.sparkSession.range(total + 1).withColumnRenamed("id", "_v")
    sizes = strata.groupBy(F.least(cap, F.lit(total)).alias("_size")).agg(F.count("*").alias("_k"))
    used = sizes.join(F.broadcast(levels_)).groupBy("_v").agg(F.sum(F.col("_k") * F.least("_size", "_v")).alias("_used"))
    level = used.filter(F.col("_used") <= total).agg(F.max(F.struct("_v", "_used")).alias("_l")).select("_l.*")
    filled = strata.crossJoin(F.broadcast(level))  # one row
    order = [F.md5(F.concat_ws(":", *keys).cast("binary")), *keys]
    first = numbered(filled.filter(F.col(cap) > F.col("_v")), order, "_rn").filter(F.col("_rn") <= total - F.col("_used"))
    extra = first.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(1).alias("_one"))
    joined = filled.join(extra, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    return joined.select(*strata.columns, (F.least(cap, "_v") + F.coalesce("_one", F.lit(0))).cast("long").alias("alloc"))


def confusion(df: DataFrame, a: str, b: str, classes: list) -> DataFrame:
    """All cells of classes x classes, zeros included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x, y) for x in classes for y in classes], f"{a} {dict(df.dtypes)[a]}, {b} {dict(df.dtypes)[b]}")
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return grid.join(counts, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and Cohen's kappa over any number of classes; rows with a null on either side are left out."""
    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = known.groupBy(a, b).agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = pairs.groupBy(F.col(a).alias("c")).agg(F.sum("n").alias("x"))
    right = pairs.groupBy(F.col(b).alias("c")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "c").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("chance"))
    po = F.col("same") / F.col("total")
    pe = F.col("chance") / (F.col("total").cast("double") * F.col("total"))
    return total.crossJoin(chance).select(F.col("total").alias("n"), F.round(po, 6).alias("agreement"), F.round(stats.kappa(po, pe), 6).alias("kappa"))


def two_raters(cells: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """cells (both, first only, second only, neither) with pct of agreement and Cohen's kappa; null kappa where chance agreement is whole."""
    w, x, y, z = (F.col(k).cast("double") for k in (a, b, c, d))
    n = w + x + y + z
    chance = (w + x) * (w + y) + (y + z) * (x + z)
    kappa_ = F.when(chance != n * n, ((w + z) / n - chance / (n * n)) / (1 - chance / (n * n)))
    return cells.withColumns({"pct": F.round(100 * (w + z) / n, 1), "kappa": F.round(kappa_, 6)})


def set_overlap(df: DataFrame, item: str, side: str, a, b, by: list[str] | None = None) -> DataFrame:
    """only_a, only_b, both, either and pct (Jaccard in percent) of the item sets of two sides."""
    by = by or []
    sides = df.filter(F.col(side).isin(a, b)).groupBy(*by, item).agg(F.max(F.col(side) == a).alias("in_a"), F.max(F.col(side) == b).alias("in_b"))
    both = F.count_if(F.col("in_a") & F.col("in_b"))
    return sides.groupBy(*by).agg(F.count_if(~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a")).alias("only_b"), both.alias("both_sides"), F.count("*").alias("either_side"), F.round(F.when(F.count("*") > 0, 100.0 * both / F.count("*")), 1).alias("pct"))


def replicate_pairs(df: DataFrame, replicate: str, item: str, by: list[str] | None = None) -> DataFrame:
    """All pairs a < b of the replicates of each group of by: by, a, b, shared items, pct (Jaccard in percent).

    df (by, replicate, item) holds distinct rows. Replicates are few, so their pairs are a small
    table; items meet by equality.
    """
    by = by or []
    s = df.select(*by, F.col(replicate).alias("a"), F.col(item).alias("_i"))
    n = s.groupBy(*by, "a").agg(F.count("*").alias("na"))
    other = n.select(*by, F.col("a").alias("b"), F.col("na").alias("nb"))
    pairs = (n.join(other, by) if by else n.crossJoin(F.broadcast(other))).filter("a < b")
    shared = s.join(s.withColumnRenamed("a", "b"), [*by, "_i"]).filter("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0).cast("long"))
    return pairs.join(shared, [*by, "a", "b"], "left").select(*by, "a", "b", k.alias("shared"), F.round(100.0 * k / (F.col("na") + F.col("nb") - k), 1).alias("pct"))


def chunks(df: DataFrame, key: str, body: str, size: int = 1800, overlap: int = 100) -> DataFrame:
    """Windows of size white-space tokens that overlap: key, chunk (from 0), text; empty texts have none."""
    w = df.select(key, F.filter(F.split(F.coalesce(F.col(body), F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda x: x != "").alias("w"))
    n = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / (size - overlap))).cast("int")
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return w.select(key, "w", F.explode(starts).alias("chunk")).select(key, "chunk", F.array_join(F.slice("w", F.col("chunk") * (size - overlap) + 1, F.lit(size)), " ").alias("text"))


def evidence(facts: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Numbers that a text may state, as (g, k, v, kind): values, sums of any two and of three of a group, and percentages.

    A percentage is of the total of all facts: of a value, or of two or three of a group.
    Sums are equi-joins but for those across groups, which the table of one report, some
    ninety facts, bounds; that it is small is checked.
    """
    n = facts.count()
    if n > 2000:
        raise ValueError(f"evidence: {n} facts")
    f = facts.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    a, b, c = f.alias("a"), f.alias("b"), f.alias("c")
    two = a.join(b, F.col("a.g") == F.col("b.g")).filter("a.k < b.k").select("a.g", F.concat_ws("+", "a.k", "b.k").alias("k"), (F.col("a.v") + F.col("b.v")).alias("v"))
    across = a.join(F.broadcast(b), F.col("a.g") < F.col("b.g")).select(F.concat_ws("|", "a.g", "b.g").alias("g"), F.concat_ws("+", "a.k", "b.k").alias("k"), (F.col("a.v") + F.col("b.v")).alias("v"))
    three = a.join(b, F.col("a.g") == F.col("b.g")).join(c, F.col("a.g") == F.col("c.g")).filter("a.k < b.k AND b.k < c.k")
    three = three.select("a.g", F.concat_ws("+", "a.k", "b.k", "c.k").alias("k"), (F.col("a.v") + F.col("b.v") + F.col("c.v")).alias("v"))
    total = f.agg(F.sum("v").alias("t"))
    parts = f.union(two).union(three).crossJoin(F.broadcast(total)).filter("t > 0")  # one row
    pct = parts.select("g", "k", F.round(100 * F.col("v") / F.col("t"), 4).alias("v"), F.lit("pct").alias("kind"))
    sums = two.union(across).union(three).withColumn("kind", F.lit("sum"))
    return f.withColumn("kind", F.lit("value")).unionByName(sums).unionByName(pct)


def label_claims(claims: DataFrame, found: DataFrame, tolerance: float = 0.55) -> DataFrame:
    """claim_id and label of every row of claims (claim_id, v, is_pct), rows that repeat a claim_id included.

    DIRECT (an equal value), DERIVED (an equal sum; for a percentage one within tolerance) or
    NOT_MACHINE_AUDITABLE. Each distinct (v, is_pct) is labelled once: values and sums meet by
    equality, percentages by strips as wide as the tolerance, a claim in three of them.
    """
    c = claims.select("v", "is_pct").distinct()
    e = found.select(F.col("v").alias("_e"), "kind")
    exact = e.filter("kind <> 'pct'").groupBy(F.round("_e", 6).alias("_at")).agg(F.min(F.when(F.col("kind") == "value", 0).otherwise(1)).alias("_exact"))
    strip = lambda x: F.floor(x / tolerance)
    pct = e.filter("kind = 'pct'").select("_e", strip(F.col("_e")).alias("_strip")).distinct()
    near = c.filter("is_pct").select("v", F.explode(F.array(*[strip(F.col("v")) + k for k in (-1, 0, 1)])).alias("_strip"))
    near = near.join(pct, "_strip").filter(F.abs(F.col("v") - F.col("_e")) <= tolerance).select(F.col("v").alias("_near")).distinct()
    graded = c.withColumn("_at", F.round("v", 6)).join(exact, "_at", "left").join(near, c["v"] == near["_near"], "left")
    grade = F.when(F.col("_exact") == 0, 0).when(F.when(F.col("is_pct"), F.col("_near").isNotNull()).otherwise(F.col("_exact") == 1), 1).otherwise(2)
    best = graded.select(F.col("v").alias("_v"), F.col("is_pct").alias("_is_pct"), grade.alias("grade"))
    rows = claims.join(best, F.col("v").eqNullSafe(F.col("_v")) & F.col("is_pct").eqNullSafe(F.col("_is_pct")), "left")
    return rows.select("claim_id", F.when(F.col("grade") == 0, "DIRECT").when(F.col("grade") == 1, "DERIVED").otherwise("NOT_MACHINE_AUDITABLE").alias("label"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, query_block: int = 1024, vector_block: int = 16384) -> DataFrame:
    """query_id, vec_id, cosine (6 places) and rank of the k nearest vectors (vec_id, v) of each of queries (query_id, q), but for itself.

    Exact: every query meets every vector, in tasks of about query_block by vector_block that
    each give a query k rows at most. Vectors that are null or zero, and pairs of different
    lengths, have no cosine and take no part. Ties go to the lesser vec_id.
    """
    import numpy as np
    import pandas as pd

    blocks = -(-queries.count() // query_block) or 1
    slices = -(-vectors.count() // vector_block) or 1
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query_id", "q", place("query_id", blocks).alias("block"), every(slices).alias("slice"))
    held = vectors.select("vec_id", "v", place("vec_id", slices).alias("slice"), every(blocks).alias("block"))

    def by_length(ids, values):
        groups: dict = {}
        for key, x in zip(ids, values, strict=True):
            if x is not None and (a := np.asarray(x, dtype=np.float64)).size and np.linalg.norm(a) > 0:
                groups.setdefault(a.size, []).append((key, a))
        return {n: (np.array([key for key, _ in g], dtype=np.int64), np.stack([a for _, a in g])) for n, g in groups.items()}

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = []
        theirs = by_length(v["vec_id"], v["v"])
        for n, (query_ids, qs) in by_length(q["query_id"], q["q"]).items():
            if n not in theirs:
                continue
            ids, vs = theirs[n]
            squares = (vs * vs).sum(axis=1)
            for query_id, x in zip(query_ids, qs, strict=True):
                cosine = np.round(vs @ x / np.sqrt((x @ x) * squares), 6)
                top = np.lexsort((ids, -cosine))
                top = top[ids[top] != query_id][:k]
                found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[top], "cosine": cosine[top]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []})

    near = asked.groupBy("block", "slice").cogroup(held.groupBy("block", "slice")).applyInPandas(best, "query_id long, vec_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
