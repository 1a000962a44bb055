"""Queries on coordinates, facts, graphs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import geo, urls
from corpusloom.operators import corpus
from corpusloom.plans.common import BOXES, BOXES_SQL, POINTS_SQL, boxes, points, t
from corpusloom.plans.registry import query

MX, MY = "6378137.0 * radians({0})", "6378137.0 * ln(tan(radians({0}) / 2 + 0.7853981633974483))"
HAVERSINE = "2 * 6371008.8 * asin(sqrt(pow(sin(radians({1}.lat - {0}.lat) / 2), 2) + cos(radians({0}.lat)) * cos(radians({1}.lat)) * pow(sin(radians({1}.lng - {0}.lng) / 2), 2)))"
LOCATE = f"""WITH b AS (SELECT *, ({MX.format('min_lng')} + {MX.format('max_lng')}) / 2 AS cx, ({MY.format('min_lat')} + {MY.format('max_lat')}) / 2 AS cy FROM {BOXES_SQL}), p AS (SELECT * FROM {POINTS_SQL}),
c AS (SELECT page_id, name, NOT (lng > min_lng AND lng < max_lng AND lat > min_lat AND lat < max_lat) AS outside, pow({MX.format('lng')} - cx, 2) + pow({MY.format('lat')} - cy, 2) AS away FROM p, b WHERE lat IS NOT NULL AND lat <> 0 AND lng <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY outside, away, name) AS rn FROM c)
SELECT page_id, name AS district, CASE WHEN outside THEN 'nearest' ELSE 'exact' END AS match_type FROM r WHERE rn = 1 UNION ALL SELECT page_id, 'Not Specified', 'no_coords' FROM p WHERE lat IS NULL OR lat = 0 OR lng = 0"""


@query("j02_point_in_rect", LOCATE)
def j02(spark, d):
    return corpus.locate(points(spark, d), boxes(spark), "page_id")


@query("f36_geofence_counts", f"SELECT match_type, count(*) AS n FROM ({LOCATE}) GROUP BY 1")
def f36(spark, d):
    return j02(spark, d).groupBy("match_type").agg(F.count("*").alias("n"))


IN_ORDER = f"list_position([{', '.join(repr(b[0]) for b in BOXES)}], name)"


@query("j03_first_polygon", f"WITH c AS (SELECT page_id, arg_min(name, {IN_ORDER}) AS district FROM {POINTS_SQL} p JOIN {BOXES_SQL} ON lng BETWEEN min_lng AND max_lng AND lat BETWEEN min_lat AND max_lat GROUP BY 1) SELECT district, count(*) AS n FROM c GROUP BY 1")
def j03(spark, d):
    """The first box of the list that holds a point, edges included."""
    b = F.broadcast(boxes(spark).withColumn("ord", F.array_position(F.array(*[F.lit(x[0]) for x in BOXES]), F.col("name"))))
    hit = points(spark, d).join(b, F.col("lng").between(F.col("min_lng"), F.col("max_lng")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat")))
    return hit.groupBy("page_id").agg(F.min_by("name", "ord").alias("district")).groupBy("district").agg(F.count("*").alias("n"))


@query("j18_cross_bbox", f"SELECT b.name AS a, c.name AS b, count(*) AS n FROM {POINTS_SQL} p JOIN {BOXES_SQL} ON lng BETWEEN b.min_lng AND b.max_lng AND lat BETWEEN b.min_lat AND b.max_lat JOIN {BOXES_SQL.replace('AS b(', 'AS c(')} ON b.name < c.name AND lng BETWEEN c.min_lng AND c.max_lng AND lat BETWEEN c.min_lat AND c.max_lat GROUP BY ALL")
def j18(spark, d):
    inside = lambda a: F.col("lng").between(F.col(f"{a}.min_lng"), F.col(f"{a}.max_lng")) & F.col("lat").between(F.col(f"{a}.min_lat"), F.col(f"{a}.max_lat"))
    b, c = F.broadcast(boxes(spark)).alias("b"), F.broadcast(boxes(spark)).alias("c")
    return points(spark, d).join(b, inside("b")).join(c, (F.col("b.name") < F.col("c.name")) & inside("c")).groupBy(F.col("b.name").alias("a"), F.col("c.name").alias("b")).agg(F.count("*").alias("n"))


@query("a24_coordinate_coverage", f"SELECT count(*) AS n, count_if(lat IS NOT NULL AND lat <> 0 AND lng <> 0)::BIGINT AS located, round(100.0::DOUBLE * count_if(lat IS NOT NULL AND lat <> 0 AND lng <> 0) / count(*), 1) AS pct FROM {POINTS_SQL}")
def a24(spark, d):
    known = F.count_if(~geo.missing(F.col("lat"), F.col("lng")))
    return points(spark, d).agg(F.count("*").alias("n"), known.alias("located"), F.round(100.0 * known / F.count("*"), 1).alias("pct"))


@query("a25_coord_precision", "WITH n AS (SELECT length(regexp_extract(CASE WHEN page_id % 3 = 0 THEN '51.5' ELSE '51.' || (page_id % 900 + 100) END, '\\.([0-9]+)$', 1))::BIGINT AS dp, count(*) AS n FROM pages GROUP BY 1) SELECT dp, n, round(n / sum(n) OVER (), 6)::DOUBLE AS share FROM n ORDER BY n DESC, dp LIMIT 1")
def a25(spark, d):
    raw = F.when(F.col("page_id") % 3 == 0, "51.5").otherwise(F.concat(F.lit("51."), F.col("page_id") % 900 + 100))
    n = t(spark, d, "pages").groupBy(urls.decimal_places(raw).alias("dp")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.orderBy(F.desc("n"), "dp").limit(1).crossJoin(F.broadcast(total)).select("dp", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("a26_granularity", f"WITH n AS (SELECT lat, lng, count(*) AS n FROM {POINTS_SQL} WHERE lat IS NOT NULL GROUP BY ALL) SELECT count(*) AS n_points, max(n) AS largest, coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS shared FROM n")
def a26(spark, d):
    n = points(spark, d).filter("lat IS NOT NULL").groupBy("lat", "lng").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_points"), F.max("n").alias("largest"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("shared"))


@query("x35_geo_reasoning", f"SELECT page_id, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS hemisphere, CASE WHEN abs(lat) < 23.5 THEN 'tropical' WHEN abs(lat) < 66.5 THEN 'temperate' ELSE 'polar' END AS band FROM {POINTS_SQL} WHERE lat IS NOT NULL")
def x35(spark, d):
    p = points(spark, d).filter("lat IS NOT NULL")
    return p.select("page_id", F.when(F.col("lat") >= 0, "N").otherwise("S").alias("hemisphere"), geo.latitude_band(F.col("lat")).alias("band"))


FACTS_SQL = "(SELECT o_orderpriority AS g, o_orderstatus AS k, count(*)::DOUBLE AS v FROM orders GROUP BY ALL)"
EVIDENCE = f"""WITH f AS (SELECT * FROM {FACTS_SQL}), s2 AS (SELECT a.g, a.k || '+' || b.k AS k, a.v + b.v AS v FROM f a JOIN f b ON a.g = b.g AND a.k < b.k), s3 AS (SELECT a.g, a.k || '+' || b.k || '+' || c.k AS k, a.v + b.v + c.v AS v FROM f a JOIN f b ON a.g = b.g AND a.k < b.k JOIN f c ON c.g = a.g AND b.k < c.k), x AS (SELECT a.g || '|' || b.g AS g, a.k || '+' || b.k AS k, a.v + b.v AS v FROM f a JOIN f b ON a.g < b.g)
SELECT g, k, v, 'value' AS kind FROM f UNION ALL SELECT *, 'sum' FROM s2 UNION ALL SELECT *, 'sum' FROM s3 UNION ALL SELECT *, 'sum' FROM x UNION ALL SELECT g, k, round(100 * v / (SELECT sum(v) FROM f), 4), 'pct' FROM (SELECT * FROM f UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""


def facts(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("v"))


@query("x21_evidence", EVIDENCE)
def x21(spark, d):
    return corpus.evidence(facts(spark, d), "g", "k", "v")


CLAIMS = "(SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_quantity * (1 + l_orderkey % 40) AS v, l_linenumber % 2 = 0 AS is_pct FROM lineitem)"


@query("j13_label_claims", f"WITH e AS ({EVIDENCE}), c AS (SELECT * FROM {CLAIMS}), v AS (SELECT DISTINCT v, is_pct FROM c), g AS (SELECT v.v, v.is_pct, min(CASE WHEN kind = 'value' THEN 0 WHEN kind IS NOT NULL THEN 1 ELSE 2 END) AS grade FROM v LEFT JOIN e ON (round(v.v, 6) = round(e.v, 6) AND (kind = 'value' OR (kind = 'sum' AND NOT is_pct))) OR (is_pct AND kind = 'pct' AND abs(v.v - e.v) <= 0.55) GROUP BY ALL) SELECT claim_id, CASE grade WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'DERIVED' ELSE 'NOT_MACHINE_AUDITABLE' END AS label FROM c JOIN g USING (v, is_pct)")
def j13(spark, d):
    c = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), (F.col("l_quantity") * (1 + F.col("l_orderkey") % 40)).alias("v"), (F.col("l_linenumber") % 2 == 0).alias("is_pct"))
    return corpus.label_claims(c, x21(spark, d))


@query("a12_facts_pivot", "SELECT o_orderpriority AS g, count(*) AS n, count_if(o_orderstatus = 'F')::BIGINT AS n_f, count_if(o_orderstatus = 'O')::BIGINT AS n_o, count_if(o_orderstatus = 'P')::BIGINT AS n_p, round(100.0::DOUBLE * count_if(o_orderstatus = 'F') / count(*), 1) AS pct_f FROM orders GROUP BY 1")
def a12(spark, d):
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("g")).agg(F.count("*").alias("n"), is_("F").alias("n_f"), is_("O").alias("n_o"), is_("P").alias("n_p"), F.round(100.0 * is_("F") / F.count("*"), 1).alias("pct_f"))


@query("a21_ratio_rollup", "SELECT coalesce(l_returnflag, 'ALL_POOLED') AS grp, count(*) AS n, round(sum(l_discount) / sum(l_tax), 4) AS ratio FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def a21(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_discount") / F.sum("l_tax"), 4).alias("ratio")).select(F.coalesce("l_returnflag", F.lit("ALL_POOLED")).alias("grp"), "n", "ratio")


@query("a30_attrition_funnel", "SELECT stage, n, round(100.0::DOUBLE * n / max(n) OVER (), 1) AS pct FROM (SELECT unnest(['all', 'valued', 'large']) AS stage, unnest([count(*), count(value), count_if(value > 50)::BIGINT])::BIGINT AS n FROM events)")
def a30(spark, d):
    n = t(spark, d, "events").agg(F.count("*").alias("a"), F.count("value").alias("b"), F.count_if(F.col("value") > 50).alias("c"))
    return n.select("a", F.expr("stack(3, 'all', a, 'valued', b, 'large', c) AS (stage, n)")).select("stage", "n", F.round(100.0 * F.col("n") / F.col("a"), 1).alias("pct"))


@query("g04_graph_build", "SELECT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b, count(*) AS weight FROM lineitem GROUP BY ALL")
def g04(spark, d):
    e = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("x"), (F.col("l_partkey") % 100).alias("y"))
    return e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("weight"))


@query("a60_degrees", "SELECT node, count(*) AS degree FROM (SELECT user_id AS node FROM events UNION ALL SELECT 1000000 + user_id % 17 FROM events) GROUP BY node")
def a60(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("a"), (1000000 + F.col("user_id") % 17).alias("b"))
    return corpus.edge_degrees(e, "a", "b")


@query("g06_vector_topk", "WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_dot_product(q, list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_dot_product(q, q) * list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))), 6) AS cosine FROM q, embeddings WHERE vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, cosine, rank FROM r WHERE rank <= 10")
def g06(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return corpus.nearest(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), e)
