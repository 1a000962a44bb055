"""Screening of fetched addresses: liveness, coordinates, addresses in texts, crawled subpages, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.ordered import discard, written

# Errors that no later try mends.
DEAD_ERRORS = ("ssl", "dns", "refused")

# Forms of addresses in texts, in the order that their finds are listed; the group is the find, or else all.
ADDRESS_FORMS = (
    (r"\b([A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2})\b", 1),
    (r"\b([A-Z]\d{2}\s*[A-Z0-9]{4})\b", 1),
    (r"\b(0[0-9]\d{3})\b", 1),
    (r"\b(20\d{3})\b", 1),
    (r"\d{1,4}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s+(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Place|Pl|Close|Row|Square|Sq|Way|Gardens|Terrace))", 0),
    (r"(?:Carrer|Carretera|Avinguda|Passeig|Pla[çc]a)\s+[A-Za-zÀ-ú]+(?:\s+[A-Za-zÀ-ú]+)*,?\s*\d{1,4}", 0),
    (r"(?:Via|Corso|Piazza|Viale|Largo)\s+[A-Za-zÀ-ú]+(?:\s+[A-Za-zÀ-ú]+)*,?\s*\d{1,4}", 0),
    (r"(?i)based in ([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", 1),
    (r"(?i)located in ([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", 1),
    (r"(?i)serving ([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", 1),
    (r"(?i)in the ([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?) area", 1),
    (r"(?i)ubicad[ao] en ([A-Za-zÀ-ú]+(?:\s+[A-Za-zÀ-ú]+)?)", 1),
    (r"(?i)situat[ao] en ([A-Za-zÀ-ú]+(?:\s+[A-Za-zÀ-ú]+)?)", 1),
    (r"(?i)situato a ([A-Za-zÀ-ú]+(?:\s+[A-Za-zÀ-ú]+)?)", 1),
    (r"(?i)si trova a ([A-Za-zÀ-ú]+(?:\s+[A-Za-zÀ-ú]+)?)", 1),
)
# Postcodes and streets that a place with coarse coordinates is looked up by.
EIRCODE = r"\b([A-Z]\d{2}\s?[A-Z0-9]{4})\b"
UK_POSTCODE = r"\b([A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2})\b"
STREET = r"\b(\d{1,4}\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Dr|Place|Pl|Close|Row|Square|Terrace|Gardens|Park|Crescent|Court))\b"
# Signs of a page that could not be read, in the reason for its refusal.
ACCESS_FAILURES = ("inaccessible", "error", "challenge", "timeout", "blocked", "bot", "404", "server", "no readable")
SOCIAL_DOMAINS = ("facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "youtu.be", "tiktok.com")
NON_HTML = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".zip", ".jpg", ".jpeg", ".png")


def alive(status: Column, error: Column) -> Column:
    """False for a page not found and for errors that last; time-outs and unknown errors stay."""
    return ~F.coalesce((status == 404) | error.isin(*DEAD_ERRORS), F.lit(False))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def flag_coordinates(df: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """coord_source and needs_review added; where either coordinate is blank, both become blank."""
    missing = _blank(F.col(lat)) | _blank(F.col(lng))
    keep = lambda c: F.when(missing, "").otherwise(F.col(c).cast("string"))
    return df.withColumns({lat: keep(lat), lng: keep(lng), "coord_source": F.when(missing, "not_specified").otherwise("provided"), "needs_review": missing})


def found_address(body: Column, postcode: str, keywords: list[str]) -> Column:
    """The first postcode of a text, else the first phrase about a keyword (60 characters each side); null without either."""
    about = r"(?d)(.{0,60}(?:" + "|".join(keywords) + r").{0,60})"
    first = F.nullif(F.regexp_extract(body, postcode, 0), F.lit(""))
    return F.coalesce(first, F.nullif(F.trim(F.regexp_extract(body, about, 1)), F.lit("")))


def fill_coordinates(df: DataFrame, places: DataFrame, body: str, postcode: str, keywords: list[str], centre: tuple[float, float]) -> DataFrame:
    """lat and lng (doubles, null where missing) filled by places (query, p_lat, p_lng), a geocoder's answers; else by the centre, approx."""
    asked = df.withColumn("_address", F.when(F.col("lat").isNull(), found_address(F.col(body), postcode, keywords)))
    joined = asked.join(places, asked["_address"] == places["query"], "left")
    lost = F.col("lat").isNull() & F.col("p_lat").isNull()
    at = lambda own, p, c: F.coalesce(F.col(own), F.col(p), F.lit(c))
    filled = joined.withColumns({"coords_approx": lost, "_lat": at("lat", "p_lat", centre[0]), "_lng": F.when(F.col("lat").isNull(), F.coalesce("p_lng", F.lit(centre[1]))).otherwise(F.col("lng"))})
    return filled.withColumns({"lat": F.col("_lat"), "lng": F.col("_lng")}).drop("_lat", "_lng", "_address", "query", "p_lat", "p_lng")


def address_candidates(body: Column, forms=ADDRESS_FORMS, most: int = 5) -> Column:
    """Finds of all forms, in the forms' order, distinct, at most so many."""
    finds = [F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(p), F.lit(g)) for p, g in forms]
    return F.slice(F.array_distinct(F.concat(*finds)), 1, most)


def regeocode_candidates(body: Column, title: Column, country: Column, most: int = 6) -> Column:
    """Postcodes of the country, streets, and a title of two words or more; distinct, at most so many."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    irish = F.coalesce(F.contains(country, F.lit("Ireland")), F.lit(False)) | F.contains(both, F.lit("Dublin"))
    finds = lambda p: F.regexp_extract_all(both, F.lit(p), F.lit(1))
    named = F.when(text.word_count(title) >= 2, F.array(title)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(F.when(irish, finds(EIRCODE)).otherwise(finds(UK_POSTCODE)), finds(STREET), named)), 1, most)


def first_answer(df: DataFrame, key: str, candidates: str, places: DataFrame) -> DataFrame:
    """key and the answer (query, lat, lng) of the first candidate that places (query, lat, lng) knows; rows without any are left out."""
    asked = df.select(key, F.posexplode(candidates).alias("_pos", "query"))
    hits = asked.join(places, "query").groupBy(key).agg(F.min_by(F.struct("query", "lat", "lng"), "_pos").alias("_a"))
    return hits.select(key, "_a.*")


def decimals(value: Column) -> Column:
    """Decimal places of a number at ten places, closing zeros aside."""
    return F.length(F.regexp_replace(F.regexp_extract(F.format_string("%.10f", value.cast("double")), r"\.(\d+)$", 1), "0+$", ""))


def low_precision(lat: Column, lng: Column, most: int = 2) -> Column:
    """Both coordinates have at most so many decimal places; false if either is null."""
    return F.coalesce(F.greatest(decimals(lat), decimals(lng)) <= most, F.lit(False)) & lat.isNotNull() & lng.isNotNull()


def crawl(seeds: DataFrame, links: DataFrame, depth: int = 1) -> DataFrame:
    """url, seed and depth of every page reached from seeds (url, ord) over links (src, dst), each page once.

    A page belongs to the least depth, then to the seed of least ord. A round is one join; its
    pages and those before it are written, so rounds don't pile up in the plan.
    """
    reached = seeds.groupBy("url").agg(F.min("ord").alias("seed")).withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        reached = written(reached, "crawl")
        last = reached.filter(F.col("depth") == k - 1)
        new = last.join(links, last["url"] == links["src"]).groupBy(F.col("dst").alias("url")).agg(F.min("seed").alias("seed"))
        reached = reached.unionByName(new.join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(k)))
    return reached


def merge_subpages(pages: DataFrame, seed: str, order: str) -> DataFrame:
    """One record a seed: the first page's url, html of all joined by line feeds in order (null if all are), images distinct."""
    part = F.struct(F.col(order).alias("o"), F.col("url").alias("u"), F.col("html").alias("h"))
    grouped = pages.groupBy(seed).agg(F.array_sort(F.collect_list(part)).alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("images", F.array().cast("array<string>")))))).alias("images"))
    html = F.filter(F.transform("p", lambda x: x["h"]), lambda h: F.coalesce(h != "", F.lit(False)))
    return grouped.select(seed, F.col("p")[0]["u"].alias("url"), F.when(F.size(html) > 0, F.array_join(html, "\n")).alias("html"), "images")


#: What a blog's interface returns; both kinds of items may be absent.
_ITEMS = "array<struct<title:string,content:string,featured_image:string>>"


def blog_payload(payload: Column) -> Column:
    """struct(title, html, images) of a payload {posts: [...], pages: [...]}; null without any text."""
    items = F.from_json(payload, f"posts {_ITEMS}, pages {_ITEMS}")
    every = F.concat(F.coalesce(items["posts"], F.array().cast(_ITEMS)), F.coalesce(items["pages"], F.array().cast(_ITEMS)))
    bare = lambda c: text.visible_text(c)
    texts = F.filter(F.flatten(F.transform(every, lambda i: F.array(bare(i["title"]), bare(i["content"])))), lambda x: x != "")
    titles = F.filter(F.transform(every, lambda i: bare(i["title"])), lambda x: x != "")
    images = F.filter(F.transform(every, lambda i: i["featured_image"]), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.when(F.size(texts) > 0, F.struct(F.coalesce(F.get(titles, 0), F.lit("")).alias("title"), F.array_join(texts, "\n\n").alias("html"), images.alias("images")))


def usable_images(images: DataFrame, page: str, order: str, look_at: int = 30, keep: int = 10, least: int = 200) -> DataFrame:
    """Of each page's first look_at images (url, width, height), those by http of least size each way, keep at most."""
    w = Window.partitionBy(page).orderBy(order)
    seen = images.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= look_at)
    good = seen.filter(F.col("url").startswith("http") & (F.col("width") >= least) & (F.col("height") >= least))
    return good.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def drop_alike(images: DataFrame, order: str, bits: str, near: int = 8, by: list[str] | None = None, width: int = 64) -> DataFrame:
    """images without those within `near` differing bits (less than) of one kept before, in the given order, in each group of by.

    The greedy pass over an ordered list, without a task that holds the list: of equal hashes
    the first alone can be kept, so the others go before any rows meet; two hashes of `width`
    bits that differ in fewer than `near` agree in one of `near` blocks, so neighbours meet by
    equality; then, round by round, an image whose earlier neighbours are all dropped is kept,
    and one with a kept earlier neighbour is dropped. order must tell all images apart; an image
    without a hash is kept.
    """
    by = by or []
    rows = images.filter(F.col(bits).isNotNull()).groupBy(*by, F.col(bits).alias("_b")).agg(F.min(order).alias("_o")).select(*by, "_o", "_b")
    bounds = [width * k // near for k in range(near + 1)]
    masks = [(1 << bounds[k + 1]) - (1 << bounds[k]) for k in range(near)]
    blocks = F.array(*[F.struct(F.lit(k).alias("k"), F.col("_b").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("v")) for k, m in enumerate(masks)])
    keyed = rows.withColumn("_k", F.explode(blocks)).select(*by, "_o", "_b", "_k.k", "_k.v")
    later = keyed.select(*by, "k", "v", F.col("_o").alias("_later"), F.col("_b").alias("_lb"))
    pairs = keyed.join(later, [*by, "k", "v"]).filter((F.col("_o") < F.col("_later")) & (F.bit_count(F.col("_b").bitwiseXOR(F.col("_lb"))) < near))
    pairs = written(pairs.select(*by, "_o", "_later").distinct(), "alike")
    open_, kept = written(rows.select(*by, "_o"), "open"), None
    while True:
        waits = pairs.join(open_.select(*by, F.col("_o")), [*by, "_o"]).select(*by, F.col("_later").alias("_o")).distinct()
        new = written(open_.join(waits, [*by, "_o"], "left_anti"), "kept")
        kept = new if kept is None else kept.union(new)
        gone = pairs.join(new, [*by, "_o"]).select(*by, F.col("_later").alias("_o")).distinct()
        last, open_ = open_, written(open_.join(new, [*by, "_o"], "left_anti").join(gone, [*by, "_o"], "left_anti"), "open")
        discard(last)
        if open_.isEmpty():
            discard(open_, pairs)
            break
    return images.join(kept.select(*by, F.col("_o").alias(order)), [*by, order], "left_semi").unionByName(images.filter(F.col(bits).isNull()))


def margin_box(points: DataFrame, by: list[str], margin: float = 0.25) -> DataFrame:
    """by, min_lng, min_lat, max_lng, max_lat: the bounds of each group's points, wider by a share of their size on each side."""
    b = points.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in ("lng", "lat") for n, f in (("min", F.min), ("max", F.max))])
    wide = lambda c: (F.col(f"max_{c}") - F.col(f"min_{c}")) * margin
    return b.select(*by, *[(F.col(f"{n}_{c}") + (wide(c) if n == "max" else -wide(c))).alias(f"{n}_{c}") for n in ("min", "max") for c in ("lng", "lat")])


def outside_own_box(points: DataFrame, boxes: DataFrame, key: str, city: str) -> DataFrame:
    """Points (key, city, lat, lng) outside their own city's box (c, min_lng, ...): key, city, inside_of (the first other city whose box holds them, or null).

    A city has one box, so the boxes are configuration and sent to all tasks.
    """
    boxes = F.broadcast(boxes)
    held = F.col("lng").between(F.col("min_lng"), F.col("max_lng")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
    out = points.join(boxes, F.col(city) == F.col("c")).filter(~held).select(key, city, "lat", "lng")
    other = out.join(boxes, held & (F.col(city) != F.col("c")), "left")
    return other.groupBy(key, city).agg(F.min("c").alias("inside_of"))


def access_failure(reason: Column) -> Column:
    return F.coalesce(reason.rlike("(?i)" + "|".join(ACCESS_FAILURES)), F.lit(False))
