"""Main text of pages without a parser: blocks by tags, links and text density of blocks, smoothed over their neighbours (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements that hold no text to read, boxes that are closed in pages as a rule, other tags that end a block, and boxes off the main text.
RAW = "script style noscript template textarea svg iframe select title".split()
BOXES = "div section article main nav header footer aside form figure details dialog menu table ul ol".split()
BREAKS = [*BOXES, *"p li h1 h2 h3 h4 h5 h6 tr td th dl dt dd blockquote pre hr body button caption figcaption summary address".split()]
OFF = "nav footer aside form menu dialog".split()
#: Names in class, id or role that tell a box off the main text: comments, menus, notices, adverts.
OFF_NAMES = r"(?i)(?:class|id|role)\s*=\s*[^>]*\b(?:comments?|sidebar|ads?|advert|cookies?|banner|breadcrumbs?|menu|nav|navigation|footer|share|social|related|newsletter|popup)\b"
RAW_ELEMENTS = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in RAW)
TOKEN = "<[^>]*>|[^<]+|<"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
SPACES = r"[ \t\n\r\f\x0B]+"
#: Words a block must have, smoothed, and the share of its characters in links that it must stay below; a main text shorter than this gives way to all text.
LEAST_WORDS, MOST_LINKED, SHORT = 4.0, 0.5, 100


def _readable(raw: Column) -> Column:
    for name, sign in ENTITIES:
        raw = F.replace(raw, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(raw, SPACES, " "))


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, block, text, words, linked (share of characters in links), heading, off and smoothed of each block with text.

    A block is what stands between two tags that end blocks. off: it lies in a menu, footer,
    aside, form, or a box whose names tell so; an end tag closes the last box that was opened at
    its depth. smoothed: the words outside links, one part each of the neighbours' and two of
    the block's own, with those of boxes off the text as none. key must tell pages apart; null
    pages have no blocks. A page is ordered by window functions, so it is in one task.
    """
    tokens = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(F.regexp_replace(html, RAW_ELEMENTS, " "), F.lit(f"({TOKEN})"), F.lit(1))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1))
    name = F.regexp_replace("tag", "^/", "")
    box, opens = name.isin(BOXES), ~F.startswith("tag", F.lit("/"))
    page = Window.partitionBy(key).orderBy("pos")
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.withColumn("tag", tag).withColumns({"step": F.when(box & opens, 1).when(box, -1).otherwise(0), "is_off": box & opens & (F.col("tag").isin(OFF) | F.col("token").rlike(OFF_NAMES))})
    t = t.withColumns({"depth": F.sum("step").over(upto) + F.when(F.col("step") == -1, 1).otherwise(0), "block": F.sum(F.when(name.isin(BREAKS), 1).otherwise(0)).over(upto)})
    level = Window.partitionBy(key, "depth", F.col("step") != 0).orderBy("pos")
    closes_off = (F.col("step") == -1) & F.coalesce(F.lag("is_off").over(level), F.lit(False))
    t = t.withColumn("turn", F.when(F.col("is_off"), 1).when(closes_off, -1).otherwise(0))
    text = F.when(~F.startswith("token", F.lit("<")) | (F.col("token") == "<"), F.col("token")).when(F.col("tag") == "br", " ").otherwise("")
    link = F.when(F.col("tag") == "a", 1).when(F.col("tag") == "/a", -1).otherwise(0)
    inside = Window.partitionBy(key, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"off": F.sum("turn").over(upto) > 0, "text": text, "in_link": F.sum(link).over(inside) > 0})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    of = t.groupBy(key, "block").agg(joined.alias("raw"), F.sum(F.when(F.col("in_link"), F.length("text")).otherwise(0)).alias("in_links"), F.max(F.col("tag").rlike("^h[1-6]$")).alias("heading"), F.max(F.col("off") & (F.col("text") != "")).alias("off"))
    of = of.withColumn("text", _readable(F.col("raw"))).filter("text <> ''")
    of = of.withColumns({"words": F.size(F.split("text", " ")), "linked": F.col("in_links") / F.length("raw")})
    weight = F.when(F.col("off"), 0.0).otherwise(F.col("words") * (1 - F.col("linked")))
    order = Window.partitionBy(key).orderBy("block")
    of = of.withColumn("weight", weight)
    near = lambda f: F.coalesce(f("weight").over(order), F.lit(0.0))
    return of.withColumn("smoothed", (near(F.lag) + 2 * F.col("weight") + near(F.lead)) / 4).select(key, "block", "text", "words", "linked", "heading", "off", "smoothed")


def kept(found: DataFrame, key: str = "page_id") -> DataFrame:
    """found with kept: blocks on the text with few links and enough words about them, and headings before such a block."""
    body = found.withColumn("body", ~F.col("off") & (F.col("linked") < MOST_LINKED) & (F.col("smoothed") >= LEAST_WORDS))
    after = F.coalesce(F.lead("body").over(Window.partitionBy(key).orderBy("block")), F.lit(False))
    return body.withColumn("kept", F.col("body") | (F.col("heading") & ~F.col("off") & after)).drop("body")


def main_texts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and text of every page: its kept blocks, one a line; all its blocks where those are shorter than SHORT characters and all are longer.

    A page without text, or null, has an empty text. Recall is favoured: a block is only left out
    for the box it lies in, for its links, or for standing among very few words.
    """
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("block", "text")))), lambda x: x["text"]), "\n")
    texts = kept(blocks(pages, key, html), key).groupBy(key).agg(lines(F.col("kept")).alias("main"), lines(F.lit(True)).alias("whole"))
    short = (F.length("main") < SHORT) & (F.length("whole") > F.length("main"))
    return pages.select(key).join(texts, key, "left").select(key, F.coalesce(F.when(short, F.col("whole")).otherwise(F.col("main")), F.lit("")).alias("text"))


def meta_content(html: Column, name: str) -> Column:
    """The content of the first <meta name="..."> of that name, readable; empty where there is none."""
    return _readable(F.coalesce(F.regexp_extract(html, rf"""(?is)<meta\s[^>]*?name\s*=\s*["']{name}["'][^>]*?content\s*=\s*["']([^"'>]*)["']""", 1), F.lit("")))


def _list(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def sql(pages: str) -> str:
    """Steps of a WITH clause up to `blocks` and `kept_blocks`, over the SQL table pages (page_id, html)."""
    readable = "raw"
    for name, sign in ENTITIES:
        readable = f"replace({readable}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    raw = RAW_ELEMENTS.replace("'", "''")
    name = "regexp_replace(tag, '^/', '')"
    off = OFF_NAMES.replace("'", "''")
    return f"""listed AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{raw}', ' ', 'g'), '{TOKEN}') AS l FROM {pages}),
tokens AS (SELECT page_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM listed),
tagged AS (SELECT *, lower(regexp_extract(token, '^<(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM tokens),
stepped AS (SELECT *, CASE WHEN tag IN {_list(BOXES)} THEN 1 WHEN tag[1] = '/' AND {name} IN {_list(BOXES)} THEN -1 ELSE 0 END AS step, tag IN {_list(BOXES)} AND (tag IN {_list(OFF)} OR regexp_matches(token, '{off}')) AS is_off FROM tagged),
deep AS (SELECT *, sum(step) OVER w + CASE WHEN step = -1 THEN 1 ELSE 0 END AS depth, sum(CASE WHEN {name} IN {_list(BREAKS)} THEN 1 ELSE 0 END) OVER w AS block FROM stepped WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
turned AS (SELECT *, CASE WHEN is_off THEN 1 WHEN step = -1 AND coalesce(lag(is_off) OVER (PARTITION BY page_id, depth, step <> 0 ORDER BY pos), false) THEN -1 ELSE 0 END AS turn FROM deep),
flat AS (SELECT page_id, block, pos, tag, sum(turn) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) > 0 AS off, CASE WHEN token[1] <> '<' OR token = '<' THEN token WHEN tag = 'br' THEN ' ' ELSE '' END AS text, sum(CASE tag WHEN 'a' THEN 1 WHEN '/a' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, block ORDER BY pos ROWS UNBOUNDED PRECEDING) > 0 AS in_link FROM turned),
joined AS (SELECT page_id, block, string_agg(text, '' ORDER BY pos) AS raw, sum(CASE WHEN in_link THEN length(text) ELSE 0 END) AS in_links, bool_or(regexp_matches(tag, '^h[1-6]$')) AS heading, bool_or(off AND text <> '') AS off FROM flat GROUP BY ALL),
read AS (SELECT *, trim(regexp_replace({readable}, '{SPACES}', ' ', 'g')) AS text FROM joined),
weighed AS (SELECT *, len(string_split(text, ' ')) AS words, in_links / length(raw) AS linked, CASE WHEN off THEN 0 ELSE len(string_split(text, ' ')) * (1 - in_links / length(raw)) END AS weight FROM read WHERE text <> ''),
blocks AS (SELECT page_id, block, text, words, linked, heading, off, (coalesce(lag(weight) OVER w, 0) + 2 * weight + coalesce(lead(weight) OVER w, 0)) / 4 AS smoothed FROM weighed WINDOW w AS (PARTITION BY page_id ORDER BY block)),
bodies AS (SELECT *, NOT off AND linked < {MOST_LINKED} AND smoothed >= {LEAST_WORDS} AS body FROM blocks),
kept_blocks AS (SELECT *, body OR (heading AND NOT off AND coalesce(lead(body) OVER (PARTITION BY page_id ORDER BY block), false)) AS kept FROM bodies)"""
