"""What a report is put together from: images, districts, records with their defaults, answers, prompts and chart tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text

# Fields of a summary and the answers that fill them.
SUMMARY_FIELDS = {
    "geographic_distribution": "geographic_distribution", "fsi_types_summary": "fsi_types", "operational_summary": "operational_levels", "popularity_summary": "popularity",
    "notable_initiatives": "notable_initiatives", "hotspots_and_deserts": "hotspots_and_deserts", "digital_presence": "digital_presence", "network_affiliations": "network_affiliations",
    "activity_volume": "activity_volume", "operating_hours": "operating_hours", "physical_vs_online": "physical_vs_online", "target_audiences": "target_audiences",
    "sustainability": "sustainability", "collaborations": "collaborations", "education_and_engagement": "education_and_engagement", "events_and_workshops": "events_and_workshops",
}


def image_score(image: Column, least_width: int = 200, least_height: int = 200, captions: bool = True) -> Column:
    """Score of a struct (width, height, caption, source_url): landscape, size, caption and a real address count; -1 if too small."""
    w, h = image["width"], image["height"]
    points = F.when(w > h, 2.0).otherwise(0.0) + F.when(w >= 800, 2.0).when(w >= 500, 1.0).otherwise(0.0) + F.when(F.coalesce(image["source_url"].startswith("http"), F.lit(False)), 0.5).otherwise(0.0)
    if captions:
        points = points + F.when(F.coalesce(image["caption"] != "", F.lit(False)), 1.0).otherwise(0.0)
    return F.when((F.coalesce(w, F.lit(0)) < least_width) | (F.coalesce(h, F.lit(0)) < least_height), F.lit(-1.0)).otherwise(points)


def best_image(images: Column, **how) -> Column:
    """The image of the highest score, the first of equals; null if none qualifies."""
    ranked = F.transform(images, lambda x, k: F.struct((-image_score(x, **how)).alias("s"), k.alias("k"), x.alias("image")))
    top = F.array_min(F.filter(ranked, lambda r: r["s"] <= 0))
    return top["image"]


def _distinct_top(df: DataFrame, by: list[str], order: list, path: Column, most: int) -> DataFrame:
    """The first rows, in order, with a path of their own: most of each group, numbered from 1."""
    w = Window.partitionBy(*by, "_path").orderBy(*order)
    first = df.withColumn("_path", path).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= most).drop("_rn", "_path")


def group_images(records: DataFrame, by: str, order: list, most: int = 3) -> DataFrame:
    """The best images of each group's records (images), walked in order, no path twice: the records' rows with image and rank."""
    best = records.withColumn("image", best_image(F.col("images"))).filter("image IS NOT NULL")
    return _distinct_top(best, [by], order, F.col("image.local_path"), most)


def overview_images(records: DataFrame, by: str, order: list, first: str, most: int = 5, of: int = 3) -> DataFrame:
    """One image a group, the best of its first `of` records, for the largest groups first, no path twice: by, image, rank.

    Groups of one size stand in the order of their first record. Groups are few, as they are
    the districts of a report, so their rows may meet in one task.
    """
    sizes = records.groupBy(by).agg(F.count("*").alias("_n"), F.min(first).alias("_first"))
    top = records.withColumn("_rk", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rk") <= of)
    joined = top.groupBy(by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_rk", "images"))), lambda x: x["images"])).alias("images"))
    best = joined.join(sizes, by).withColumn("image", best_image(F.col("images"))).filter("image IS NOT NULL")
    return _distinct_top(best.withColumn("_one", F.lit(1)), ["_one"], [F.desc("_n"), "_first"], F.col("image.local_path"), most).select(by, "image", "rank")


def report_images(records: DataFrame, order: list, most: int = 4) -> DataFrame:
    """The first records, in order, whose best image qualifies and is not taken: the rows with image and rank.

    Rows beyond the first that hold a path can't be chosen, so each path keeps its first row
    before the ranking, and the ranking takes a limit instead of a window over all.
    """
    best = records.withColumn("image", best_image(F.col("images"), least_height=150, captions=False)).filter("image IS NOT NULL")
    w = Window.partitionBy("_path").orderBy(*order)
    first = best.withColumn("_path", F.col("image.local_path")).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    top = first.orderBy(*order).limit(most)  # a report's pictures
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).drop("_rn", "_path")


def counts_on(groups: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """All groups with their count (n) and category; those without rows have 0 and `none`."""
    return groups.join(counts, key, "left").withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "category": F.coalesce("category", F.lit("none"))})


def resolved(answer: Column, fallback: Column, empty: Column) -> Column:
    """A class: the model's answer, else the fallback's, else `unknown`; a record without title and text has no fallback."""
    known = F.coalesce(answer, F.lit("unknown"))
    return F.when(empty, "unknown").when(known != "unknown", known).otherwise(F.coalesce(fallback, F.lit("unknown")))


def keyword_class(url: Column | None, title: Column, description: Column, body: Column, rules: list[tuple[str, list[str]]], chars: int) -> Column:
    """The first rule with a word in address, title, description and the first characters of the text; null without any."""
    parts = [F.coalesce(c, F.lit("")) for c in (url, title, description) if c is not None]
    whole = F.lower(F.concat_ws(" ", *parts, F.substring(F.coalesce(body, F.lit("")), 1, chars)))
    return text.first_match([(k, text.any_keyword(whole, words)) for k, words in rules], F.lit(None).cast("string"))


def classification_prompt(title: Column, description: Column, body: Column) -> Column:
    """What a model is asked about a record: its title, then up to 1000 characters of the starts of description (200) and text (800)."""
    start = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    content = F.regexp_replace(F.concat(start(description, 200), F.lit("\n"), start(body, 800)), r"\A[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+\z", "")
    return F.concat(F.lit("Classify this FSI:\n\n"), title, F.lit("\n"), F.substring(content, 1, 1000))


def enriched(record: Column, country: str, city: str) -> Column:
    """A full record from a struct (url, title, text, district, geo, fsi_type, operational_level, description), absent parts by default."""
    district, geo = record["district"], record["geo"]
    unknown = lambda c, d="Unknown": F.coalesce(c, F.lit(d))
    location = F.struct(F.lit(country).alias("country"), F.lit(city).alias("city"), unknown(district["district_name"]).alias("district_name"), unknown(district["district_code"]).alias("district_code"), unknown(district["match_type"], "unknown").alias("match_type"), geo["lat"].alias("lat"), geo["lng"].alias("lng"), F.coalesce(geo["coords_approx"], F.lit(False)).alias("coords_approx"))
    return F.struct(record["url"].alias("url"), record["title"].alias("title"), record["text"].alias("text"), location.alias("location"), unknown(record["fsi_type"], "unknown").alias("fsi_type"), unknown(record["operational_level"], "unknown").alias("operational_level"), unknown(record["description"], "").alias("description"), F.lit(2).alias("phase"))


def summary_answers(answers: Column) -> Column:
    """A map of answers (name to struct with answer) as a map of the summary's fields; a field without answer is empty."""
    return F.create_map(*[x for field, name in SUMMARY_FIELDS.items() for x in (F.lit(field), F.coalesce(answers[name]["answer"], F.lit("")))])


def section_prompts(facts: DataFrame, key: str, sections: dict[str, tuple[str, list[str]]], with_instruction: bool = True) -> DataFrame:
    """key, section and prompt: the instruction and the data points, a line each, of every section; sections: name to (instruction, columns).

    Without instruction (the ablated condition) the prompt holds the data points alone.
    """
    point = lambda c: F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    prompts = [F.struct(F.lit(name).alias("section"), F.concat_ws("\n", *([F.lit(instruction)] if with_instruction else []), *map(point, columns)).alias("prompt")) for name, (instruction, columns) in sections.items()]
    return facts.select(key, F.explode(F.array(*prompts)).alias("s")).select(key, "s.section", "s.prompt")
