"""Local search in a graph of names: from a question's names over weighted links to texts and relations, to a budget of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.operators.ordered import written

#: Names of a question that are followed, and words that its texts and its relations may have.
MOST_NAMES, TEXT_WORDS, RELATION_WORDS = 20, 1500, 200


def word_count(text: Column) -> Column:
    """Words of a text, one at least."""
    return F.greatest(F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")), F.lit(1))


def seeds(questions: DataFrame, names: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """query_id, name and place (from 1) of the first `most` phrases of each question (query_id, text) that are names (name, distinct)."""
    asked = questions.select("query_id", F.posexplode(graph.phrases(F.col("text"))).alias("pos", "name")).join(names, "name")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return asked.withColumn("place", place).filter(F.col("place") <= most).select("query_id", "name", "place")


def _within(rows: DataFrame, budget: int) -> DataFrame:
    """The rows (query_id, rank: what they are ordered by, words) of each question in order, with place, while their words, added up, keep the budget."""
    order = Window.partitionBy("query_id").orderBy("rank")
    upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"upto": upto, "place": F.row_number().over(order)}).filter(F.col("upto") <= budget).drop("upto")


def local_texts(asked: DataFrame, mentions: DataFrame, pairs: DataFrame, chunks: DataFrame, budget: int = TEXT_WORDS) -> DataFrame:
    """query_id, place, chunk, name, related and words of the texts that answer each question.

    asked: see seeds; mentions: chunk, name; pairs: a, b, weight; chunks: chunk, words. Texts of
    a question's first name come first, then those of the next; of one name those where most of
    its neighbours stand too (related), then by chunk. A text counts once, for its first name, and
    texts are taken while their words keep the budget. As a text has a word at least, no name
    needs more than `budget` texts: a popular name's texts are cut to these before they meet
    questions, by a ranking that each task begins on its own rows. The work is the pairs of names
    of a text, so it grows with the texts as long as these are windows of a bounded size.
    """
    around = pairs.select(F.col("a").alias("name"), F.col("b").alias("other")).union(pairs.select("b", "a")).filter("name <> other")
    held = mentions.select("chunk", "name").distinct()
    wanted = asked.select("name").distinct()
    near = around.join(wanted, "name", "left_semi")
    of = written(held.join(wanted, "name", "left_semi").withColumn("_row", F.monotonically_increasing_id()), "mentions-asked-for")
    # A name meets the names of its own text, which are few, before its neighbours, which may be most names.
    beside = of.join(held.select("chunk", F.col("name").alias("other")), "chunk").select("_row", "name", "other")
    both = beside.join(near, ["name", "other"]).groupBy("_row").agg(F.count("*").alias("related"))
    related = of.join(both, "_row", "left").select("chunk", "name", F.coalesce("related", F.lit(0).cast("long")).alias("related"))
    best = Window.partitionBy("name").orderBy(F.desc("related"), "chunk")
    first = related.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= budget).drop("rn")
    rank = F.struct(F.col("place").alias("of"), (-F.col("related")).alias("less"), "chunk", "name")
    once = asked.join(first, "name").select("query_id", "chunk", rank.alias("rank")).groupBy("query_id", "chunk").agg(F.min("rank").alias("rank"))
    taken = _within(once.join(chunks.select("chunk", "words"), "chunk"), budget)
    return taken.select("query_id", "place", "chunk", F.col("rank.name").alias("name"), (-F.col("rank.less")).alias("related"), "words")


def local_relations(asked: DataFrame, pairs: DataFrame, budget: int = RELATION_WORDS) -> DataFrame:
    """query_id, place, a, b, weight and words of the links of each question's names: those of most links at both ends first, then by weight, a and b.

    A link counts once a question and its words are those of both names; links are taken while
    they keep the budget, so no name needs more than `budget` of them.
    """
    ends = pairs.select("a", "b", "weight", F.explode(F.array_distinct(F.array("a", "b"))).alias("name"))
    degrees = ends.groupBy("name").agg(F.count("*").alias("degree"))
    of = ends.join(asked.select("name").distinct(), "name", "left_semi")
    side = lambda c: degrees.select(F.col("name").alias(c), F.col("degree").alias(f"degree_{c}"))
    ranked = of.join(side("a"), "a").join(side("b"), "b").withColumn("rank", F.struct((-(F.col("degree_a") + F.col("degree_b"))).alias("less"), (-F.col("weight")).alias("lighter"), "a", "b"))
    first = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy("rank"))).filter(F.col("rn") <= budget)
    once = asked.join(first.select("name", "rank", "weight"), "name").select("query_id", "rank", "weight").distinct()
    once = once.withColumn("words", word_count(F.col("rank.a")) + word_count(F.col("rank.b")))
    return _within(once, budget).select("query_id", "place", F.col("rank.a").alias("a"), F.col("rank.b").alias("b"), "weight", "words")


def answers(questions: DataFrame, texts: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """query_id, n_texts, context and error of every question: its texts in order, their chunk (chunk, text) by chunk, at most `most` of them joined.

    A question without a text is an error of its own row, and its context is empty.
    """
    held = texts.filter(F.col("place") <= most).join(chunks.select("chunk", "text"), "chunk")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n\n")
    of = texts.groupBy("query_id").agg(F.count("*").alias("n_texts")).join(held.groupBy("query_id").agg(joined.alias("context")), "query_id", "left")
    missing = F.when(F.col("n_texts").isNull(), F.concat(F.lit("no text for "), F.col("query_id").cast("string")))
    return questions.select("query_id").join(of, "query_id", "left").select("query_id", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("context", F.lit("")).alias("context"), missing.alias("error"))
