"""Main text by blocks, on pages without articles."""

from pyspark.sql import functions as F

from corpusloom.operators import main_text

PROSE = "The garden by the river was opened in the spring and is run by the people who live in the streets around it. Vegetables are grown for the local school."
PAGE = f"""<!DOCTYPE html><html><head><title>Not text</title><meta name="description" content="A garden &amp; more"></head><body>
<div id="top-menu"><a href="/">Home</a> <a href="/a">About us</a><div>Open <b>today</b> and on every day of the week until nightfall</div></div>
<div class="wrap"><h1>The garden</h1><div><p>{PROSE}</p><p>Second &lt;part&gt; with a <a href="/x">short link</a> and<br>many more words that tell what is done there.</div>
<ul><li><a href="/1">One more garden to be seen in the town</a></li><li><a href="/2">Another of the gardens near the station</a></li></ul>
<table><tr><td>Opening hours for all of our guests</td><td>from nine until five on weekdays</td></tr></table>
<h2>Last words</h2><p>People come here to meet, and to work the ground together in all weathers.</p></div>
<div class='Comments list'><div><p>{PROSE}</p></div><p>I was there too, and found it a very fine place for a day.</p></div>
<aside><p>{PROSE}</p></aside><script>var a = "<p>{PROSE}</p>";</script><!-- <p>{PROSE}</p> -->
<footer><p>All rights reserved by the people who made this page in the year of its making.</p></footer></body></html>"""


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, html string").withColumnRenamed("html", "body").selectExpr("page_id", "body AS html", "1 AS pos", "'x' AS text")
    return {r["page_id"]: r["text"] for r in main_text.main_texts(df).collect()}


def test_a_page_without_article(spark):
    got = texts(spark, [(1, PAGE)])[1].split("\n")
    assert got == ["The garden", PROSE, "Second <part> with a short link and many more words that tell what is done there.", "Opening hours for all of our guests", "from nine until five on weekdays", "Last words", "People come here to meet, and to work the ground together in all weathers."]


def test_short_and_odd_pages(spark):
    got = texts(spark, [(1, None), (2, ""), (3, "just < text"), (4, "<p>Hi <b>you</b></p><nav><a href=x>menu</a></nav>"), (5, "<div><div><p>" + "word " * 30 + "</div></div></div></p></nav>after all of it, the end tags are too many"), (6, "<p " * 50 + "x" * 200_000)])
    assert got[1] == got[2] == "" and got[3] == "just < text" and got[4] == "Hi you\nmenu"
    assert got[5] == ("word " * 30).strip() + "\nafter all of it, the end tags are too many"
    assert len(got[6]) > 200_000
    assert texts(spark, [(7, "x")])[7] == "x" and main_text.main_texts(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_meta_content(spark):
    row = spark.createDataFrame([(PAGE,), ("<p>",), (None,)], "html string").select(main_text.meta_content(F.col("html"), "description").alias("d")).collect()
    assert [r["d"] for r in row] == ["A garden & more", "", ""]
