import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats, text, urls
from corpusloom.operators import corpus
from corpusloom.sources import readers, writers


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("url, key", [("HTTP://www.A.org/b//?q=1#f", "a.org/b"), ("https://a.org", "a.org"), ("nonsense", "nonsense"), ("example.org/x/", "example.org/x"), ("//www.A.org/b?q", "a.org/b"), ("example.org:80/x", "80/x"), ("mailto:a@b.c", "a@b.c"), ("http://a b.org/x y/", "a b.org/x y")])
def test_dedup_key(spark, url, key):
    assert one(spark, urls.dedup_key(F.lit(url))) == key


def test_corpus_key_keeps_query(spark):
    assert one(spark, urls.corpus_key(F.lit("https://www.a.org/b/?q=1#f"))) == "a.org/b?q=1"
    assert one(spark, urls.corpus_key(F.lit("https://a.org/"))) == "a.org/"


def test_corpus_key_of_addresses_without_a_scheme(spark):
    assert one(spark, urls.corpus_key(F.lit("Example.org/b/?q=1#f"))) == "example.org/b?q=1"
    assert one(spark, urls.corpus_key(F.lit("a#x?y"))) == "a"


@pytest.mark.parametrize("raw, n", [("51.5", 1), ("51", 0), (" 1.25 ", 2), ("", None), (None, None)])
def test_decimal_places(spark, raw, n):
    assert one(spark, urls.decimal_places(F.lit(raw).cast("string"))) == n


@pytest.mark.parametrize("address", ["http://a/b.PDF", "http://a/b.c/", "http://a/.bashrc", "http://a/b.", "http://a.org", "http://a/x.tar.gz?y=.z"])
def test_extension_is_that_of_a_path(spark, address):
    from pathlib import PurePosixPath
    from urllib.parse import urlparse

    assert one(spark, urls.extension(F.lit(address))) == PurePosixPath(urlparse(address).path).suffix.lower().removesuffix("." if address.endswith(".") else "")


def test_keyword_space_rule(spark):
    assert not one(spark, text.keyword_present(F.lit("apple"), "app"))
    assert one(spark, text.keyword_present(F.lit("the App."), "app"))
    assert one(spark, text.keyword_present(F.lit("a food bankers"), "food bank"))


def test_kappa_of_published_cells(spark):
    cells = [(1, 1, 173), (1, 0, 462), (0, 1, 1), (0, 0, 67)]
    df = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "a int, b int")
    r = corpus.kappa(df, "a", "b").first()
    assert round(r["agreement"], 4) == 0.3414 and round(r["kappa"], 3) == 0.064


def test_exact_intervals():
    assert stats.garwood(20, 6.318) == pytest.approx((1.9336, 4.8889), abs=1e-4)
    assert stats.clopper_pearson(0, 25)[1] == pytest.approx(0.1372, abs=1e-4)


def test_url_csv_layouts(spark, tmp_path):
    for body, lat in (("URL,Lat,Lng\n http://a/ ,1.50,2\n,3,4\n", "1.50"), ("URL,coordinates\nhttp://a/,\"1.50, 2\"\n", "1.50"), ("URL \nhttp://a/\n", "")):
        p = tmp_path / f"{len(body)}.csv"
        p.write_text(body)
        rows = readers.url_csv(spark, str(p)).collect()
        assert [(r["url"], r["lat_raw"]) for r in rows] == [("http://a/", lat)]


def test_graphml(spark, tmp_path):
    p = tmp_path / "g.xml"
    p.write_text('<graphml><graph><node id="&quot;A&quot;"><data key="d0">x</data></node><node id="B"/><edge source="&quot;A&quot;" target="B"><data key="d4">1.0</data></edge></graph></graphml>')
    nodes, edges = readers.graphml(spark, str(p))
    assert sorted(r["id"] for r in nodes.collect()) == ["A", "B"]
    assert [(r["source"], r["target"], r["data"]["d4"]) for r in edges.collect()] == [("A", "B", "1.0")]


def test_append_checks_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    writers.append_checked(df, f"{tmp_path}/out")
    writers.append_checked(df, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2
    with pytest.raises(ValueError):
        writers.append_checked(df.select("b", "a"), f"{tmp_path}/out")


def test_stream_first_seen(spark, tmp_path):
    from corpusloom.streaming import fetched

    rows = spark.createDataFrame([("http://a/x", "<title>T</title>", 1), ("https://www.a/x/", "<p>b", 2)], "url string, html string, s long")
    rows.select("url", "html", F.timestamp_seconds("s").alias("fetched_at")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("url string, html string, fetched_at timestamp").parquet(f"{tmp_path}/in")
    q = fetched.first_seen(fetched.screened(stream)).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 1


def test_registrable_domains_by_rules(spark):
    """The published algorithm's own examples: longest rule, wildcards, exceptions, no rule."""
    rules = spark.createDataFrame([(r,) for r in ["com", "uk.com", "jp", "ac.jp", "kyoto.jp", "ide.kyoto.jp", "c.kobe.jp", "*.kobe.jp", "!city.kobe.jp", "ck", "*.ck", "!www.ck", "", "# no", "// no"]], "rule string")
    wanted = {"com": ".com", "example.com": "example.com", "a.b.example.com": "example.com", "EXAMPLE.uk.com": "example.uk.com", "b.test.ac.jp": "test.ac.jp", "kyoto.jp": ".kyoto.jp", "x.b.ide.kyoto.jp": "b.ide.kyoto.jp", "b.c.kobe.jp": "b.c.kobe.jp", "a.x.kobe.jp": "a.x.kobe.jp", "y.a.x.kobe.jp": "a.x.kobe.jp", "x.kobe.jp": ".x.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "test.ck": ".test.ck", "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck", "www.ck": "www.ck", "www.www.ck": "www.ck", "a.b.unknown": "unknown", "localhost": "localhost", "10.0.0.1": "10.0.0.1"}
    df = spark.createDataFrame([(h, "x") for h in [*wanted, "a.b.example.com", None]], "host string, key string")
    got = [(r["host"], r["registrable"]) for r in urls.registrable_domains(df, "host", rules).collect()]
    assert sorted(got, key=str) == sorted([*wanted.items(), ("a.b.example.com", "example.com"), (None, None)], key=str)
    assert sorted(urls.registrable_domains(df, "host", rules, most_sent=0).select("host", "registrable").collect(), key=str) == sorted(urls.registrable_domains(df, "host", rules).select("host", "registrable").collect(), key=str)



def test_language_hint_splits_a_text_once(spark):
    lists = {"en": ["the", "of"], "fr": ["le", "de"], "nl": ["de", "het"]}
    rows = ["The end of the day", "le jour, DE la nuit", "het de", "de", None, "", "x " * 1000 + "HET"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k long, t string").select("k", text.language_hint(F.col("t"), lists).alias("h"))
    assert [r["h"] for r in df.orderBy("k").collect()] == ["en", "fr", "nl", "fr", "en", "en", "nl"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
