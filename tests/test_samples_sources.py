"""Samples, intervals, readers and sinks on hand-made inputs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats, text
from corpusloom.operators import intervals, samples
from corpusloom.sources import readers, writers


def test_round_robin_takes_turns_and_removes(spark):
    rows = [(k, "c", ["a"] if k < 3 else ["a", "b"] if k < 6 else ["b"] if k < 7 else []) for k in range(12)] + [(100, "d", []), (101, "e", ["x"])]
    df = spark.createDataFrame(rows, "id long, city string, pools array<string>")
    got = samples.round_robin(df, "id", "city", "pools", ["b", "a"], 8, "s").collect()
    c = sorted((r["pick"], r["id"], r["reason"]) for r in got if r["city"] == "c")
    assert len(c) == 8 and len({x[1] for x in c}) == 8
    assert [x[2] for x in c][:4] == ["b", "a", "b", "a"] and {x[1] for x in c if x[2] == "none"} <= set(range(7, 12))
    assert {x[1] for x in c if x[2] != "none"} == set(range(7)) and [r["id"] for r in got if r["city"] == "d"] == [100]
    assert not [r for r in got if r["city"] == "e"]
    assert sorted(map(tuple, got)) == sorted(map(tuple, samples.round_robin(df.repartition(5), "id", "city", "pools", ["b", "a"], 8, "s").collect()))


def test_sample_ids_beyond_999_differ(spark):
    df = spark.createDataFrame([(k * 37 % 1001, "x") for k in range(1001)], "d int, _n string").repartition(7)
    got = {r["d"]: r["sample_id"] for r in samples.sample_ids(df, ["d"], "P2-%03d").collect()}
    assert got == {k: f"P2-{k + 1:03d}" for k in range(1001)} and got[1000] == "P2-1001"


def test_text_files_beyond_999_stay_apart(spark, tmp_path):
    rows = [(k, "a", f"text {k}") for k in (7, 99, 100, 999, 1000, 1001, 100000)]
    writers.text_files(spark.createDataFrame(rows, "doc_no long, slug string, text string"), str(tmp_path / "t"))
    got = {r["name"]: r["text"].rstrip("\n") for r in readers.texts(spark, str(tmp_path / "t")).collect()}
    assert got == {f"{k:03d}_a": f"text {k}" for k, *_ in rows}


def test_one_to_one_names_what_is_not(spark):
    left, right = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k int"), spark.createDataFrame([(2, "x"), (3, "y"), (4, "z")], "k int, v string")
    joined, problems = samples.one_to_one(left, right, "k")
    assert sorted(map(tuple, problems.collect())) == [(1, "only_left"), (3, "repeated"), (4, "only_right")] and joined.count() == 3


def test_interval_columns(spark):
    rows = spark.createDataFrame([(0, 25), (7, 12), (12, 12), (None, 4), (0, 0)], "k int, n int").select(intervals.binomial_interval("k", "n").alias("i")).collect()
    for r, (k, n) in zip(rows, [(0, 25), (7, 12), (12, 12)], strict=False):
        assert (r["i"]["low"], r["i"]["high"]) == pytest.approx(stats.clopper_pearson(k, n))
    assert [tuple(r["i"]) for r in rows[3:]] == [(None, None)] * 2
    got = spark.createDataFrame([(20, 6.318), (3, 0.0)], "k int, e double").select(intervals.poisson_interval("k", "e").alias("i")).collect()
    assert tuple(got[0]["i"]) == pytest.approx((1.934, 4.889), abs=1e-3) and tuple(got[1]["i"]) == (None, None)


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, 40 + k % 5) for k in range(12, 30)], "part int, whole int")
    one = intervals.bootstrap(df, ["part", "whole"], intervals.ratio, 400).first()
    assert one == intervals.bootstrap(df.repartition(7), ["part", "whole"], intervals.ratio, 400).first()
    share = sum(range(12, 30)) / sum(40 + k % 5 for k in range(12, 30))
    assert one["n"] == 400 and one["low"] < share < one["high"]
    assert tuple(intervals.bootstrap(df.limit(0), ["part", "whole"], intervals.ratio, 10).first()) == (0, None, None)
    cells = spark.createDataFrame([(173, 462, 1, 67)], "a int, b int, c int, d int")
    k = intervals.bootstrap(cells, ["a", "b", "c", "d"], intervals.kappa_of_cells, 20).first()
    assert round(k["low"], 3) == round(k["high"], 3) == 0.064


def test_repaired_answers(spark):
    said = ['```json\n[{"t": "a"}]\n```', 'so: {"t": "b"}.', "nothing", None, '[{"t": "a"}, {"t": "b"}, {"t": "c"}] end', "[broken"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string").orderBy("k")
    got = [[x["t"] for x in r["a"]] for r in df.select(text.repaired_answers(F.col("s"), "t string", 2).alias("a")).collect()]
    assert got == [["a", None], ["b", None], [None, None], [None, None], ["a", "b"], [None, None]]


def test_geojson_parts_holes_and_mercator(spark, tmp_path):
    square = lambda x, s: [[x, x], [x + s, x], [x + s, x + s], [x, x + s], [x, x]]
    features = [{"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 4), square(1, 1)]}}, {"type": "Feature", "properties": {"name": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(0, 1)], [square(5, 1)]]}}, {"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    at = tmp_path / "d.json"
    at.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = readers.geojson(spark, str(at)).collect()
    assert [(r["ord"], r["name"], [len(x) for x in r["rings"]]) for r in rows] == [(0, "p", [5, 5]), (1, "m", [5, 5])]
    far = 6378137.0 * math.radians(90)
    at.write_text(json.dumps({"features": [{"properties": {"name": "q"}, "geometry": {"type": "Polygon", "coordinates": [[[far, 0], [0, 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(51.5) / 2))], [0, 0], [far, 0]]]}}]}))
    ring = readers.geojson(spark, str(at), "EPSG:3857").first()["rings"][0]
    assert (ring[0]["x"], ring[0]["y"], ring[1]["y"]) == pytest.approx((90.0, 0.0, 51.5))
    with pytest.raises(ValueError):
        readers.geojson(spark, str(at), "EPSG:2157")


def test_plain_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id , note\n001,NA\n2,\n")
    assert [tuple(r) for r in readers.strings_csv(spark, str(tmp_path / "a.csv")).collect()] == [("001", "NA"), ("2", "")]
    inv = readers.inventory(spark, [str(tmp_path / "a.csv")]).first()
    assert inv["rows"] == 2 and "note" in inv["columns"] and inv["modified"] is not None
    (tmp_path / "f.json").write_text('{"url": "u", "status": 404, "error_class": null, "html": null}\n')
    assert readers.boundary(spark, str(tmp_path / "f.json"), readers.FETCHES).first()["status"] == 404
    (tmp_path / "r.jsonl").write_text('{"url": "u", "title": "t"}\n\n{"url": "v"}\n')
    assert [r["url"] for r in readers.records(spark, str(tmp_path / "r.jsonl")).collect()] == ["u", "v"]
    (tmp_path / "doc.json").write_text('{\n "a": {"answer": "x"}\n}')
    assert readers.document(spark, str(tmp_path / "doc.json"), "a struct<answer:string>").first()["a"]["answer"] == "x"
    (tmp_path / "kv.json").write_text('{"c1": {"content": "one"}, "c2": {"content": "two"}}')
    assert sorted(map(tuple, readers.key_values(spark, str(tmp_path / "kv.json"), "struct<content:string>").collect())) == [("c1", "one"), ("c2", "two")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "001_a.txt").write_text("x\n\ny")
    assert [tuple(r) for r in readers.texts(spark, str(tmp_path / "t")).collect()] == [("001_a.txt", "x\n\ny")]
    assert readers.line_counts(spark, str(tmp_path / "t")).first()["n"] == 2


def test_ledger_rows_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>a<td>b</tr><tr><th>h</th></tr><tr><td>c</td></table>"), (2, None)], "p int, html string")
    assert sorted((r["p"], r["row_id"], r["url"]) for r in readers.ledger(pages, "p", "html").collect()) == [(1, "a", "b"), (1, "c", None)]


def test_config_names_what_is_there(tmp_path):
    (tmp_path / "cork.json").write_text('{"city": "Cork City"}')
    held = readers.config(str(tmp_path / "cork.json"))
    assert held["raw_dir"] == "data/cork_city/raw" and held["enriched"].endswith("fsi_enriched.jsonl")
    with pytest.raises(FileNotFoundError, match="cork.json"):
        readers.config(str(tmp_path / "york.json"))


def test_sinks(spark, tmp_path):
    stats_, rows = spark.createDataFrame([(2,)], "total int"), spark.createDataFrame([("u", "", True), ("v", "1", False)], "url string, lat string, needs_review boolean")
    writers.annotated_json(stats_, rows, f"{tmp_path}/a")
    assert spark.read.json(f"{tmp_path}/a/stats").first()["total"] == 2 and spark.read.json(f"{tmp_path}/a/rows").count() == 2
    writers.review_report(rows, f"{tmp_path}/r")
    assert tuple(spark.read.json(f"{tmp_path}/r/stats").select("total_missing", "unresolved").first()) == (2, 1)
    assert spark.read.json(f"{tmp_path}/r/needs_manual_review").first()["url"] == "u"
    docs = spark.createDataFrame([(0, "a.org", "one\ntwo"), (1, "b.org", "three")], "doc_no int, slug string, text string")
    writers.text_files(docs, f"{tmp_path}/t")
    assert sorted(p.name for p in (tmp_path / "t").glob("name=*")) == ["name=000_a_org", "name=001_b_org"]
    writers.json_document(stats_, f"{tmp_path}/j")
    with pytest.raises(ValueError):
        writers.json_document(rows, f"{tmp_path}/j2")
    assert writers.table(rows.select("url"), f"{tmp_path}/c") == "| url |\n| --- |\n| u |\n| v |\n"
    page = writers.html_report("A <b>", spark.createDataFrame([(1, "H", "x\n\ny & z"), (0, "G", None)], "place int, heading string, body string"))
    assert "<h2>H</h2><p>x</p><p>y &amp; z</p>" in page and "G" not in page and "A &lt;b&gt;" in page
    writers.cleaned_csv(spark.createDataFrame([("u", "1", "2", True)], "url string, lat_raw string, lng_raw string, coords_approx boolean"), f"{tmp_path}/k")
    assert spark.read.option("header", True).csv(f"{tmp_path}/k").columns == ["URL", "Lat", "Lng", "coords_approx"]
    writers.json_lines(rows, f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").count() == 2
    with pytest.raises(ValueError):
        writers.results(rows, f"{tmp_path}/else/x", (f"{tmp_path}/ok",))
    writers.results(rows, f"{tmp_path}/ok/x", (f"{tmp_path}/ok",))
    with pytest.raises(Exception, match="(?i)exist"):
        writers.results(rows, f"{tmp_path}/ok/x", (f"{tmp_path}/ok",))
