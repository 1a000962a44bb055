"""Names, checks, sections and facts against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import claims

NAMES = claims.Names(["Dublin 1", "Dublin 12", "Municipio 1", "Gràcia", "Lewisham"])


def test_numbers_that_are_no_part_of_a_name():
    assert [n[4] for n in NAMES.numbers("Municipio 3, 2, 6 and 9 (28), Dublin 12 has 5; Dublin 120 not")] == ["28", "5", "120"]
    assert claims.Names([]).spans("Dublin 1") == [] and claims.Names([]).numbers("a 7%")[0][2:4] == (7.0, True)


@pytest.mark.parametrize("sentence, found", [
    ("Lewisham (12) leads", "12"), ("the 2020 Lewisham report", None), ("220,000), whereas Lewisham's one", None), ("40 of them in Lewisham, 3 there", "3"),
    ("Lewisham, so it is said by some, has 4", None), ("centro di Lewisham 4", None), ("5 Lewisham 5", "5"), ("", None),
])
def test_the_nearest_number_of_a_name(sentence, found):
    hit = NAMES.nearest(sentence, "Lewisham")
    assert (hit and hit[4]) == found


def test_checks_of_a_sentence():
    assert claims.majority_flags("The majority, 40 groups, and most (60%)", 100, NAMES) == ["majority: 40 is 40.00%"]
    assert claims.majority_flags("most " + "x " * 40 + "5", 100, NAMES) == [] == claims.majority_flags("most 5", None, NAMES)
    assert claims.sum_flags("A (45), B (30) and Dublin 1 (5) together account for 44%", 100, NAMES) == ["45+30+5 is 80.00%, not 44%"]
    assert claims.sum_flags("A (45) and B (30) accounted for 75 of 100 groups (75%)", 100, NAMES) == []
    assert claims.sum_flags("237 groups, " + "x " * 70 + "A (45), B (30) accounting for 9 of 100, or 75%", 100, NAMES) == []
    assert claims.basis_flags("per capita, a population of 1,200 and per 1,000 residents; census", 0, NAMES) == ["per capita", "population of 1,200", "per 1,000 residents", "census"]


def test_sections_are_siblings_of_their_heading(spark):
    pages = ["<p>a</p><h2>H<br>1</h2><p>one <i>two</i></p><div><p>no</p></div><p>three<p>four<h2></h2><p>five", "<p>only</p>", None, "<div><h2>A</h2></div><p>not a sibling</p>"]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, p string").select("k", claims.sections("p").alias("s")).collect()
    assert [[(x["heading"], x["para"]) for x in r["s"]] for r in sorted(rows)] == [[("H 1", "one two"), ("H 1", "three"), ("H 1", "four"), ("", "five")], [], [], []]


def test_flat_facts_of_odd_objects(spark):
    rows = spark.createDataFrame([('{"a": [[1, 2], {"label": "x", "v": 3}], "b": null, "c": -1.5}',), (None,), ("{}",)], "t string")
    found = [[(x["path"], x["grp"], x["value"]) for x in r[0]] for r in rows.select(claims.flat_facts(F.col("t"))).collect()]
    assert found == [[("a[0][0]", "a", 1.0), ("a[0][1]", "a", 2.0), ("a[x].v", "a", 3.0), ("c", "_scalar", -1.5)], [], []]
