import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rateweave.functions import html, lists, text, vectors
from tests.conftest import rows


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("given_id, padded", [("1", "0000001"), ("1234567", "1234567"), ("12345678", "12345678"),
                                              ("", "0000000"), (None, None)])
def test_zero_pad_keeps_long_ids(spark, given_id, padded):
    assert one(spark, text.zero_pad("c"), c=given_id) == padded


def test_link_url(spark):
    assert one(spark, text.link_url("c"), c="114709") == "https://www.imdb.com/title/tt0114709/"
    assert one(spark, text.link_url("c", "x:", "#"), c="12345678") == "x:12345678#"


@pytest.mark.parametrize("value, ids", [("1,2,3", [1, 2, 3]), ("", []), ("  ", []), ("7", [7]), (None, None),
                                        ("1,,x, 4 ", [1, None, None, 4]), ("99999999999", [None])])
def test_parse_ids(spark, value, ids):
    assert one(spark, text.parse_ids("c"), c=value) == ids


def test_split_list_is_literal(spark):
    assert one(spark, text.split_list("c", "|"), c="A|B.C") == ["A", "B.C"]
    assert one(spark, text.split_list("c", "."), c="A|B.C") == ["A|B", "C"]


@pytest.mark.parametrize("title", ["Heat (1995)", "Heat (1995) ", "Heat", "Up", "", "abcd", "abcde"])
def test_release_year_is_the_slice(spark, title):
    assert one(spark, text.release_year("c"), c=title) == title[-5:-1]


def test_release_year_strict(spark):
    assert one(spark, text.release_year("c", strict=True), c="Heat (1995) ") == "1995"
    assert one(spark, text.release_year("c", strict=True), c="Heat") is None


@pytest.mark.parametrize("zone, year", [("UTC", 2000), ("America/New_York", 1999), ("Asia/Tokyo", 2000)])
@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Tokyo"])
def test_epoch_year_ignores_the_session_zone(spark, zone, year, session_zone):
    at = int(datetime.datetime(2000, 1, 1, 1, tzinfo=datetime.timezone.utc).timestamp())
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        assert one(spark, text.epoch_year("c", zone), c=at) == year
        assert one(spark, text.epoch_year("c"), c=-1) == 1969
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", ["jOHN smith", "x", "", "éCLAIR"])
def test_title_case(spark, name):
    assert one(spark, text.title_case("c"), c=name) == name.capitalize()


@pytest.mark.parametrize("prefix, found", [("he", True), ("HEAT", True), ("", False), ("h%", False), ("heat 2", False)])
def test_has_prefix(spark, prefix, found):
    assert one(spark, text.has_prefix("c", prefix), c="Heat") == found


def test_explode_lists_in_step(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x", "y"]), (2, [], []), (3, None, None), (4, ["c"], [None])],
                               "id int, p array<string>, q array<string>")
    out = rows(lists.explode_lists(df, ["p", "q"], fill_value="-", position="pos"), "id", "pos", "p", "q")
    assert out == [(1, 0, "a", "x"), (1, 1, "b", "y"), (2, 0, "-", "-"), (3, 0, "-", "-"), (4, 0, "c", None)]
    assert lists.explode_lists(df, ["p", "q"]).columns == ["id", "p", "q"]


def test_explode_lists_refuses_unequal_lengths(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x"])], "id int, p array<string>, q array<string>")
    with pytest.raises(Exception, match="differ in length"):
        lists.explode_lists(df, ["p", "q"]).collect()


PAGES = [
    ("none", "<html><p>no block</p></html>", []),
    ("one", '<div class="poster"><a><img alt="i" src="a.jpg"/></a></div>', ["a.jpg"]),
    ("two", '<div class="poster"><img src="a.jpg"></div><div class="big poster"><img src=b.jpg></div>', ["a.jpg", "b.jpg"]),
    ("first only", '<div class="poster"><img src="a.jpg"><img src="b.jpg"></div>', ["a.jpg"]),
    ("no image", '<div class="poster">text</div><img src="outside.jpg">', []),
    ("order", "<DIV id='x' CLASS='poster'><IMG SRC='a.jpg' class=q></DIV>", ["a.jpg"]),
    ("nested", '<div class="poster"><div class="x"></div><img src="in.jpg"></div><img src="out.jpg">', ["in.jpg"]),
    ("nested poster", '<div class="poster"><div class="poster"><img src="a"></div></div>', ["a", "a"]),
    ("other class", '<div class="posters"><img src="a.jpg"></div>', []),
    ("entity", '<div class="poster"><img src="a?x=1&amp;y=2"></div>', ["a?x=1&y=2"]),
    ("script", '<script>var t = "<div class=poster><img src=no>";</script><div class="poster"><img src="a"></div>', ["a"]),
    ("comment", '<!-- <div class="poster"><img src="no"></div> --><div class="poster"><img src="a"></div>', ["a"]),
    ("no src", '<div class="poster"><img alt="x"></div>', []),
    ("null", None, []),
    ("far", "<p>" + "x" * 200_000 + '</p><div class="poster"><img src="far.jpg"></div>', ["far.jpg"]),
]


def test_attribute_values(spark):
    df = spark.createDataFrame([(n, h) for n, h, _ in PAGES], "name string, html string")
    got = dict(df.select("name", html.attribute_values("html", "div", "img", "src", "poster")).collect())
    assert got == {n: want for n, _, want in PAGES}


def test_attribute_values_without_class(spark):
    df = spark.createDataFrame([('<ul><li><a href="/x">x</a><li><a>y</a></li></ul>',)], "html string")
    assert df.select(html.attribute_values("html", "li", "a", "href")).first()[0] == ["/x"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(-1e3, 1e3), min_size=3, max_size=3), min_size=1, max_size=8))
def test_dot_and_vector_sum(spark, data):
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(data)], "k int, v array<double>")
    for value, (plain, sized) in zip(data, df.select(vectors.dot("v", "v"), vectors.dot("v", "v", 3)).collect()):
        assert plain == pytest.approx(sum(x * x for x in value)) and sized == pytest.approx(plain)
    for k, total in df.groupBy("k").agg(vectors.vector_sum("v")).collect():
        want = [sum(v[j] for i, v in enumerate(data) if i % 2 == k) for j in range(3)]
        assert total == pytest.approx(want, abs=1e-9)


def test_hash_vector_is_repeatable_and_spread(spark):
    df = spark.range(2000).select("id", vectors.hash_vector("id", 2, 5.0, 1).alias("v"))
    a, b = rows(df), rows(df.repartition(7))
    assert a == b
    values = [x for _, v in a for x in v]
    assert 0 <= min(values) and max(values) < 5 and 2.4 < sum(values) / len(values) < 2.6
    assert rows(spark.range(5).select(F.col("id"), vectors.hash_vector("id", 2, 5.0, 2).alias("v"))) != a[:5]
