"""URL lists with deep and mixed-case entries."""

from rateweave.llm import url_filter


def test_deep_and_mixed_case_entries(spark):
    captures = spark.createDataFrame([
        (1, "http://A.example.com/a/b/c/d/e/f?x", 5), (2, "http://a.example.com/a/b/c/d/other", 5), (3, "https://example.com/Foo/x", 5),
        (4, "https://example.com/foo/x", 5), (5, "http://example.org/1/2/3/4//5/", 5), (6, "http://example.com", 5),
        (7, "http://example.com/" + "s/" * 300, 5)], "page_id long, url string, fetched_at long")
    entries = spark.createDataFrame([
        ("a.example.com/a/b/c/d/e", "x", 1, "add"), ("Example.COM/Foo", "x", 1, "add"), ("example.org/1/2/3/4/5/", "y", 1, "add"),
        ("example.com/" + "/".join("s" * 299), "x", 1, "add"), (None, "x", 1, "add")],
        "key string, category string, listed_at long, action string")
    got = {r.page_id: (r.closest, r.allowed) for r in url_filter.judged(captures, entries).collect()}
    assert got == {1: ("a.example.com/a/b/c/d/e", False), 2: (None, True), 3: ("example.com/Foo", False), 4: (None, True),
                   5: ("example.org/1/2/3/4/5", False), 6: (None, True), 7: ("example.com/" + "/".join("s" * 299), False)}
    assert all(r.allowed for r in url_filter.judged(captures, entries.limit(0)).collect())
