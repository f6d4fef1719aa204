import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rateweave.plans import catalog, enrich, explore, recommend
from tests.conftest import rows

RATINGS = [(1, 10, 4.0, 0), (1, 11, 2.0, 31536000), (2, 10, 5.0, 31536000), (2, 12, 1.0, 31536000), (3, 10, None, 0),
           (None, 10, 3.0, 0), (3, None, 3.0, 0), (3, 99, 5.0, 0)]
ITEMS = [(10, "Heat (1995)", "Action|Crime"), (11, "Up (2009)", "Family"), (12, "Heat (1995)", "(no genres listed)"),
         (13, "Lost (2001)", "Action")]


@pytest.fixture
def ratings(spark):
    return spark.createDataFrame(RATINGS, "user_id int, item_id int, rating float, rated_at bigint")


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id int, title string, genres string")


def test_item_stats_skip_null_ratings_and_keys(ratings, items):
    assert rows(explore.item_stats(ratings, items), "item_id", "n_ratings", "mean_rating") == [
        (10, 3, 4.0), (11, 1, 2.0), (12, 1, 1.0)]
    assert rows(explore.items_with_mean_at_least(ratings, items, 2.0), "item_id") == [(10,), (11,)]


def test_user_means_at_both_grains(ratings, items):
    assert rows(explore.user_means(ratings, items)) == [(1, 2, 3.0), (2, 2, 3.0), (3, 2, 4.0)]
    assert rows(explore.user_means(ratings, items, explore.GENRE_GRAIN)) == [(1, 3, 10 / 3), (2, 3, 11 / 3), (3, 0, None)]
    with pytest.raises(ValueError):
        explore.user_means(ratings, items, "other")


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 5, 5], [0.5, 0.7, 5.0], [3, 3, 3], [1, 1.0000001]])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "rating double")
    counts, edges = np.histogram(values, bins=5)
    out = explore.histogram(df).orderBy("bin").collect()
    assert [r["n"] for r in out] == counts.tolist()
    assert [r["low"] for r in out] + [out[-1]["high"]] == pytest.approx(edges.tolist())


def test_histogram_of_nothing(spark):
    assert explore.histogram(spark.createDataFrame([], "rating double")).count() == 0


def test_genre_counts_and_trends(ratings, items):
    assert rows(explore.genre_counts(ratings, items)) == [
        ("(no genres listed)", 1), ("Action", 3), ("Crime", 3), ("Family", 1)]
    assert [r[0] for r in explore.top_genres(ratings, items, 2).collect()] == ["Action", "Crime"]
    dated = explore.with_year(ratings)
    trends = rows(explore.genre_year_means(dated, items), "genre", "year", "mean_rating")
    assert ("Action", 1970, 3.5) in trends and ("Action", 1971, 5.0) in trends and len(trends) == 6
    slices = rows(explore.genre_year_slices(dated, items, first=2), "slice", "genre")
    assert set(slices) == {("first", "Action"), ("rest", "Crime"), ("rest", "Family")}
    kept = explore.genre_year_slices(dated, items, first=2, drop_unlisted=False)
    assert ("first", "(no genres listed)") in rows(kept, "slice", "genre")


def test_genre_density_equals_its_formula(spark):
    rng = np.random.default_rng(2)
    data = [(u, i, float(r)) for i in range(12) for u, r in enumerate(rng.integers(1, 6, 5))]
    ratings = spark.createDataFrame(data, "user_id int, item_id int, rating float")
    items = spark.createDataFrame([(i, "t", "A" if i else "B") for i in range(12)], "item_id int, title string, genres string")
    out = explore.genre_density(ratings, items, points=20).orderBy("point").collect()
    assert {r["genre"] for r in out} == {"A"}  # one value has no density
    means = np.array([np.mean([r for _, j, r in data if j == i]) for i in range(1, 12)])
    h = means.std(ddof=1) * len(means) ** -0.2
    x = np.linspace(means.min() - 3 * h, means.max() + 3 * h, 20)
    want = np.exp(-0.5 * ((x[:, None] - means) / h) ** 2).sum(axis=1) / (len(means) * h * math.sqrt(2 * math.pi))
    assert [r["x"] for r in out] == pytest.approx(x.tolist())
    assert [r["density"] for r in out] == pytest.approx(want.tolist())


def test_titles_and_years_at_both_grains(ratings, items):
    assert explore.top_titles(ratings, items, 1, explore.GENRE_GRAIN).collect() == [("Heat (1995)", 7)]
    assert explore.top_titles(ratings, items, 1, explore.RATING_GRAIN).collect() == [("Heat (1995)", 4)]
    assert rows(explore.reviews_by_release_year(ratings, items, threshold=3.5)) == [("1995", 3)]
    assert rows(explore.reviews_by_genre(ratings, items, 3.5)) == [("(no genres listed)", 1), ("Action", 1), ("Crime", 1)]


@pytest.fixture
def users(spark):
    return spark.createDataFrame(
        [(1, "ann", "10,11", None), (2, "bob", "", None), (3, "cy", None, None), (4, "di", "12", "done"),
         (610, "seed", "10", None), (7, "eve", "1,,x", None), (8, "flo", "  ", None)],
        "id int, name string, item_ids string, job_status string")


def test_pending_users_and_picks(users):
    pending = catalog.pending_users(users)
    assert rows(pending, "id") == [(1,), (7,)]
    assert rows(catalog.picks_of(pending)) == [(1, 10), (1, 11), (7, 1)]
    assert rows(catalog.pending_users(users, ()), "id") == [(1,), (610,), (7,)]


def test_user_status(spark, users):
    stored = spark.createDataFrame([(4, 1), (4, 2)], "user_id int, item_id int")
    assert dict(catalog.user_status(users, stored).collect()) == {
        1: "pending", 2: "no_picks", 3: "no_picks", 4: "ready", 610: "pending", 7: "pending", 8: "no_picks"}


def test_register(spark, users):
    batch = spark.createDataFrame([(5, "new"), (1, "zed"), (2, "ann"), (3, "new"), (9, "last")], "ordinal int, name string")
    assert rows(catalog.register(users, batch)) == [(611, "zed"), (612, "new"), (613, "last")]
    assert rows(catalog.register(users.limit(0), batch.filter("ordinal = 1"))) == [(1, "zed")]


def test_titles_are_matched_and_joined(spark, items):
    wishes = spark.createDataFrame([(1, 0, "Up (2009)"), (1, 1, "Heat (1995)"), (1, 2, "Nope"), (2, 0, "Nope")],
                                   "user_id int, pos int, title string")
    found, unknown = catalog.match_titles(wishes, items)
    assert rows(catalog.join_picks(found)) == [(1, "11,10")]
    assert rows(unknown, "user_id", "title") == [(1, "Nope"), (2, "Nope")]


def test_titles_with_prefix(items):
    assert rows(catalog.titles_with_prefix(items, "hE"), "item_id") == [(10,), (12,)]
    assert catalog.titles_with_prefix(items, "").count() == 0


def test_rated_and_never_rated(ratings, items):
    assert rows(catalog.never_rated(items, ratings), "item_id") == [(13,)]
    assert rows(catalog.rated(items, ratings), "item_id") == [(10,), (11,), (12,)]


def test_dense_index_follows_first_appearance(spark):
    df = spark.createDataFrame([(3, 30), (1, 20), (2, 30), (4, 10)], "at int, item_id int").withColumn("user_id", F.lit(5))
    index = catalog.dense_index(df, "item_id", ["at"])
    assert rows(index) == [(10, 2), (20, 0), (30, 1)]
    users = catalog.dense_index(df, "user_id", ["at"])
    assert rows(catalog.with_dense_ids(df, users, index), "at", "user_idx", "item_idx") == [
        (1, 0, 0), (2, 0, 1), (3, 0, 1), (4, 0, 2)]


def test_unrated(spark, ratings, users):
    picks = catalog.picks_of(users)
    assert dict(catalog.unrated_counts(picks, ratings).collect()) == {1: 2, 4: 3, 610: 3, 7: 4}
    pairs = spark.createDataFrame([(1, 10), (1, 12), (1, 12), (2, 10)], "user_id int, item_id int")
    assert rows(catalog.unrated_pairs(pairs, picks)) == [(1, 12), (2, 10)]


LINKS = [(10, "113277"), (10, "99"), (11, "12345678"), (12, None), (13, "5")]


def pages(spark, by="link"):
    poster = '<div class="poster"><img src="{}"></div>'
    data = [(10, "https://www.imdb.com/title/tt0113277/", 200, poster.format("heat.jpg")),
            (11, "https://www.imdb.com/title/tt12345678/", 200, "<p>no image</p>"),
            (13, "https://www.imdb.com/title/tt0000005/", 404, poster.format("gone.jpg"))]
    return spark.createDataFrame(data, "item_id int, url string, status int, html string")


def test_links_and_availability(spark):
    links = enrich.item_links(spark.createDataFrame(LINKS, "item_id int, ext_id string"))
    assert rows(links, "item_id", "link")[1:] == [(11, "https://www.imdb.com/title/tt12345678/"),
                                                  (13, "https://www.imdb.com/title/tt0000005/")]
    for key in ("link", "item_id"):
        assert rows(enrich.available_items(links, pages(spark), key), "item_id", "image_link") == [(10, "heat.jpg"), (11, None)]
    assert rows(enrich.available_items(links, pages(spark), require_image=True), "item_id") == [(10,)]
    assert enrich.available_items(links, pages(spark), markup=None).columns == ["item_id", "link"]


def test_quick_recommendations_are_full_despite_unavailable_items(spark, items):
    factors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 30)], "item_id int, features array<float>")
    pending = spark.createDataFrame([(1, "29,28"), (2, "5"), (3, "999")], "id int, item_ids string")
    available = spark.createDataFrame([(i, f"l{i}", None) for i in range(1, 30) if i % 2 == 0],
                                      "item_id int, link string, image_link string")
    recs = recommend.quick_recommendations(pending, factors, available, k=4)
    # user 3 has picked nothing that has a vector
    assert rows(recs, "user_id", "rank", "item_id", "link") == [
        (1, 1, 26, "l26"), (1, 2, 24, "l24"), (1, 3, 22, "l22"), (1, 4, 20, "l20"),
        (2, 1, 28, "l28"), (2, 2, 26, "l26"), (2, 3, 24, "l24"), (2, 4, 22, "l22")]
    stored = recs.withColumn("user_id", F.col("user_id").cast("string")).withColumn("item_id", F.lit("10"))
    assert {r["title"] for r in enrich.with_titles(stored, items).collect()} == {"Heat (1995)"}


def test_only_pages_of_recommended_items_are_parsed(spark):
    factors = spark.createDataFrame([(i, [float(i)]) for i in range(1, 9)], "item_id int, features array<float>")
    pending = spark.createDataFrame([(1, "8")], "id int, item_ids string")
    available = spark.createDataFrame([(i, f"l{i}") for i in range(1, 9)], "item_id int, link string")
    pages = spark.createDataFrame([(f"l{i}", 200, f'<div class="poster"><img src="{i}.jpg"></div>') for i in range(1, 8)],
                                  "url string, status int, html string")
    titles = spark.createDataFrame([(i, f"t{i}") for i in range(1, 7)], "item_id int, title string")
    recs = recommend.quick_recommendations(pending, factors, available, k=3, pages=pages, items=titles)
    assert rows(recs, "rank", "title", "link", "image_link") == [(2, "t6", "l6", "6.jpg"), (3, "t5", "l5", "5.jpg")]
    chosen = available.filter("item_id < 3")
    plan = enrich.with_images(chosen, pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Eval"):]


def test_personal_recommendations_carry_links(spark):
    data = [(u, i, 4.0) for u in range(12) for i in range(10) if (u + i) % 3]
    ratings = spark.createDataFrame(data, "user_id int, item_id int, rating float")
    pending = spark.createDataFrame([(50, "1,2"), (51, "3")], "id int, item_ids string")
    available = spark.createDataFrame([(i, f"l{i}", f"i{i}") for i in range(8)], "item_id int, link string, image_link string")
    recs = recommend.personal_recommendations(pending, ratings, available, k=3, rank=2, iterations=2).collect()
    assert len(recs) == 6
    assert all(r["link"] == f"l{r['item_id']}" and r["image_link"] == f"i{r['item_id']}" for r in recs)
    assert not {(r["user_id"], r["item_id"]) for r in recs} & {(50, 1), (50, 2), (51, 3)}


def test_what_is_eligible_is_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    eligible = spark.createDataFrame([(1,), (2,)], "item_id int").mapInArrow(counted, "item_id int")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "item_id int, features array<double>")
    users = spark.createDataFrame([(7, [1.0])], "user_id int, features array<double>")
    picks = spark.createDataFrame([(7, 1)], "user_id int, item_id int")
    assert rows(recommend.score_model(users, vectors, picks, eligible), "user_id", "item_id", "rank") == [(7, 2, 1)]
    assert seen.value == 2
