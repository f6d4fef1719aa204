"""Rating statistics.

Ratings are reduced to one row per item (or per item and year) before they meet titles or genres, so the
joins and the explosion by genre work on rows in the number of items, not of ratings, and a popular item
cannot overload a join task.

``GENRE_GRAIN`` counts a rating once per genre of its item, as a table exploded by genre does;
``RATING_GRAIN`` counts it once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateweave.functions.text import UNLISTED_GENRE, epoch_year, release_year, split_list
from rateweave.session import cut_lineage

GENRE_GRAIN = "rating_genre"
RATING_GRAIN = "rating"


def item_sums(ratings: DataFrame, *extra: str) -> DataFrame:
    """Non-null rating count and sum per item (and ``extra`` columns)."""
    keys = ["item_id", *extra]
    return (ratings.filter(F.col("item_id").isNotNull())
                   .groupBy(*keys)
                   .agg(F.count("rating").alias("n"), F.sum(F.col("rating").cast("double")).alias("total")))


def with_year(ratings: DataFrame, zone: str = "UTC") -> DataFrame:
    """Replace ``rated_at`` (epoch seconds, date or timestamp) by its calendar ``year``."""
    kind = ratings.schema["rated_at"].dataType.typeName()
    year = epoch_year("rated_at", zone) if kind in ("long", "integer", "double") else F.year("rated_at")
    return ratings.withColumn("year", year).drop("rated_at")


def genres_of(items: DataFrame) -> DataFrame:
    """``(item_id, genre)`` rows from the ``|``-separated list."""
    return items.select("item_id", F.explode(split_list("genres", "|")).alias("genre"))


def _grain_weight(grain: str) -> Column:
    if grain == GENRE_GRAIN:
        return F.size(split_list("genres", "|"))
    if grain == RATING_GRAIN:
        return F.lit(1)
    raise ValueError(f"unknown grain {grain!r}")


def _mean(total: str = "total", n: str = "n") -> Column:
    return F.when(F.col(n) > 0, F.col(total) / F.col(n))


def item_stats(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Count and mean of ratings per item with its title."""
    return with_means(item_sums(ratings), items)


def with_means(sums: DataFrame, items: DataFrame) -> DataFrame:
    """Titles and means for ``sums(item_id, n, total)``, as from ``item_sums`` or stored ratings."""
    return (sums.join(items.select("item_id", "title"), "item_id")
            .select("item_id", "title", F.col("n").alias("n_ratings"), _mean().alias("mean_rating")))


def items_with_mean_at_least(ratings: DataFrame, items: DataFrame, threshold: float = 2.5) -> DataFrame:
    return item_stats(ratings, items).filter(F.col("mean_rating") >= threshold)


def user_means(ratings: DataFrame, items: DataFrame, grain: str = RATING_GRAIN) -> DataFrame:
    """``(user_id, n, mean_rating)``; at genre grain a rating weighs as many times as its item has genres."""
    if grain == RATING_GRAIN:
        weighted = ratings.select("user_id", "rating", F.lit(1).alias("w"))
    else:
        weights = items.select("item_id", _grain_weight(grain).alias("w"))
        weighted = ratings.join(weights, "item_id").select("user_id", "rating", "w")
    known = F.when(F.col("rating").isNotNull(), F.col("w"))
    return (weighted.filter(F.col("user_id").isNotNull()).groupBy("user_id")
            .agg(F.coalesce(F.sum(known), F.lit(0)).alias("n"),
                 F.sum(F.col("rating").cast("double") * F.col("w")).alias("total"))
            .select("user_id", "n", _mean().alias("mean_rating")))


def histogram(ratings: DataFrame, bins: int = 5) -> DataFrame:
    """``(bin, low, high, n)`` over equal-width bins from the minimum to the maximum, the last one closed.

    Ratings are counted per value first, in one pass; bounds and bins are taken from those counts. When all
    ratings are equal the range is widened by half a point to both sides.
    """
    values = cut_lineage(ratings.filter(F.col("rating").isNotNull())
                         .groupBy(F.col("rating").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    low, high = F.min("v"), F.max("v")
    flat = F.when(low == high, 0.5).otherwise(0.0)
    bounds = values.agg(F.struct((low - flat).alias("low"), (high + flat).alias("high")).alias("b"))
    edges = bounds.select(
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), F.col("b.low").alias("lo"),
        ((F.col("b.high") - F.col("b.low")) / bins).alias("width")).filter(F.col("lo").isNotNull())
    place = (values.withColumn("b", bounds.scalar())
             .select("n", F.least(F.width_bucket("v", F.col("b.low"), F.col("b.high"), F.lit(bins)),
                                  F.lit(bins)).cast("int").alias("bin")))
    counts = place.groupBy("bin").agg(F.sum("n").alias("n"))
    return edges.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("low"),
        (F.col("lo") + F.col("bin") * F.col("width")).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def genre_counts(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Ratings per genre, ``(genre, n_ratings)``."""
    return (item_sums(ratings).join(genres_of(items), "item_id")
            .groupBy("genre").agg(F.sum("n").alias("n_ratings")))


def top_genres(ratings: DataFrame, items: DataFrame, k: int = 500) -> DataFrame:
    """The ``k`` most rated genres with their counts."""
    return genre_counts(ratings, items).orderBy(F.desc("n_ratings"), "genre").limit(k)


def genre_year_means(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """``(genre, year, n_ratings, mean_rating)``; ``ratings`` has a ``year`` column."""
    return (item_sums(ratings, "year").join(genres_of(items), "item_id")
            .groupBy("genre", "year").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
            .select("genre", "year", F.col("n").alias("n_ratings"), _mean().alias("mean_rating")))


def genre_year_slices(ratings: DataFrame, items: DataFrame, first: int = 9, drop_unlisted: bool = True) -> DataFrame:
    """Genre trends marked ``first`` for the alphabetically first genres and ``rest`` for the others."""
    # one row per genre and year, written once because the list of genres is taken from it too
    trends = cut_lineage(genre_year_means(ratings, items))
    head = (trends.select("genre").distinct().orderBy("genre").limit(first)
            .withColumn("is_first", F.lit(True)))
    out = trends.join(F.broadcast(head), "genre", "left").select(
        F.when(F.col("is_first"), "first").otherwise("rest").alias("slice"), *trends.columns)
    return out.filter(F.col("genre") != UNLISTED_GENRE) if drop_unlisted else out


def item_genre_means(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, genre, mean_rating)``."""
    means = item_sums(ratings).select("item_id", _mean().alias("mean_rating"))
    return means.join(genres_of(items).distinct(), "item_id").select("item_id", "genre", "mean_rating")


def genre_density(ratings: DataFrame, items: DataFrame, points: int = 100, cut: float = 3.0) -> DataFrame:
    """Gaussian density of item means per genre on an even grid: ``(genre, point, x, density)``.

    Bandwidth by Scott's rule; the grid reaches ``cut`` bandwidths beyond the data. Equal means are counted
    once with their number, and the kernel sums are partially aggregated before the shuffle. A genre needs
    two different means.
    """
    values = cut_lineage(item_genre_means(ratings, items)
                         .filter((F.col("genre") != UNLISTED_GENRE) & F.col("mean_rating").isNotNull())
                         .groupBy("genre", F.col("mean_rating").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    v, c = F.col("v"), F.col("c")
    shapes = (values.groupBy("genre")
              .agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
                   (F.sum(c * v) / F.sum("c")).alias("mean"))
              .filter((F.col("n") > 1) & (F.col("high") > F.col("low"))))
    # squares of differences from the mean, not a difference of squares: means may be all but equal
    off = v - F.col("mean")
    shapes = (values.join(shapes, "genre").groupBy("genre", "n", "low", "high")
              .agg(F.sum(c * off * off).alias("squares")))
    variance = F.col("squares") / (F.col("n") - 1)
    h = F.sqrt(variance) * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    grid = shapes.select("genre", "n", h.alias("h"),
                         (F.col("low") - cut * h).alias("from"), (F.col("high") + cut * h).alias("to"))
    x = F.col("from") + F.col("point") * (F.col("to") - F.col("from")) / (points - 1)
    z = (F.col("x") - v) / F.col("h")
    kernel = F.exp(-0.5 * z * z) * c / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return (values.join(grid, "genre")
            .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .withColumn("x", x)
            .groupBy("genre", "point").agg(F.min("x").alias("x"), F.sum(kernel).alias("density")))


def top_titles(ratings: DataFrame, items: DataFrame, k: int = 20, grain: str = GENRE_GRAIN) -> DataFrame:
    """The ``k`` most rated titles; items sharing a title count together."""
    weighted = item_sums(ratings).join(items.select("item_id", "title", _grain_weight(grain).alias("w")), "item_id")
    return (weighted.groupBy("title").agg(F.sum(F.col("n") * F.col("w")).alias("n_ratings"))
            .orderBy(F.desc("n_ratings"), "title").limit(k))


def ratings_of_generous_users(ratings: DataFrame, items: DataFrame, threshold: float = 3.0,
                              grain: str = GENRE_GRAIN) -> DataFrame:
    """Rating rows of the users whose mean reaches ``threshold``."""
    generous = user_means(ratings, items, grain).filter(F.col("mean_rating") >= threshold).select("user_id")
    return ratings.join(generous, "user_id", "left_semi")


def reviews_by_release_year(ratings: DataFrame, items: DataFrame, k: int = 50, threshold: float = 3.0,
                            grain: str = GENRE_GRAIN) -> DataFrame:
    """Reviews per release year among generous users, the ``k`` most reviewed years."""
    kept = ratings_of_generous_users(ratings, items, threshold, grain)
    per_item = kept.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    dated = per_item.join(items.select("item_id", release_year("title").alias("release_year"),
                                       _grain_weight(grain).alias("w")), "item_id")
    return (dated.groupBy("release_year").agg(F.sum(F.col("n") * F.col("w")).alias("n_reviews"))
            .orderBy(F.desc("n_reviews"), "release_year").limit(k))


def reviews_by_genre(ratings: DataFrame, items: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Reviews per genre among generous users."""
    kept = ratings_of_generous_users(ratings, items, threshold, GENRE_GRAIN)
    per_item = kept.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return per_item.join(genres_of(items), "item_id").groupBy("genre").agg(F.sum("n").alias("n_reviews"))
