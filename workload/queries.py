"""Every registered query: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateweave import schemas
from rateweave.functions.lists import explode_lists
from rateweave.functions.text import split_list, title_case
from rateweave.operators.ranking import relative_sort
from rateweave.operators.scoring import predict_pairs, profile_vectors
from rateweave.plans import catalog, enrich, explore, factorize, gradient, recommend
from rateweave.session import checkpoint_dir, cut_lineage
from rateweave.sources import dictionary, readers, stored, writers
from rateweave.streaming.pending import run_pending
from workload.views import VIEWS, table, view

# The given pages have no image blocks; their menu entries have the same shape.
MENU_MARKUP = {"container": "li", "child": "a", "attribute": "href"}

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


class Tables:
    """The views of one data folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = (spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        return view(*self._at, name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema])


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- statistics ---

@query
def item_rating_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(explore.item_stats(t.ratings, t.items).orderBy(F.desc("n_ratings"), "item_id"))


@query
def items_mean_at_least(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(explore.items_with_mean_at_least(t.ratings, t.items, 2.5))


@query
def user_means(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = [explore.user_means(t.ratings, t.items, grain).withColumn("grain", F.lit(grain))
            for grain in (explore.RATING_GRAIN, explore.GENRE_GRAIN)]
    return rounded(both[0].unionByName(both[1]))


@query
def rating_histogram(spark, sf_dir):
    return rounded(explore.histogram(Tables(spark, sf_dir).ratings))


@query
def genre_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return explore.genre_counts(t.ratings, t.items)


@query
def genre_cloud(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return explore.top_genres(t.ratings, t.items, 500)


@query
def genre_year_mean(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(explore.genre_year_means(explore.with_year(t.ratings), t.items))


@query
def genre_year_slices(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(explore.genre_year_slices(explore.with_year(t.ratings), t.items))


@query
def item_genre_mean(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(explore.item_genre_means(t.ratings, t.items))


@query
def genre_density(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(explore.genre_density(t.ratings, t.items))


@query
def top_titles_by_rating(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = [explore.top_titles(t.ratings, t.items, 20, grain).withColumn("grain", F.lit(grain))
            for grain in (explore.RATING_GRAIN, explore.GENRE_GRAIN)]
    return both[0].unionByName(both[1])


@query
def release_year_reviews(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = [explore.reviews_by_release_year(t.ratings, t.items, 50, 3.0, grain).withColumn("grain", F.lit(grain))
            for grain in (explore.RATING_GRAIN, explore.GENRE_GRAIN)]
    return both[0].unionByName(both[1])


def _stored(spark, sf_dir):
    return stored.store_ratings(Tables(spark, sf_dir).ratings, f"ratings_{uuid.uuid4().hex}", _folder(spark, "ratings"))


@query
def stored_item_stats(spark, sf_dir):
    """Count and mean by item, from ratings in buckets."""
    return rounded(explore.with_means(_stored(spark, sf_dir).sums("item_id"), Tables(spark, sf_dir).items))


@query
def stored_generous_reviews(spark, sf_dir):
    """Reviews of every item by users with a mean of at least three; neither sums nor join move a rating."""
    ratings = _stored(spark, sf_dir)
    generous = ratings.sums("user_id").filter(F.col("total") / F.col("n") >= 3.0).select("user_id")
    return ratings.join(generous, "user_id", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_reviews"))


@query
def stored_pairs(spark, sf_dir):
    """Every rated pair once, with its number and sum of ratings."""
    return _stored(spark, sf_dir).pairs("user_id")


@query
def genre_reviews(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return explore.reviews_by_genre(t.ratings, t.items)


# --- catalogue ---

@query
def items_never_rated(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # only ratings of items with a page: not every item has one
    paged = t.ratings.join(t.item_pages.select("item_id").distinct(), "item_id")
    return catalog.never_rated(t.items, paged)


@query
def items_never_picked(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return catalog.never_rated(t.items, catalog.picks_of(t.users))


@query
def items_rated(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return catalog.rated(t.items, t.ratings)


@query
def distinct_counts(spark, sf_dir):
    return Tables(spark, sf_dir).ratings.agg(F.countDistinct("user_id").alias("n_users"),
                                             F.countDistinct("item_id").alias("n_items"))


def _indexes(ratings):
    return (catalog.dense_index(ratings, "user_id", ["rated_at", "item_id"]),
            catalog.dense_index(ratings, "item_id", ["rated_at", "user_id"]))


@query
def dense_ids(spark, sf_dir):
    users, items = _indexes(Tables(spark, sf_dir).ratings)
    return (users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "idx")
            .unionAll(items.select(F.lit("item"), "item_id", "idx")))


@query
def growing_ids(spark, sf_dir):
    """Users and items numbered in two batches: the older ratings, then all of them."""
    ratings = Tables(spark, sf_dir).ratings
    older = ratings.filter(F.col("rated_at") < F.lit("1992-06-01").cast("date"))
    folder, found = _folder(spark, "dictionary"), []
    for kind, key, other in (("user", "user_id", "item_id"), ("item", "item_id", "user_id")):
        for batch, part in ((1, older), (2, ratings)):
            numbered = dictionary.grow_dictionary(part, f"{folder}/{kind}", batch, key, ["rated_at", other])
        found.append(numbered.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "idx", "batch"))
    return found[0].unionAll(found[1])


@query
def dense_ratings(spark, sf_dir):
    # both indexes, the hot keys and the result read them
    ratings = cut_lineage(Tables(spark, sf_dir).ratings)
    indexed = catalog.with_dense_ids(ratings.drop("rated_at"), *_indexes(ratings))
    return indexed.select("user_idx", "item_idx", F.col("rating").cast("double").alias("rating"))


@query
def pick_list_rows(spark, sf_dir):
    users = Tables(spark, sf_dir).users
    lists = users.select("id", F.coalesce(split_list("item_ids", ","), F.array().cast("array<string>")).alias("pick"))
    lists = lists.withColumn("padded", F.transform("pick", lambda x: F.concat(F.lit("#"), x)))
    return explode_lists(lists, ["pick", "padded"], fill_value="", position="pos")


@query
def title_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    wanted = t.users.select(F.col("id").alias("user_id"),
                            F.posexplode(split_list("item_ids", ",")).alias("pos", "wanted"))
    titles = t.items.select(F.col("item_id").cast("string").alias("wanted"), "title")
    wishes = wanted.join(titles, "wanted").select("user_id", "pos", "title")
    found, _ = catalog.match_titles(wishes, t.items)
    return catalog.join_picks(found)


@query
def title_prefix(spark, sf_dir):
    return catalog.titles_with_prefix(Tables(spark, sf_dir).items, "RED w").orderBy("item_id")


@query
def user_by_name(spark, sf_dir):
    return catalog.lookup(Tables(spark, sf_dir).users, "name", "Customer#000000001", "id", "item_ids")


@query
def pending_users(spark, sf_dir):
    return catalog.pending_users(Tables(spark, sf_dir).users)


@query
def user_status(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # the results of one finished run: lists for the users marked as done, as the recurring job stores them
    done = t.users.filter(F.col("job_status") == "done").select("id", "item_ids")
    scores = recommend.quick_scores(done, t.item_factors, k=3).withColumnRenamed("score", "prediction")
    folder = _folder(spark, "status")
    writers.write_recommendations(scores, folder, "run-1")
    return catalog.user_status(t.users, writers.read_runs(spark, folder, schemas.RECOMMENDATIONS))


@query
def new_user_ids(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return catalog.register(t.users, t.sign_ups)


@query
def next_user_id(spark, sf_dir):
    return catalog.next_id(Tables(spark, sf_dir).users)


@query
def display_names(spark, sf_dir):
    return Tables(spark, sf_dir).users.select("id", title_case("name").alias("display_name"))


@query
def csv_ratings(spark, sf_dir):
    ratings = Tables(spark, sf_dir).ratings
    seconds = F.datediff(F.col("rated_at").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    folder = _folder(spark, "csv")
    ratings.select(F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"), "rating", seconds.alias("timestamp")
                   ).write.option("header", True).csv(folder)
    accepted, _ = readers.read_ratings_csv(spark, folder)
    return explore.with_year(accepted).withColumn("rating", F.col("rating").cast("double"))


@query
def typed_ratings(spark, sf_dir):
    ratings = Tables(spark, sf_dir).ratings
    seconds = F.datediff(F.col("rated_at").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    text = ratings.select(F.col("user_id").cast("string"), F.col("item_id").cast("string"),
                          F.col("rating").cast("string"), seconds.alias("rated_at"))
    accepted, _ = readers.typed_ratings(text)
    return explore.with_year(accepted).withColumn("rating", F.col("rating").cast("double"))


@query
def ratings_with_new_users(spark, sf_dir):
    t = Tables(spark, sf_dir)
    merged = catalog.with_new_users(t.ratings, catalog.pending_users(t.users))
    return merged.withColumn("rating", F.col("rating").cast("double"))


@query
def unrated_candidates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return catalog.unrated_counts(catalog.picks_of(catalog.pending_users(t.users)), t.ratings)


# --- scoring with given factors ---

@query
def profile_vector_values(spark, sf_dir):
    t = Tables(spark, sf_dir)
    picks = catalog.pick_ratings(catalog.picks_of(catalog.pending_users(t.users)))
    return rounded(profile_vectors(picks, t.item_factors)
                   .select("user_id", F.posexplode("features").alias("pos", "value")))


@query
def pick_affinity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    picks = catalog.picks_of(catalog.pending_users(t.users))
    profiles = profile_vectors(catalog.pick_ratings(picks), t.item_factors)
    return rounded(predict_pairs(picks, profiles, t.item_factors))


@query
def quick_top12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(recommend.quick_scores(catalog.pending_users(t.users), t.item_factors))


@query
def relative_order(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.users.select(F.col("id").alias("list_id"), F.posexplode(split_list("item_ids", ",")).alias("pos", "v"))
    a = a.select("list_id", "pos", F.col("v").cast("int").alias("value"))
    # picks name ids that the supplier table partly lacks
    known = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("value"),
        (F.round(F.col("s_acctbal") * 100).cast("bigint") * 10000000 + F.col("s_suppkey")).alias("order"))
    b = a.join(known, "value").select("list_id", F.col("order").alias("pos"), "value")
    return relative_sort(a, b).withColumn("value", F.coalesce("value", F.lit(-1)))


# --- enrichment ---

@query
def ext_links(spark, sf_dir):
    return enrich.item_links(Tables(spark, sf_dir).links)


@query
def available_items(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return enrich.available_items(enrich.item_links(t.links), t.item_pages, "item_id", markup=None)


@query
def page_attributes(spark, sf_dir):
    return enrich.page_attributes(Tables(spark, sf_dir).item_pages, "item_id", MENU_MARKUP)


@query
def enriched_top12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    available = enrich.available_items(enrich.item_links(t.links), t.item_pages, "item_id", markup=None)
    recs = recommend.quick_recommendations(catalog.pending_users(t.users), t.item_factors, available, pages=t.item_pages,
                                           key="item_id", markup=MENU_MARKUP, items=t.items)
    return rounded(recs.select("user_id", "rank", "item_id", "title", "prediction", "link", "image_link"))


@query
def personal_top48_given_factors(spark, sf_dir):
    t = Tables(spark, sf_dir)
    available = enrich.available_items(enrich.item_links(t.links), t.item_pages, "item_id", MENU_MARKUP, require_image=True)
    picks = catalog.picks_of(catalog.pending_users(t.users))
    profiles = profile_vectors(catalog.pick_ratings(picks), t.item_factors)
    return rounded(recommend.score_model(profiles, t.item_factors, picks, available))


@query
def relabelled_scores(spark, sf_dir):
    t = Tables(spark, sf_dir)
    scores = recommend.quick_scores(catalog.pending_users(t.users), t.item_factors)
    return rounded(recommend.relabel(scores, t.users.select(F.col("id").alias("user_id"), F.col("name").alias("external_id"))))


@query
def factor_round_trip(spark, sf_dir):
    folder = _folder(spark, "factors")
    writers.export_item_factors(Tables(spark, sf_dir).item_factors, folder)
    back = readers.read_item_factors(spark, folder)
    return back.select("item_id", F.posexplode("features").alias("pos", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


# --- models ---

def _start(ratings, rank):
    """Start vectors that SQL can state as well."""
    start = [1.0 + F.col("item_id") % m / float(m) for m in (10, 7)][:rank]
    return ratings.select("item_id").distinct().select("item_id", F.array(*start).alias("features"))


def _weighted(spark, sf_dir, rank, **how):
    ratings = Tables(spark, sf_dir).ratings
    return factorize.weighted_als(ratings, rank, sweeps=2, ridge=0.1, item_start=_start(ratings, rank), **how)


def _implicit2(spark, sf_dir, **how):
    ratings = Tables(spark, sf_dir).ratings
    return factorize.implicit_factors(ratings, 2, 2, item_start=_start(ratings, 2), **how)


def _factor_rows(model):
    sides = [frame.select(F.lit(side).alias("side"), F.col(key).alias("id"), F.posexplode("features").alias("pos", "value"))
             for side, key, frame in (("user", "user_id", model.users), ("item", "item_id", model.items))]
    return rounded(sides[0].unionAll(sides[1]))


@query
def als_rank1(spark, sf_dir):
    return _factor_rows(_weighted(spark, sf_dir, 1))


@query
def als_rank2(spark, sf_dir):
    return _factor_rows(_weighted(spark, sf_dir, 2))


@query
def als_rank2_wide(spark, sf_dir):
    """The same model by the solver for wide vectors."""
    return _factor_rows(_weighted(spark, sf_dir, 2, widest=0))


@query
def implicit_als_rank2(spark, sf_dir):
    return _factor_rows(_implicit2(spark, sf_dir))


@query
def implicit_als_rank2_wide(spark, sf_dir):
    return _factor_rows(_implicit2(spark, sf_dir, widest=0))


@query
def explicit_als_rank2(spark, sf_dir):
    ratings = Tables(spark, sf_dir).ratings
    return _factor_rows(factorize.als_factors(ratings, implicit=False, rank=2, iterations=2, item_start=_start(ratings, 2)))


@query
def explicit_als_rank2_wide(spark, sf_dir):
    ratings = Tables(spark, sf_dir).ratings
    return _factor_rows(factorize.explicit_factors(ratings, 2, 2, item_start=_start(ratings, 2), widest=0))


@query
def folded_in_users(spark, sf_dir):
    """Factors of the pending users from their picks, over items trained on the ratings alone."""
    t = Tables(spark, sf_dir)
    picks = catalog.pick_ratings(catalog.picks_of(catalog.pending_users(t.users)))
    users = factorize.fold_in(picks, _implicit2(spark, sf_dir).items)
    return rounded(users.select("user_id", F.posexplode("features").alias("pos", "value")))


@query
def folded_in_top48(spark, sf_dir):
    pending = catalog.pending_users(Tables(spark, sf_dir).users)
    return rounded(recommend.folded_in_scores(pending, _implicit2(spark, sf_dir).items))


@query
def implicit_top48(spark, sf_dir):
    pending = catalog.pending_users(Tables(spark, sf_dir).users)
    model = _implicit2(spark, sf_dir)
    users = model.users.join(pending.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return rounded(recommend.score_model(users, model.items, catalog.picks_of(pending)))


@query
def als_error(spark, sf_dir):
    return rounded(_weighted(spark, sf_dir, 1).errors, 4)


@query
def als_residual(spark, sf_dir):
    model = _weighted(spark, sf_dir, 1)
    return rounded(factorize.masked_squared_error(Tables(spark, sf_dir).ratings, model), 4)


@query
def als_predict(spark, sf_dir):
    model = _weighted(spark, sf_dir, 1)
    pairs = Tables(spark, sf_dir).ratings.select("user_id", "item_id").distinct()
    return rounded(predict_pairs(pairs, model.users, model.items, size=1))


@query
def als_rank8(spark, sf_dir):
    ratings = Tables(spark, sf_dir).ratings
    model = factorize.weighted_als(ratings, 8, sweeps=3, ridge=0.2)
    return rounded(model.errors, 2)


@query
def holdout_split(spark, sf_dir):
    return (factorize.holdout(Tables(spark, sf_dir).ratings).groupBy("is_train")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rating").cast("double")).alias("total")))


@query
def bias_validation(spark, sf_dir):
    marked = factorize.holdout(Tables(spark, sf_dir).ratings)
    model = factorize.biased_factorization(marked.filter("is_train"), 0, sweeps=3, bias_ridge=0.1)
    validation = marked.filter("not is_train").select("user_id", "item_id", "rating")
    return rounded(factorize.squared_error(factorize.predict_biased(validation, model)))


@query
def item_bias_best_worst(spark, sf_dir):
    t = Tables(spark, sf_dir)
    model = factorize.biased_factorization(t.ratings, 0, sweeps=3, bias_ridge=0.1)
    return factorize.rank_items_by_bias(model, t.ratings, t.items)


@query
def biased_one_factor(spark, sf_dir):
    """Vector and bias of every user and item in the biased model with one factor."""
    ratings = Tables(spark, sf_dir).ratings
    model = factorize.biased_factorization(ratings, 1, sweeps=2, bias_ridge=0.1, factor_ridge=2.0, item_start=_start(ratings, 1))
    sides = [frame.select(F.lit(side).alias("side"), F.col(f"{side}_id").alias("id"), F.col("features")[0].alias("factor"), "bias")
             for side, frame in (("user", model.users), ("item", model.items))]
    return rounded(sides[0].unionAll(sides[1]))


@query
def biased_factors_best_worst(spark, sf_dir):
    t = Tables(spark, sf_dir)
    model = factorize.biased_factorization(t.ratings, 8, sweeps=3, bias_ridge=0.1, factor_ridge=2.0)
    return factorize.rank_items_by_bias(model, t.ratings, t.items)


@query
def gradient_validation(spark, sf_dir):
    """Held-out error of the biased model with eight factors by stochastic gradient."""
    # training and validation read them several times
    marked = cut_lineage(factorize.holdout(Tables(spark, sf_dir).ratings.select("user_id", "item_id", "rating")))
    model = gradient.stochastic_factors(marked.filter("is_train"), 2, 8, [(2, 0.1, 2e-4), (1, 1e-2, 2e-6)], 128)
    return rounded(factorize.squared_error(factorize.predict_biased(marked.filter("not is_train"), model)))


@query
def implicit_als_top48(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return recommend.personal_scores(catalog.pending_users(t.users), t.ratings)


@query
def personal_top48(spark, sf_dir):
    t = Tables(spark, sf_dir)
    available = enrich.available_items(enrich.item_links(t.links), t.item_pages, "item_id", MENU_MARKUP,
                                       require_image=True)
    return recommend.personal_recommendations(catalog.pending_users(t.users), t.ratings, available)


@query
def implicit_item_factors(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return factorize.implicit_factors(t.ratings).items.select("item_id", F.posexplode("features").alias("pos", "value"))


# --- the recurring job ---

@query
def stream_quick_top12(spark, sf_dir):
    factors = view(spark, sf_dir, "item_factors")
    source = spark.readStream.schema(table(spark, sf_dir, "customer").schema).parquet(f"{sf_dir}/customer*.parquet")
    selections = spark.sql(VIEWS["users"], customer=source)
    folder = _folder(spark, "stream")

    def top12(pending):
        return recommend.quick_scores(pending, factors).withColumnRenamed("score", "prediction")

    run_pending(selections, top12, f"{folder}/results", f"{folder}/ledger", f"{folder}/progress").awaitTermination()
    return writers.read_runs(spark, f"{folder}/results", schemas.RECOMMENDATIONS).select("user_id", "rank", "item_id")
