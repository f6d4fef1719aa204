"""Factor models: implicit-feedback ALS, plain weighted ALS, biased factorization."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rateweave.functions.vectors import dot, hash_vector
from rateweave.operators.least_squares import WIDEST_COLUMN_SUMS, Pairs, gram_matrix, lay_out, solve_side
from rateweave.operators.scoring import predict_pairs
from rateweave.operators.skew import hot_keys_by, split_join
from rateweave.session import cut_lineage, release
from rateweave.sources.sweeps import SweepFolder, checksum

# The reference model's settings, including the defaults it leaves unset.
RANK = 24
ITERATIONS = 10
REGULARIZATION = 0.1
IMPLICIT_ALPHA = 0.01
SEED = 42


@dataclass(frozen=True)
class FactorModel:
    """``users(user_id, features[, bias])``, ``items(item_id, features[, bias])`` and the masked squared
    error after every sweep, ``errors(sweep, error)``."""

    users: DataFrame
    items: DataFrame
    errors: DataFrame | None


def als_factors(ratings: DataFrame, implicit: bool = True, **how) -> FactorModel:
    """The model by alternating least squares of either kind of feedback."""
    return (implicit_factors if implicit else explicit_factors)(ratings, **how)


def implicit_factors(ratings: DataFrame, rank: int = RANK, iterations: int = ITERATIONS,
                     regularization: float = REGULARIZATION, alpha: float = IMPLICIT_ALPHA, seed: int = SEED,
                     item_start: DataFrame | None = None, widest: int = WIDEST_COLUMN_SUMS,
                     folder: str | None = None) -> FactorModel:
    """User and item factors of implicit feedback by alternating least squares.

    The equations are those of MLlib's ALS: the ridge counts once per like, unrated pairs count with confidence one.
    MLlib keeps all ratings of one user or item in one block, which a popular item outgrows; here hot keys are split,
    so this is the one solver for every size. Users are solved first, from ``item_start(item_id, features)`` or from
    hashed numbers around zero. With ``folder`` every whole sweep is stored there, and a run that is started again with
    the same ratings and settings goes on after the last one.
    """
    pairs = lay_out(ratings, alpha=alpha)
    settings = {"kind": "implicit", "rank": rank, "regularization": regularization, "alpha": alpha, "seed": seed}

    def solved(key, fixed, fixed_key):
        base = gram_matrix(fixed, rank)
        return _solve_plain(pairs, key, fixed, fixed_key, rank, regularization, widest, base=base)

    return _alternate(pairs, solved, rank, iterations, seed, item_start, folder, settings)


def explicit_factors(ratings: DataFrame, rank: int = RANK, iterations: int = ITERATIONS,
                     regularization: float = REGULARIZATION, seed: int = SEED, item_start: DataFrame | None = None,
                     widest: int = WIDEST_COLUMN_SUMS, folder: str | None = None) -> FactorModel:
    """User and item factors of ratings by alternating least squares; the ridge counts once for every rating of a key.

    The equations are those of MLlib's ALS without implicit feedback; the rest is as in ``implicit_factors``.
    """
    pairs = lay_out(ratings)
    settings = {"kind": "explicit", "rank": rank, "regularization": regularization, "seed": seed}

    def solved(key, fixed, fixed_key):
        return _solve_plain(pairs, key, fixed, fixed_key, rank, regularization, widest, by_count=True)

    return _alternate(pairs, solved, rank, iterations, seed, item_start, folder, settings)


def _alternate(pairs: Pairs, solved: Callable, rank: int, iterations: int, seed: int, item_start: DataFrame | None,
               folder: str | None, settings: dict) -> FactorModel:
    if iterations < 1:
        raise ValueError("at least one iteration is needed")
    if item_start is None:
        start = F.transform(hash_vector("item_id", rank, 1.0, seed), lambda x: x - 0.5)
        item_start = pairs.keys("item_id").select("item_id", start.alias("features"))
    users, items, done, sweeps = None, cut_lineage(item_start), 0, None  # as in ``weighted_als``
    if folder is not None:
        sweeps = SweepFolder(pairs.rows.sparkSession, folder,
                             {**settings, "pairs": checksum(pairs.rows), "start": checksum(item_start)})
        done, users, items = sweeps.last(iterations) or (0, users, items)
    for sweep in range(done + 1, iterations + 1):
        users = cut_lineage(solved("user_id", items, "item_id").select("user_id", "features"))
        release(pairs.rows.sparkSession)
        items = cut_lineage(solved("item_id", users, "user_id").select("item_id", "features"))
        release(pairs.rows.sparkSession)
        if sweeps is not None:
            sweeps.store(sweep, users, items)
    return FactorModel(users, items, None)


def fold_in(ratings: DataFrame, items: DataFrame, regularization: float = REGULARIZATION, alpha: float | None = IMPLICIT_ALPHA,
            widest: int = WIDEST_COLUMN_SUMS) -> DataFrame:
    """``(user_id, features)`` of users that ``items(item_id, features)`` were not trained on, from their ``ratings``.

    One regularised solve per user over the fixed item factors, the same as a half-sweep of training would do: with
    ``alpha`` for implicit feedback, whose base matrix over all items is summed once, without it for ratings. Ratings of
    items without factors count nowhere; a user without any other rating has no row. No model is trained.
    """
    width = items.select(F.size("features").alias("n")).head()
    if width is None:
        raise ValueError("there are no item factors")
    known = ratings.join(items.select("item_id"), "item_id", "left_semi")
    pairs = lay_out(known, alpha=alpha)
    how = {"by_count": True} if alpha is None else {"base": gram_matrix(items, width.n)}
    return _solve_plain(pairs, "user_id", items, "item_id", width.n, regularization, widest, **how).select("user_id", "features")


def weighted_als(ratings: DataFrame, rank: int, sweeps: int, ridge: float, item_start: DataFrame | None = None,
                 threshold: float = 0.5, seed: int = SEED, widest: int = WIDEST_COLUMN_SUMS) -> FactorModel:
    """Alternating ridge solves over the ratings above ``threshold``; the ridge is not scaled by counts.

    Users are solved first, from ``item_start(item_id, features)`` or from hashed numbers in [0, 5).
    """
    if sweeps < 1:
        raise ValueError("at least one sweep is needed")
    pairs = lay_out(ratings.filter(F.col("rating") > threshold))
    if item_start is None:
        item_start = pairs.keys("item_id").withColumn(
            "features", hash_vector("item_id", rank, 5.0, seed))
    # a side that is still to be computed may lie in more partitions than the pairs, and Spark would move these to it
    items = cut_lineage(item_start)
    users, errors = None, []
    for sweep in range(1, sweeps + 1):
        users = cut_lineage(_solve_plain(pairs, "user_id", items, "item_id", rank, ridge, widest).select("user_id", "features"))
        items = cut_lineage(_solve_plain(pairs, "item_id", users, "user_id", rank, ridge, widest))
        errors.append(_error(items, sweep))
    return FactorModel(users.select("user_id", "features"), items.select("item_id", "features"),
                       reduce(DataFrame.unionAll, errors))


def _solve_plain(pairs, key, fixed, fixed_key, rank, ridge, widest, **how):
    design = fixed.select(fixed_key, F.col("features").cast("array<double>").alias("design"), F.lit(0.0).alias("offset"))
    return (solve_side(pairs, key, design, fixed_key, [ridge] * rank, widest, **how)
            .withColumnRenamed("solution", "features"))


def biased_factorization(ratings: DataFrame, n_factors: int, sweeps: int, bias_ridge: float,
                         factor_ridge: float = 0.1, seed: int = SEED, item_start: DataFrame | None = None,
                         widest: int = WIDEST_COLUMN_SUMS) -> FactorModel:
    """Fit ``rating = p_u . q_i + b_u + b_i`` by alternating ridge solves; 0 factors give the pure bias model.

    Each side's vector and bias are solved together. Item biases start at zero, item vectors at
    ``item_start(item_id, features)`` or at hashed numbers around zero.
    """
    if sweeps < 1:
        raise ValueError("at least one sweep is needed")
    pairs = lay_out(ratings)
    start = F.transform(hash_vector("item_id", n_factors, 1.0, seed), lambda x: x - 0.5) if n_factors else \
        F.array().cast("array<double>")
    if item_start is None:
        item_start = pairs.keys("item_id").select("item_id", start.alias("features"))
    items = item_start.select("item_id", F.col("features").cast("array<double>").alias("features"), F.lit(0.0).alias("bias"))
    items = cut_lineage(items)  # as in ``weighted_als``
    ridge = [factor_ridge] * n_factors + [bias_ridge]
    users, errors = None, []
    for sweep in range(1, sweeps + 1):
        users = cut_lineage(_solve_biased(pairs, "user_id", items, "item_id", n_factors, ridge, widest))
        items = cut_lineage(_solve_biased(pairs, "item_id", users, "user_id", n_factors, ridge, widest))
        errors.append(_error(items, sweep))
    return FactorModel(users.drop("squared_error"), items.drop("squared_error"), reduce(DataFrame.unionAll, errors))


def _solve_biased(pairs, key, fixed, fixed_key, n_factors, ridge, widest):
    design = fixed.select(fixed_key, F.concat("features", F.array(F.lit(1.0))).alias("design"),
                          F.col("bias").alias("offset"))
    solved = solve_side(pairs, key, design, fixed_key, ridge, widest)
    return solved.select(key, F.slice("solution", 1, n_factors).alias("features"),
                         F.col("solution")[n_factors].alias("bias"), "n", "squared_error")


def _error(items: DataFrame, sweep: int) -> DataFrame:
    return items.agg(F.sum("squared_error").alias("error")).select(F.lit(sweep).alias("sweep"), "error")


def predict_biased(pairs: DataFrame, model: FactorModel) -> DataFrame:
    """Add ``prediction``; pairs whose user or item the model has not seen drop out."""
    hot = hot_keys_by(pairs, ["user_id", "item_id"])
    with_user = split_join(pairs, model.users.select("user_id", F.col("features").alias("_p"),
                                                     F.col("bias").alias("_bu")), "user_id", ["item_id"], hot=hot)
    with_both = split_join(with_user, model.items.select("item_id", F.col("features").alias("_q"),
                                                         F.col("bias").alias("_bi")), "item_id", ["user_id"], hot=hot)
    prediction = dot("_p", "_q") + F.col("_bu") + F.col("_bi")
    return with_both.withColumn("prediction", prediction).drop("_p", "_q", "_bu", "_bi")


def masked_squared_error(ratings: DataFrame, model: FactorModel, threshold: float = 0.5) -> DataFrame:
    """Sum of squared residuals of ``user . item`` over the ratings above ``threshold``, and their number."""
    predicted = predict_pairs(ratings.filter(F.col("rating") > threshold), model.users, model.items)
    return squared_error(predicted)


def squared_error(predicted: DataFrame) -> DataFrame:
    """``(n, squared_error, mse)`` of ``rating`` against ``prediction``."""
    residual = F.col("rating").cast("double") - F.col("prediction")
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.sum(residual * residual).alias("squared_error"),
                         F.avg(residual * residual).alias("mse"))


def holdout(ratings: DataFrame, train_share: float = 0.8, seed: int = SEED) -> DataFrame:
    """Add ``is_train``, decided by a digest of the pair: independent of partitioning, repeatable anywhere."""
    limit = f"{min(int(train_share * 16 ** 8), 16 ** 8 - 1):08x}"
    pair = F.concat_ws("-", F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.lit(str(seed)))
    return ratings.withColumn("is_train", F.substring(F.md5(pair.cast("binary")), 1, 8) < limit)


def rank_items_by_bias(model: FactorModel, ratings: DataFrame, items: DataFrame, most_rated: int = 3000,
                       worst: int = 15, best: int = 48) -> DataFrame:
    """The ``worst`` and ``best`` items by learned bias among the ``most_rated`` ones.

    ``(list, rank, item_id, title, n_ratings, bias)``; equal biases go by popularity, then by id.
    """
    counts = ratings.groupBy("item_id").agg(F.count("rating").alias("n_ratings"))
    top = counts.orderBy(F.desc("n_ratings"), "item_id").limit(most_rated)
    # at most ``most_rated`` rows, written once because both lists read them
    named = cut_lineage(top.join(model.items.select("item_id", F.round("bias", 6).alias("bias")), "item_id")
                           .join(items.select("item_id", "title"), "item_id"))
    ties = [F.desc("n_ratings"), F.col("item_id")]
    return _numbered(named, "worst", [F.asc("bias"), *ties], worst).unionAll(
        _numbered(named, "best", [F.desc("bias"), *ties], best))


def _numbered(named: DataFrame, label: str, order: list, k: int) -> DataFrame:
    top = named.orderBy(*order).limit(k)
    # numbering follows the limit, so the window sees k rows
    rank = F.row_number().over(Window.orderBy(*order))
    return top.select(F.lit(label).alias("list"), rank.alias("rank"), "item_id", "title", "n_ratings", "bias")
