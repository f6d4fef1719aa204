"""Users, items and their identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateweave.functions.text import has_prefix, parse_ids
from rateweave.operators.ranking import global_row_number
from rateweave.operators.skew import hot_keys_by, split_join

# The last user of the seed ratings, and the rating given to a picked item.
SEED_LAST_USER = 610
PICK_RATING = 5.0


def lookup(df: DataFrame, column: str, value, *columns: str) -> DataFrame:
    """Rows whose ``column`` equals ``value``; the filter reaches the scan."""
    found = df.filter(F.col(column) == F.lit(value))
    return found.select(*columns) if columns else found


def has_picks():
    return F.col("item_ids").isNotNull() & (F.trim("item_ids") != "")


def pending_users(users: DataFrame, exclude_ids: tuple[int, ...] = (SEED_LAST_USER,), more: list = ()) -> DataFrame:
    """Users who have picked items and whose recommendations have not been made: ``(id, item_ids)`` and what ``more`` adds."""
    return (users.filter(~F.col("id").isin(*exclude_ids) & has_picks() & F.col("job_status").isNull())
                 .select("id", "item_ids", *more))


def picks_of(users: DataFrame) -> DataFrame:
    """``(user_id, item_id)`` once per picked item; malformed list elements are left out."""
    return (users.select(F.col("id").alias("user_id"), F.explode(parse_ids("item_ids")).alias("item_id"))
                 .filter(F.col("item_id").isNotNull()).distinct())


def pick_ratings(picks: DataFrame, rating: float = PICK_RATING) -> DataFrame:
    return picks.select("user_id", "item_id", F.lit(rating).cast("float").alias("rating"))


def with_new_users(ratings: DataFrame, users: DataFrame) -> DataFrame:
    """Ratings together with the picks of ``users`` as ratings, in the types of ``ratings``."""
    base = ratings.select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), F.col("rating").cast("float"))
    listed = users.select(F.col("id").alias("user_id"), F.explode(parse_ids("item_ids")).alias("item_id"))
    return base.unionByName(pick_ratings(listed.filter(F.col("item_id").isNotNull())))


def user_status(users: DataFrame, results: DataFrame) -> DataFrame:
    """``(id, status)``: ``no_picks``, ``ready`` when results are stored, otherwise ``pending``."""
    done = results.select(F.col("user_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    status = (F.when(~F.coalesce(has_picks(), F.lit(False)), "no_picks")
               .when(F.col("_done"), "ready").otherwise("pending"))
    return users.join(done, "id", "left").select("id", status.alias("status"))


def next_id(users: DataFrame) -> DataFrame:
    """One row holding the id after the largest one, 1 for an empty table."""
    return users.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("bigint").alias("next_id"))


def register(users: DataFrame, sign_ups: DataFrame) -> DataFrame:
    """``(id, name)`` for the sign-ups ``(ordinal, name)`` whose name is free.

    A name asked for twice in the batch goes to the earlier ordinal. Ids continue after the largest one in
    the order of the ordinals.
    """
    first = sign_ups.groupBy("name").agg(F.min("ordinal").alias("ordinal"))
    free = first.join(users.select("name"), "name", "left_anti")
    numbered = global_row_number(free, ["ordinal", "name"], "_n")
    return numbered.select((F.col("_n") + next_id(users).scalar() - 1).alias("id"), "name")


def match_titles(wishes: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve ``wishes(user_id, pos, title)``: found ``(user_id, pos, item_id)`` and unknown rows.

    A title shared by several items means the one with the smallest id.
    """
    by_title = items.groupBy("title").agg(F.min("item_id").alias("item_id"))
    found = wishes.join(by_title, "title", "left")
    return (found.filter(F.col("item_id").isNotNull()).select("user_id", "pos", "item_id"),
            found.filter(F.col("item_id").isNull()).select("user_id", "pos", "title"))


def join_picks(found: DataFrame) -> DataFrame:
    """``(user_id, item_ids)``: a user's picks as comma-separated text in the order of ``pos``.

    The text is one value of the users table, so a user's picks are few by design of that table.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "item_id")))
    text = F.array_join(F.transform(ordered, lambda p: p["item_id"].cast("string")), ",")
    return found.groupBy("user_id").agg(text.alias("item_ids"))


def titles_with_prefix(items: DataFrame, prefix: str) -> DataFrame:
    return items.filter(has_prefix("title", prefix)).select("item_id", "title")


def never_rated(items: DataFrame, ratings: DataFrame) -> DataFrame:
    return items.join(ratings.select("item_id").distinct(), "item_id", "left_anti")


def rated(items: DataFrame, ratings: DataFrame) -> DataFrame:
    return items.join(ratings.select("item_id").distinct(), "item_id", "left_semi")


def dense_index(df: DataFrame, key: str, order: list[str], name: str = "idx") -> DataFrame:
    """``(key, idx)``: 0-based index of every distinct ``key`` by first appearance in ``order``."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return global_row_number(first, ["_first", key], name, start=0).select(key, name)


def with_dense_ids(ratings: DataFrame, user_index: DataFrame, item_index: DataFrame) -> DataFrame:
    """Ratings with ``user_idx`` and ``item_idx`` in place of the ids."""
    users = user_index.select("user_id", F.col("idx").alias("user_idx"))
    items = item_index.select("item_id", F.col("idx").alias("item_idx"))
    hot = hot_keys_by(ratings, ["user_id", "item_id"])
    with_user = split_join(ratings, users, "user_id", ["item_id"], hot=hot)
    indexed = split_join(with_user, items, "item_id", ["user_idx"], hot=hot)
    return indexed.drop("user_id", "item_id")


def unrated_counts(picks: DataFrame, ratings: DataFrame) -> DataFrame:
    """``(user_id, n_candidates)``: how many rated items each picking user has not picked.

    The candidates are counted, not listed: all rated items less the user's picks among them.
    """
    known = ratings.select("item_id").filter(F.col("item_id").isNotNull()).distinct()
    hits = picks.join(known.withColumn("_known", F.lit(1)), "item_id", "left")
    total = known.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (hits.groupBy("user_id").agg(F.count("_known").alias("_n"))
            .select("user_id", (total - F.col("_n")).alias("n_candidates")))


def unrated_pairs(pairs: DataFrame, picks: DataFrame) -> DataFrame:
    """Those of the given ``(user_id, item_id)`` pairs that are not picks, each once."""
    return pairs.join(picks.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").distinct()
