"""Wide half-sweeps by blocks and routes, explicit mode, fold-in, and training that goes on after a stop."""

import os
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rateweave.operators import least_squares
from rateweave.plans import factorize
from rateweave.plans.recommend import folded_in_scores
from tests.test_factorize import dense_implicit, uneven


def frame(spark, data):
    return spark.createDataFrame(data, "user_id int, item_id int, rating float")


def vectors(df, key):
    return {r[key]: list(r["features"]) for r in df.collect()}


def started(spark, data, rank):
    start = {i: np.random.default_rng(i).normal(size=rank) for i in {i for _, i, _ in data}}
    return start, spark.createDataFrame([(i, v.tolist()) for i, v in start.items()], "item_id int, features array<double>")


def close(got, want):
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(list(value), abs=1e-8)


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_no_pair_moves_in_a_wide_step(spark):
    data = uneven()
    pairs = least_squares.lay_out(frame(spark, data))
    side = pairs.keys("item_id").select("item_id", F.array(*[F.lit(0.1)] * 24).alias("design"), F.lit(0.0).alias("offset"))
    text = plan(least_squares.solve_side(pairs, "user_id", side, "item_id", [0.1] * 24))
    branch = text[text.index("FlatMapCoGroupsInArrow"):]
    to_scan = branch[branch.index("\n"):branch.index("Scan ExistingRDD")]
    assert "Exchange" not in to_scan and "Sort" not in to_scan
    # a vector goes once to a block that holds its key, however many pairs are there
    placed, routes = pairs.blocks["user_id"]
    assert routes.count() == placed.select("block", "item_id").distinct().count() < placed.count()
    join = branch[branch.index("Join"):]
    assert "Exchange" not in join[join.index("\n"):join.index("Scan ExistingRDD")]


def test_every_block_has_a_partition_of_its_own(spark):
    names = least_squares._names(spark, 13)
    df = spark.createDataFrame([(n,) for n in names], "block long").repartition(13, "block")
    assert df.select(F.spark_partition_id()).distinct().count() == 13


def dense_explicit(data, start, iterations, ridge):
    rank = len(next(iter(start.values())))

    def solve(other, side):
        out = {}
        for key in {r[side] for r in data}:
            seen = [r for r in data if r[side] == key]
            design = np.array([other[r[1 - side]] for r in seen])
            out[key] = np.linalg.solve(design.T @ design + ridge * len(seen) * np.eye(rank),
                                       design.T @ np.array([r[2] for r in seen]))
        return out

    y = start
    for _ in range(iterations):
        x = solve(y, 0)
        y = solve(x, 1)
    return x, y


@pytest.mark.parametrize("rank, rows_per_split", [(1, 10**6), (3, 10**6), (9, 10**6), (9, 100)])
def test_explicit_mode_equals_its_equations(spark, monkeypatch, rank, rows_per_split):
    data = uneven(seed=4)
    start, items = started(spark, data, rank)
    lay_out = least_squares.lay_out
    monkeypatch.setattr(factorize, "lay_out", lambda r: lay_out(r, rows_per_split))
    model = factorize.als_factors(frame(spark, data), implicit=False, rank=rank, iterations=2, regularization=0.05,
                                  item_start=items)
    x, y = dense_explicit(data, start, 2, 0.05)
    close(vectors(model.users, "user_id"), x)
    close(vectors(model.items, "item_id"), y)


def test_a_run_longer_than_the_memory_bound_and_pairs_without_a_vector(spark):
    r = np.random.default_rng(1)
    n, size = 5_000, 8
    user = np.sort(np.where(r.random(n) < 0.7, 3, r.integers(0, 900, n))).astype(np.int32)
    item = r.integers(0, 400, n).astype(np.int32)
    rating, weight = r.normal(size=n), r.integers(1, 4, n).astype(float)
    design = r.normal(size=(390, size))
    pairs = pa.table({"block": np.zeros(n, np.int64), "user_id": user, "item_id": item, "n": weight, "total": rating,
                      "squares": rating**2, "shared": user == 5})
    sent = pa.table({"to": np.zeros(390, np.int64), "fixed": np.arange(390, dtype=np.int32), "design": design.tolist(),
                     "offset": np.full(390, 0.5)})
    out = least_squares._block_kernel("user_id", "item_id", "int", [0.3] * size, None, "ratings", cells=2_000)(pairs, sent)
    got = {row["user_id"]: row for row in out.to_pylist()}
    known = item < 390
    assert got.keys() == set(user[known].tolist())
    for u, row in got.items():
        m = known & (user == u)
        a, w = design[item[m]], weight[m]
        gram, rhs = a.T @ (a * w[:, None]), a.T @ (rating[m] - 0.5 * w)
        if u == 5:
            assert row["solution"] is None
            want = [*gram[np.triu_indices(size)], *rhs, (rating[m]**2 - rating[m] + w / 4).sum()]
            assert row["sums"] == pytest.approx(want)
        else:
            assert row["sums"] is None
            assert row["solution"] == pytest.approx(np.linalg.solve(gram + 0.3 * w.sum() * np.eye(size), rhs).tolist())


def numbers(n, size, seed=3):
    """A block's pairs, 40 a key and every fifth key shared, and its vectors in batches as they come from Spark."""
    r = np.random.default_rng(seed)
    pairs = pa.table({"block": np.zeros(n, np.int64), "user_id": (np.arange(n) // 40).astype(np.int32),
                      "item_id": r.integers(0, n // 2, n).astype(np.int32), "n": np.ones(n), "total": r.normal(size=n),
                      "squares": r.random(n), "shared": np.arange(n) // 40 % 5 == 0})
    ids, batches = r.permutation(n // 2).astype(np.int32), []
    for lo in range(0, n // 2, 1_000):
        part = ids[lo:lo + 1_000]
        design = pa.ListArray.from_arrays(np.arange(0, len(part) * size + 1, size, dtype=np.int32), r.normal(size=len(part) * size))
        batches.append(pa.record_batch({"to": pa.array(np.zeros(len(part), np.int64)), "fixed": pa.array(part), "design": design,
                                        "offset": pa.array(r.normal(size=len(part)))}))
    return pairs, pa.Table.from_batches(batches)


def test_a_block_solved_some_keys_at_a_time_gives_the_same_rows():
    pairs, sent = numbers(8_000, 7)
    whole, some = ({r["user_id"]: r for r in least_squares._block_kernel("user_id", "item_id", "int", [0.3] * 7, None, "once", **how)(
        mixed, vectors).to_pylist()} for mixed, vectors, how in (
            (pairs, sent.combine_chunks(), {}),
            (pairs.take(pa.array(np.random.default_rng(0).permutation(8_000))), sent, {"at_once": 100})))
    assert whole.keys() == some.keys() and len(whole) == 200
    for key, row in whole.items():
        assert (row["solution"] is None) == (some[key]["solution"] is None) == (key % 5 == 0)
        assert some[key]["sums" if key % 5 == 0 else "solution"] == pytest.approx(row["sums" if key % 5 == 0 else "solution"])
        assert some[key]["squared_error"] == pytest.approx(row["squared_error"])


def test_a_blocks_memory_beside_its_tables(spark):
    pairs, sent = numbers(1_000_000, 2)
    kernel = least_squares._block_kernel("user_id", "item_id", "int", [0.3] * 2, None, "once")
    tracemalloc.start()
    try:
        kernel(pairs, sent)
        assert tracemalloc.get_traced_memory()[1] < 80_000_000
    finally:
        tracemalloc.stop()


def test_blocks_of_less_wide_models_hold_more_pairs(spark):
    pairs = least_squares.lay_out(frame(spark, uneven()), 10)
    copies = [pairs.blocks["user_id", size][1].count() for size in (9, 24)]
    assert copies[0] < copies[1] <= pairs.blocks["user_id"][1].count()
    assert pairs.blocks["user_id", 9][0].count() == pairs.rows.count()


@pytest.mark.parametrize("widest", [6, 0])
def test_fold_in_equals_the_half_sweep_of_training(spark, widest):
    data = uneven(seed=9)
    start, items = started(spark, data, 3)
    new = [(900, 1, 5.0), (900, 2, 5.0), (901, 1, 5.0), (902, 77_777, 5.0)]  # an item without factors
    folded = vectors(factorize.fold_in(frame(spark, new), items, 0.1, 0.5, widest), "user_id")
    want, _ = dense_implicit(new[:-1], start, 1, 0.1, 0.5)
    base = sum(np.outer(y, y) for y in start.values())
    for user, seen in ((900, (1, 2)), (901, (1,))):
        a, b = base + 0.1 * len(seen) * np.eye(3), np.zeros(3)
        for i in seen:
            a, b = a + 2.5 * np.outer(start[i], start[i]), b + 3.5 * start[i]
        assert folded[user] == pytest.approx(np.linalg.solve(a, b).tolist())
    assert folded.keys() == want.keys() == {900, 901}
    explicit = vectors(factorize.fold_in(frame(spark, new), items, 0.1, None, widest), "user_id")
    assert explicit[901] == pytest.approx(
        (np.linalg.solve(np.outer(start[1], start[1]) + 0.1 * np.eye(3), 5 * start[1])).tolist())
    with pytest.raises(ValueError):
        factorize.fold_in(frame(spark, new), items.limit(0))


def test_folded_in_lists(spark):
    items = spark.createDataFrame([(i, [float(i == j % 3) + 0.01 * i for j in range(3)]) for i in range(6)],
                                  "item_id int, features array<double>")
    pending = spark.createDataFrame([(1, "0,1"), (2, "99")], "id int, item_ids string")
    got = folded_in_scores(pending, items, k=3).collect()
    assert {r.user_id for r in got} == {1} and len(got) == 3
    assert not {r.item_id for r in got} & {0, 1}


def test_training_goes_on_after_the_last_whole_sweep(spark, tmp_path, monkeypatch):
    data = frame(spark, uneven(seed=2))
    how = {"rank": 2, "iterations": 3}
    whole = factorize.implicit_factors(data, **how)
    folder = str(tmp_path / "run")
    solve, calls = factorize.solve_side, []

    def stopping(*args, **kw):
        calls.append(args[1])
        if len(calls) == 6:  # in the third sweep, after its users
            raise RuntimeError("lost")
        return solve(*args, **kw)

    monkeypatch.setattr(factorize, "solve_side", stopping)
    with pytest.raises(RuntimeError):
        factorize.implicit_factors(data, folder=folder, **how)
    calls.clear()
    again = factorize.implicit_factors(data, folder=folder, **how)
    assert calls == ["user_id", "item_id"]
    close(vectors(again.users, "user_id"), vectors(whole.users, "user_id"))
    close(vectors(again.items, "item_id"), vectors(whole.items, "item_id"))
    calls.clear()
    close(vectors(factorize.implicit_factors(data, folder=folder, **how).items, "item_id"), vectors(whole.items, "item_id"))
    assert not calls
    with pytest.raises(ValueError):
        factorize.implicit_factors(data, folder=folder, rank=3, iterations=3)
    with pytest.raises(ValueError):
        factorize.implicit_factors(data.limit(50), folder=folder, **how)


@pytest.mark.parametrize("rows_per_split", [10**6, 40])
def test_rounds_of_blocks_give_the_same_factors(spark, monkeypatch, rows_per_split):
    data = uneven(seed=6)
    start, items = started(spark, data, 9)
    lay_out, made = least_squares.lay_out, []
    monkeypatch.setattr(least_squares.Pairs, "_n_rounds", lambda self, size, n_blocks: (3, 4))
    monkeypatch.setattr(factorize, "lay_out", lambda r, alpha: made.append(lay_out(r, rows_per_split, alpha)) or made[-1])
    model = factorize.implicit_factors(frame(spark, data), 9, 2, 0.1, 0.5, item_start=items)
    for got, key, want in zip((model.users, model.items), ("user_id", "item_id"), dense_implicit(data, start, 2, 0.1, 0.5)):
        close(vectors(got, key), want)
    pairs = made[0]
    for key, other in (("user_id", "item_id"), ("item_id", "user_id")):
        assert len(pairs.rounds[key, 9]) == 3
        placed, routes = pairs.blocks[key, 9]
        columns = ["user_id", "item_id", "n", "total", "squares"]
        assert sorted(map(tuple, placed.select(columns).collect())) == sorted(map(tuple, pairs.rows.select(columns).collect()))
        assert sorted(map(tuple, routes.collect())) == sorted(map(tuple, placed.select(other, "block").distinct().collect()))


def test_rounds_send_a_share_of_the_pairs_size(spark):
    pairs = least_squares.lay_out(frame(spark, uneven()))
    slots = spark.sparkContext.defaultParallelism
    assert pairs._n_rounds(24, slots) == (1, slots)
    rounds, blocks = pairs._n_rounds(24, 100 * slots)
    assert blocks % slots == 0 and rounds * blocks >= 100 * slots
    sent = (least_squares.VECTOR_BYTES + 8 * 24) / rounds
    assert sent < 1.2 * least_squares.SENT_SHARE * least_squares.PAIR_BYTES


def shuffles(spark):
    """Numbers of the shuffles that have files."""
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {int(m[1]) for top in tops for _, _, names in os.walk(top) for n in names if (m := re.match(r"shuffle_(\d+)_", n))}


def test_training_leaves_no_shuffle_of_earlier_sweeps(spark):
    data = frame(spark, uneven(seed=8))
    before = max(shuffles(spark), default=-1)
    model = factorize.implicit_factors(data, 9, 6)
    for _ in range(50):  # they are removed in the background
        left = {n for n in shuffles(spark) if n > before}
        if len(left) <= 12:
            break
        time.sleep(0.2)
    assert len(left) <= 12 and model.items.count() > 0
