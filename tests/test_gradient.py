"""The biased factor model by stratified stochastic gradient."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from rateweave.plans import factorize, gradient


def frame(spark, triples):
    return spark.createDataFrame(triples, "user_id int, item_id int, rating float")


@pytest.fixture(scope="module")
def triples():
    """Item 0 has a third of the ratings; some pairs are rated twice."""
    rng = np.random.default_rng(1)
    out = [(int(u), 0 if rng.random() < 0.33 else int(rng.integers(1, 15)), float(rng.integers(1, 6))) for u in rng.integers(0, 40, 400)]
    return out + out[:7]


def plain(cells, states, copied, blocks, epochs, step, decay, batch, momentum, ridge):
    """The same training in plain Python: ``cells[epoch][stratum][cell]`` are ratings in their order."""
    n = sum(len(c) for s in cells[0] for c in s)
    for epoch in range(epochs):
        for stratum in range(blocks):
            rate = step / (1 + decay * n / (batch * blocks) * (epoch * blocks + stratum)) / batch
            after, copies = dict(states), {}
            for ratings in cells[epoch][stratum]:
                own, seen = {k: list(v) for k, v in states.items()}, {}
                for lo in range(0, len(ratings), batch):
                    grads = {}
                    for u, i, r in ratings[lo:lo + batch]:
                        p, q = own[0, u], own[1, i]
                        f = len(p) // 2 - 1
                        e = r - sum(p[d] * q[d] for d in range(f)) - p[f] - q[f]
                        for key, mine, theirs in (((0, u), p, q), ((1, i), q, p)):
                            g = grads.setdefault(key, [0.0] * (f + 1))
                            seen[key] = seen.get(key, 0) + 1
                            for d in range(f):
                                g[d] += -2 * e * theirs[d] + 2 * ridge * mine[d]
                            g[f] += -2 * e
                    for key, g in grads.items():
                        for d, x in enumerate(g):
                            own[key][len(g) + d] = momentum * own[key][len(g) + d] - rate * x
                            own[key][d] += own[key][len(g) + d]
                for key, m in seen.items():
                    if key in copied:
                        copies.setdefault(key, []).append((m, own[key]))
                    else:
                        after[key] = own[key]
            for key, found in copies.items():
                total = sum(m for m, _ in found)
                after[key] = [sum(m * s[d] for m, s in found) / total for d in range(len(states[key]))]
            states = after
    return states


@pytest.mark.parametrize("blocks", [1, 3])
def test_equals_a_plain_loop(spark, triples, blocks):
    ratings = frame(spark, triples)
    grid = gradient.lay_out_grid(ratings, blocks)
    copied = {(r.side, r.id) for r in grid.keys.filter("block is null").collect()}
    assert ((1, 0) in copied) == (blocks > 1)
    start = {(r.side, r.id): r.state for r in gradient.start_states(grid, 2).collect()}
    cells = []
    for epoch in range(2):
        order = F.xxhash64(F.lit(gradient.SEED + epoch), "user", "item", "rating").alias("place")
        found = sorted((r.stratum, r.cell, r.place, r.user, r.item, r.rating) for r in grid.rows.select("*", order).collect())
        cells.append([[[f[3:] for f in found if f[:2] == (s, c)] for c in range(blocks)] for s in range(blocks)])
    assert sorted((int(u), int(i), r) for s in cells[0] for c in s for u, i, r in c) == sorted(triples)
    want = plain(cells, start, copied, blocks, 2, 0.5, 0.01, 16, 0.9, 0.01)
    model = gradient.stochastic_factors(ratings, blocks, 2, [(2, 0.5, 0.01)], 16, 0.9, 0.01)
    for side, df in ((0, model.users), (1, model.items)):
        got = {r[0]: [*r.features, r.bias] for r in df.collect()}
        assert set(got) == {k for s, k in want if s == side}
        for key, values in got.items():
            assert values == pytest.approx(want[side, key][:3], abs=1e-9)


def test_the_number_of_tasks_changes_nothing(spark, triples):
    got = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts + 1))
        try:
            model = gradient.stochastic_factors(frame(spark, triples).repartition(parts), 2, 2, [(1, 0.5, 0.0)], 16)
            got.append((rows(model.users), rows(model.items)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_factors_predict_better_than_biases_alone(spark):
    rng = np.random.default_rng(5)
    taste, kind = rng.choice([-1.0, 1.0], 60), rng.choice([-1.0, 1.0], 40)
    picked = [(u, i) for u in range(60) for i in range(40) if rng.random() < 0.6]
    ratings = frame(spark, [(u, i, float(3 + 1.5 * taste[u] * kind[i] + 0.1 * rng.normal())) for u, i in picked])
    marked = factorize.holdout(ratings)
    train, validation = marked.filter("is_train").select("user_id", "item_id", "rating"), marked.filter("not is_train")
    model = gradient.stochastic_factors(train, 2, 2, [(12, 0.1, 0.0)], 32)
    biases = factorize.biased_factorization(train, 0, sweeps=3, bias_ridge=0.1)
    error, bound = (factorize.squared_error(factorize.predict_biased(validation, m)).first().mse for m in (model, biases))
    assert error < 0.5 * bound


def test_odd_rows(spark):
    ratings = frame(spark, [(1, 1, 4.0), (1, 1, 4.0), (None, 1, 3.0), (2, None, 3.0), (3, 2, None)])
    model = gradient.stochastic_factors(ratings, 2, 1, [(1, 0.5, 0.0)], 4)
    assert rows(model.users, "user_id") == [(1,)] and rows(model.items, "item_id") == [(1,)]
    empty = gradient.stochastic_factors(ratings.limit(0), 2, 1, [(1, 0.5, 0.0)], 4)
    assert empty.users.count() == 0 and empty.items.count() == 0
    with pytest.raises(ValueError):
        gradient.stochastic_factors(ratings, 0)


def test_rows_reach_the_cells_without_null_arrays(spark, triples, monkeypatch):
    """Spark's Arrow writer takes time with the square of a run of null arrays."""
    kernel_of = gradient._cell_kernel

    def watched(*how):
        kernel = kernel_of(*how)

        def checked(batches):
            def each():
                for batch in batches:
                    assert batch.column("state").null_count == 0
                    yield batch

            yield from kernel(each())

        return checked

    monkeypatch.setattr(gradient, "_cell_kernel", watched)
    model = gradient.stochastic_factors(frame(spark, triples), 2, 3, [(1, 0.1, 0.0)], 16)
    assert model.users.count() == len({u for u, _, _ in triples})
    assert all(x == x for r in model.users.collect() for x in (*r.features, r.bias))


def test_pieces_hold_a_stratums_ratings_in_order(spark, triples):
    grid = gradient.lay_out_grid(frame(spark, triples * 3), 2)
    place = F.xxhash64(F.lit(gradient.SEED), "user", "item", "rating")
    pieces = gradient._pieces(grid, 1, place).collect()
    assert len({(p.cell, p.place) for p in pieces}) > 20
    got = [(p.cell, *rating) for p in sorted(pieces, key=lambda p: (p.cell, p.place, p.number))
           for rating in zip(p.users, p.items, p.ratings)]
    rated = grid.rows.filter("stratum = 1").select("cell", place.alias("place"), "user", "item", "rating").collect()
    assert got == [(r.cell, r.user, r.item, r.rating) for r in sorted(rated)]


@pytest.mark.parametrize("n_keys", [6, 5_000])
def test_batches_trained_at_once_give_the_same_numbers(n_keys):
    rng = np.random.default_rng(3)
    n, width = 3_003, 3
    users, items, ratings = rng.integers(0, n_keys, n), rng.integers(0, n_keys, n), rng.integers(1, 6, n).astype(float)

    def lists(values, kind):
        return pa.array(values, pa.list_(kind))

    def rows(phase, ids, states, rated):
        m = len(ids)
        return pa.record_batch({"cell": pa.array(np.zeros(m, np.int32)), "phase": pa.array(np.full(m, phase, np.int32)),
                                "id": pa.array(ids), "block": pa.array(np.zeros(m, np.int32)), "state": lists(states, pa.float64()),
                                **{c: lists(v, t) for c, v, t in zip(("users", "items", "ratings"), rated,
                                                                      (pa.int64(), pa.int64(), pa.float64()))}})

    batches = [rows(side, (ids := rng.permutation(n_keys)), (0.1 * rng.normal(size=(n_keys, 2 * width))).tolist(), [[[]] * n_keys] * 3)
               for side in (0, 1)]
    batches += [rows(2, np.zeros(1, np.int64), [[]], [[x[lo:lo + 77].tolist()] for x in (users, items, ratings)])
                for lo in range(0, n, 77)]
    found = [pa.Table.from_batches(list(gradient._cell_kernel(0.001, 8, 0.9, 0.01, *how)(batches)))
             for how in ((1, 1), (1_000, 8), (1 << 18, 1 << 14))]
    assert found[0].num_rows == 2 * n_keys and sum(found[0].column("n").to_pylist()) == 2 * n
    assert found[0] == found[1] == found[2]
