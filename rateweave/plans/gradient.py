"""The biased factor model by stratified stochastic gradient.

Users and items lie in ``blocks`` blocks by hashes of their ids, so ratings lie in a grid of cells. Cells of one diagonal
(a stratum) share no block, so they are trained at once, a task each; the diagonals of an epoch follow one another. A
task holds the vectors of its two blocks and streams the cell's ratings past them in Arrow batches, so its memory does
not grow with the ratings. Velocities of the momentum travel with the vectors. Ratings are put in order by many tasks, in
pieces, before the few that train get them, and batches that share no key with those between them are trained at once,
which gives the same numbers as one after the other.

A key that holds more than a cell's share of the ratings would make its cell the longest by far and its updates one
sequence. Its ratings are spread over all blocks instead: every cell trains a copy of it, and after each stratum the
copies are averaged, weighted by their numbers of ratings.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateweave.functions.vectors import hash_vector
from rateweave.operators.skew import hot_keys_by
from rateweave.plans.factorize import SEED, FactorModel
from rateweave.session import checkpoint_dir, cut_lineage, release

# The reference model's settings; epochs, step and decay of both phases.
FACTORS = 50
BATCH = 512
MOMENTUM = 0.9
RIDGE = 1e-4
PHASES = ((15, 1e-1, 2e-4), (10, 1e-4, 2e-6))

SIDES = {"user_id": 0, "item_id": 1}
_PIECES = "cell int, place bigint, number bigint, users array<bigint>, items array<bigint>, ratings array<double>"
_ROWS = "side int, id bigint, block int, state array<double>, n bigint"
# Ratings that a task puts in order, and slices of them; ratings whose batches are looked at together, and that are trained
# at once.
ORDERED, SLICES, AT_ONCE, TOGETHER = 1_000_000, 8, 1 << 18, 1 << 14


@dataclass(frozen=True)
class Grid:
    """Ratings in cells: ``rows(stratum, cell, user, item, rating)`` and the keys that every cell has a copy of."""

    rows: DataFrame
    keys: DataFrame
    blocks: int
    n_ratings: int
    copied: bool


def _block(key: str, blocks: int, seed: int = SEED):
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("bigint")), F.lit(blocks)).cast("int")


def lay_out_grid(ratings: DataFrame, blocks: int, folder: str | None = None) -> Grid:
    """Write the ratings by stratum and cell; ratings without a user, an item or a value are left out.

    ``keys`` is ``(side, id, block)``, with a null block for a key with more ratings than a cell has on average; fewer
    than ``2 * blocks * blocks`` keys can have that many.
    """
    spark = ratings.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/grid-{uuid.uuid4().hex}"
    whole = ratings.select("user_id", "item_id", F.col("rating").cast("double").alias("rating")).dropna()
    n_ratings = whole.count()
    hot = hot_keys_by(whole, list(SIDES), max(1, -(-n_ratings // (blocks * blocks))))
    rows, keys = whole, []
    for key, side in SIDES.items():
        other = next(k for k in SIDES if k != key)
        block = _block(key, blocks)
        if hot[key] is not None:
            rows = rows.join(F.broadcast(hot[key].select(key, F.lit(True).alias(f"_{key}"))), key, "left")
            spread = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col(other).cast("bigint")), F.lit(blocks)).cast("int")
            rows = rows.withColumn(f"_b{side}", F.when(F.col(f"_{key}"), spread).otherwise(block)).drop(f"_{key}")
            ids = whole.select(key).distinct().join(F.broadcast(hot[key]), key, "left")
            block = F.when(F.col("n_splits").isNull(), block)
        else:
            rows = rows.withColumn(f"_b{side}", block)
            ids = whole.select(key).distinct()
        keys.append(ids.select(F.lit(side).alias("side"), F.col(key).cast("bigint").alias("id"), block.alias("block")))
    cells = rows.select(F.pmod(F.col("_b1") - F.col("_b0"), F.lit(blocks)).alias("stratum"), F.col("_b0").alias("cell"),
                        F.col("user_id").cast("bigint").alias("user"), F.col("item_id").cast("bigint").alias("item"), "rating")
    # strata are folders, so an epoch reads every rating once
    cells.repartition("stratum", "cell").write.mode("overwrite").partitionBy("stratum").parquet(folder)
    written = spark.read.schema("cell int, user bigint, item bigint, rating double, stratum int").parquet(folder)
    return Grid(written, cut_lineage(keys[0].unionAll(keys[1])), blocks, n_ratings, any(h is not None for h in hot.values()))


def start_states(grid: Grid, n_factors: int, seed: int = SEED) -> DataFrame:
    """``(side, id, block, state)``: small hashed numbers, then the bias 0, then velocities 0; block -1 for keys of every cell."""
    small = F.transform(hash_vector("id", n_factors, 0.1, seed), lambda x: x - 0.05) if n_factors else \
        F.array().cast("array<double>")
    still = F.array_repeat(F.lit(0.0), n_factors + 2)
    other = F.transform(hash_vector("id", n_factors, 0.1, seed + 1), lambda x: x - 0.05) if n_factors else small
    return grid.keys.select("side", "id", F.coalesce("block", F.lit(-1)).alias("block"), F.concat(F.when(F.col("side") == 0, small).otherwise(other), still).alias("state"))


def stochastic_factors(ratings: DataFrame, blocks: int, n_factors: int = FACTORS,
                       phases: Iterable[tuple[int, float, float]] = PHASES, batch: int = BATCH, momentum: float = MOMENTUM,
                       ridge: float = RIDGE, seed: int = SEED, folder: str | None = None) -> FactorModel:
    """Fit ``rating = p_u . q_i + b_u + b_i``; ``users`` and ``items`` as from ``biased_factorization``, no errors.

    A phase is ``(epochs, step, decay)``. A batch of ratings moves a key by ``step / (1 + decay * batches so far)`` times
    its gradient of the batch's squared error over ``batch``, plus ``momentum`` times its last move; keys outside the batch
    rest. The ridge counts once for every rating and spares biases. ``blocks * blocks`` cells should hold some batches
    each; two blocks' vectors have to fit into a task. Order within a cell comes from hashes, so the number of tasks and
    retries change nothing.
    """
    if blocks < 1:
        raise ValueError("at least one block is needed")
    grid = lay_out_grid(ratings, blocks, folder)
    states, turn = cut_lineage(start_states(grid, n_factors, seed)), 0
    per_stratum = grid.n_ratings / (batch * blocks)
    for epochs, step, decay in phases:
        for epoch in range(epochs):
            for stratum in range(blocks):
                rate = step / (1 + decay * per_stratum * (epoch * blocks + stratum))
                states = train_stratum(grid, states, stratum, turn, rate, batch, momentum, ridge, seed)
                release(ratings.sparkSession)
            turn += 1

    def side(key):
        return states.filter(F.col("side") == SIDES[key]).select(
            F.col("id").cast(ratings.schema[key].dataType).alias(key), F.slice("state", 1, n_factors).alias("features"),
            F.col("state")[n_factors].alias("bias"))

    return FactorModel(side("user_id"), side("item_id"), None)


def train_stratum(grid: Grid, states: DataFrame, stratum: int, epoch: int, rate: float, batch: int = BATCH,
                  momentum: float = MOMENTUM, ridge: float = RIDGE, seed: int = SEED) -> DataFrame:
    """The states after the cells of one stratum were trained; order within cells changes with ``epoch``."""
    blocks = grid.blocks
    # the cell is its user block; items come to the cell that has their block in this stratum
    own = F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - F.lit(stratum), F.lit(blocks)))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    # empty arrays, not nulls: Spark's Arrow writer goes over all nulls in a row of them again for each one
    no_ids, no_numbers = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    first = F.lit(-2 ** 63)
    rows = states.select(
        F.explode(F.when(F.col("block") < 0, every).otherwise(F.array(own.cast("int")))).alias("cell"),
        F.col("side").alias("phase"), first.alias("place"), F.lit(0).cast("bigint").alias("number"), "id", "block", "state",
        no_ids.alias("users"), no_ids.alias("items"), no_numbers.alias("ratings"))
    pieces = _pieces(grid, stratum, F.xxhash64(F.lit(seed + epoch), "user", "item", "rating"))
    rows = rows.unionAll(pieces.select("cell", F.lit(2), "place", "number", F.lit(0).cast("bigint"), F.lit(0), no_numbers,
                                       "users", "items", "ratings"))
    # a partition is a cell: states in any order, then its pieces in theirs
    ordered = rows.withColumn("rated", F.col("phase") == 2).repartitionById(blocks, "cell")
    cells = ordered.sortWithinPartitions("place", "rated", "number").drop("rated")
    trained = cut_lineage(cells.mapInArrow(_cell_kernel(rate / batch, batch, momentum, ridge), _ROWS))
    if not grid.copied:
        return trained.drop("n")
    # a copy a cell at most, so a key's group has ``blocks`` rows; in a fixed order, so sums agree
    copies = F.sort_array(F.collect_list(F.struct(F.greatest("n", F.lit(0)).cast("double").alias("n"), "state")))
    grouped = trained.groupBy("side", "id", "block").agg(F.sum("n").alias("total"), copies.alias("copies"))
    first = F.col("copies")[0]["state"]
    mean = F.aggregate("copies", F.transform(first, lambda x: F.lit(0.0)),
                       lambda total, c: F.zip_with(total, c["state"], lambda t, x: t + x * c["n"] / F.col("total")))
    return cut_lineage(grouped.select("side", "id", "block", F.when((F.size("copies") == 1) | (F.col("total") == 0), first)
                                      .otherwise(mean).alias("state")))


def _pieces(grid: Grid, stratum: int, place) -> DataFrame:
    """The ratings of a stratum in pieces of a cell, ordered by ``place`` and then their values; see ``_PIECES``."""
    slots = grid.rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(2 * slots, grid.blocks, math.ceil(grid.n_ratings / grid.blocks / ORDERED))
    # a slice is a range of places; slices go to tasks by number, some to each
    bits = math.ceil(math.log2(SLICES * tasks / grid.blocks))
    task = F.pmod(F.col("slice") * grid.blocks + F.col("cell"), F.lit(tasks)).cast("int")
    rated = grid.rows.filter(F.col("stratum") == stratum).select("cell", place.alias("place"), "user", "item", "rating")
    sliced = rated.withColumn("slice", F.shiftright("place", 64 - bits)).repartitionById(tasks, task)
    # equal places are rare, so the sort hardly looks at more than their numbers
    return sliced.sortWithinPartitions("place", "user", "item", "rating").mapInArrow(_piece_kernel(), _PIECES)


def _piece_kernel():
    # Nested so that it is shipped by value, as the next one.
    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        number = 0
        for rows in batches:
            cells, slices = (rows.column(c).to_numpy() for c in ("cell", "slice"))
            cuts = np.flatnonzero(np.diff(slices)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                for cell in np.unique(cells[lo:hi]):
                    piece = rows.slice(lo, hi - lo)
                    if cells[lo] != cell or (cells[lo:hi] != cell).any():
                        piece = piece.filter(pa.array(cells[lo:hi] == cell))
                    number += 1
                    lists = [pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), pa.concat_arrays([piece.column(c)]))
                             for c in ("user", "item", "rating")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell], pa.int32()), piece.column("place").slice(0, 1), pa.array([number], pa.int64()), *lists],
                        names=["cell", "place", "number", "users", "items", "ratings"])

    return kernel


def _cell_kernel(rate: float, batch: int, momentum: float, ridge: float, at_once: int = AT_ONCE, together: int = TOGETHER):
    # Nested so that it is shipped by value; it needs numpy and pyarrow on the workers, nothing else.
    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        at = {"ids": ([], []), "blocks": ([], []), "states": ([], []), "ready": False, "waiting": [], "n_waiting": 0, "turn": 0}

        def freeze():
            if at["ready"]:
                return
            none = {"ids": np.empty(0, np.int64), "blocks": np.empty(0, np.int32), "states": np.empty((0, 2))}
            for name, empty in none.items():
                at[name] = [np.concatenate(x) if x else empty for x in at[name]]
            for side in (0, 1):
                order = np.argsort(at["ids"][side])
                for name in none:
                    at[name][side] = at[name][side][order]
            at["n"] = [np.zeros(len(x), np.int64) for x in at["ids"]]
            at["turns"] = [np.zeros(len(x), np.int64) for x in at["ids"]]
            at["ready"] = True

        def step(side, rows, gradient):
            keys, place = np.unique(rows, return_inverse=True)
            state, width = at["states"][side], gradient.shape[1]
            # added up in the order of the rows; a batch costs by its own rows, however many keys the block has
            if len(keys) == len(rows):
                total = np.empty_like(gradient)
                total[place] = gradient
            else:
                total = np.bincount((place[:, None] * width + np.arange(width)).ravel(), weights=gradient.ravel(),
                                    minlength=len(keys) * width).reshape(-1, width)
            moved = momentum * state[keys, width:] - rate * total
            state[keys, width:] = moved
            state[keys, :width] += moved
            at["n"][side][keys] += np.bincount(place, minlength=len(keys))

        def learn(u, i, ratings):
            width = at["states"][0].shape[1] // 2
            p, q = at["states"][0][u, :width], at["states"][1][i, :width]
            error = ratings - (p[:, :-1] * q[:, :-1]).sum(axis=1) - p[:, -1] - q[:, -1]
            for side, rows, mine, theirs in ((0, u, p, q), (1, i, q, p)):
                gradient = -2 * error[:, None] * theirs + 2 * ridge * mine
                gradient[:, -1] = -2 * error
                step(side, rows, gradient)

        def in_turns(u, i):
            """Lists of batches in the order of training: a batch comes after all earlier ones that share a key with it."""
            last, turns = at["turns"], np.empty(-(-len(u) // batch), np.int64)
            for b in range(len(turns)):
                users, items = u[b * batch:(b + 1) * batch], i[b * batch:(b + 1) * batch]
                turns[b] = turn = max(at["turn"], last[0][users].max(), last[1][items].max()) + 1
                last[0][users] = last[1][items] = turn
            at["turn"] = int(turns.max())
            order = np.argsort(turns, kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(turns[order])) + 1):
                for lo in range(0, len(same), max(1, together // batch)):
                    yield same[lo:lo + max(1, together // batch)]

        def drain(last):
            """Train whole batches of the ratings that wait, and the rest at the end of the cell."""
            if not at["waiting"]:
                return
            users, items, ratings = (np.concatenate(x) for x in zip(*at["waiting"]))
            whole = len(users) if last else len(users) - len(users) % batch
            at["waiting"] = [(users[whole:], items[whole:], ratings[whole:])] if whole < len(users) else []
            at["n_waiting"] = len(users) - whole
            if not whole:
                return
            u, i = (np.searchsorted(ids, x[:whole]) for ids, x in zip(at["ids"], (users, items)))
            for some in in_turns(u, i):
                rows = slice(some[0] * batch, min((some[0] + 1) * batch, whole))
                if len(some) > 1:
                    rows = (some[:, None] * batch + np.arange(batch)).ravel()
                    rows = rows[rows < whole]
                learn(u[rows], i[rows], ratings[rows])

        cell = None
        for rows in batches:
            cells, phases = (rows.column(c).to_numpy() for c in ("cell", "phase"))
            if not len(cells):
                continue
            cell = cells[0] if cell is None else cell
            if (cells != cell).any():
                raise ValueError("a partition holds one cell")
            for side in (0, 1):
                part = rows.filter(pa.array(phases == side))
                if part.num_rows:
                    at["ids"][side].append(part.column("id").to_numpy())
                    at["blocks"][side].append(part.column("block").to_numpy())
                    at["states"][side].append(part.column("state").flatten().to_numpy().reshape(part.num_rows, -1))
            for k in np.flatnonzero(phases == 2).tolist():
                freeze()
                piece = rows.slice(k, 1)
                at["waiting"].append(tuple(piece.column(c).flatten().to_numpy() for c in ("users", "items", "ratings")))
                at["n_waiting"] += len(at["waiting"][-1][0])
                if at["n_waiting"] >= at_once:
                    drain(False)
        if cell is None:
            return
        freeze()
        drain(True)
        for side in (0, 1):
            ids, blocks, state = at["ids"][side], at["blocks"][side], at["states"][side]
            for lo in range(0, len(ids), 10_000):
                part = state[lo:lo + 10_000]
                starts = np.arange(len(part) + 1, dtype=np.int32) * state.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), side, np.int32)), pa.array(ids[lo:lo + 10_000]), pa.array(blocks[lo:lo + 10_000]),
                     pa.ListArray.from_arrays(pa.array(starts), pa.array(part.ravel())), pa.array(at["n"][side][lo:lo + 10_000])],
                    names=["side", "id", "block", "state", "n"])

    return kernel
