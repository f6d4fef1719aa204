"""Ridge solves of one side of a factorization, for all keys at once.

Ratings are first brought to one row per (user, item) pair, carrying how many ratings it stands for,
their sum and their sum of squares. That is all a least-squares step needs, and it makes repeated pairs
cheap. There are two layouts of the pairs, made when they are first asked for, and neither moves a pair in a step.

Narrow models sum their equations in plain columns. The pairs are kept arranged by the fixed key, in one row for each
key and split, a step joins the fixed side's vectors to these rows where they are, and partial sums travel to the solved
key's task. The larger a partition, the more pairs of a solved key meet in it before their sums travel.

Wide models would have large partial sums. Their pairs are kept in blocks of solved keys, one row for each key, and a
routing table says which blocks hold a fixed key, so that a step sends a vector once to each of these blocks and every block
sums and solves its own keys. Hot keys of the solved side are split over several blocks, whose sums are added up; a hot key
of the fixed side is one vector a block like any other. With many blocks nearly every pair has a vector sent, several times
its own size, so a step goes through the blocks in rounds and what one round sent is removed before the next one: the disk
holds a share of the pairs' size of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateweave.functions.vectors import vector_sum
from rateweave.operators.skew import ROWS_PER_SPLIT, hot_keys_by, repeat_per_split, with_split
from rateweave.session import cut_lineage, pin, release

# Up to this width the sums are plain aggregate columns; beyond it they are built and solved in blocks.
WIDEST_COLUMN_SUMS = 6
KEYS = ("user_id", "item_id")
# Up to so many blocks each one is named so that it has a partition of its own; more of them even out.
NAMED_BLOCKS = 4096
# Bytes of pairs and vectors that a block of a wide model holds, with what is held for a pair and beside a vector's numbers; the
# more pairs, the less often a vector is sent.
BLOCK_BYTES = 400_000_000
PAIR_BYTES, VECTOR_BYTES = 56, 44
# Pairs of a block that equations are built of at once.
PAIRS_AT_ONCE = 250_000
# What a round sends to its blocks, as a share of the size of all pairs.
SENT_SHARE = 0.5
# A partition of pairs arranged by a fixed key is read as a stream, so it holds more pairs than a block.
BLOCKS_PER_PARTITION = 4


class _Made(dict):
    """Values by key, made when they are first asked for."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self._make = make

    def __missing__(self, key: str):
        self[key] = made = self._make(key)
        return made


@dataclass(frozen=True)
class Pairs:
    """Rating pairs laid out once for all sweeps.

    ``by[key]`` is a copy arranged by a key, one row for each key (and split, if there are hot ones) with its ``pairs`` as
    an array of structs ``(other key, n, total, squares)``. ``rounds[key, size]`` has ``(pairs, routes)`` of every round of blocks of
    the solved ``key`` for vectors of ``size``: ``(block, key, shared)`` with arrays of what its pairs hold, and the other keys
    with arrays of the ``blocks`` they are sent to. ``blocks[key, size]`` are the same as ``(pairs, routes)`` with a row for every
    pair and for every block that a key of the other side is sent to; a block of ``blocks[key]`` has no more pairs than a split.
    """

    rows: DataFrame
    hot: dict[str, DataFrame | None]
    partitions: int
    n_pairs: int
    rows_per_split: int
    by: dict[str, DataFrame] = field(init=False)
    rounds: dict[str | tuple[str, int], list[tuple[DataFrame, DataFrame]]] = field(init=False)
    blocks: dict[str | tuple[str, int], tuple[DataFrame, DataFrame]] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "by", _Made(self._arranged))
        object.__setattr__(self, "rounds", _Made(self._in_rounds))
        object.__setattr__(self, "blocks", _Made(self._in_blocks))

    def keys(self, key: str) -> DataFrame:
        return self.rows.select(key).distinct()

    def _arranged(self, key: str) -> DataFrame:
        other, hot = KEYS[key == KEYS[0]], self.hot[key]
        place = [key] if hot is None else [key, f"{key}_split"]
        slots = self.rows.sparkSession.sparkContext.defaultParallelism
        partitions = max(min(slots, self.partitions), math.ceil(self.partitions / BLOCKS_PER_PARTITION))
        rows = self.rows if hot is None else _numbered(self.rows, key, other, hot)
        # the aggregate keeps the partitions; a split's pairs are some ``rows_per_split`` at most
        return pin(rows, place, partitions, then=lambda df: df.groupBy(*place).agg(
            F.collect_list(F.struct(other, "n", "total", "squares")).alias("pairs")))

    def _n_blocks(self, size: int) -> int:
        """As many as memory asks for and at least one a task; narrow vectors are small beside the pairs, so sending them costs little."""
        if size <= WIDEST_COLUMN_SUMS:
            return self.partitions
        share = BLOCK_BYTES / (ROWS_PER_SPLIT * (PAIR_BYTES + VECTOR_BYTES + 8 * size))
        slots = self.rows.sparkSession.sparkContext.defaultParallelism
        return max(slots, math.ceil(self.n_pairs / (self.rows_per_split * max(1.0, share))))

    def _n_rounds(self, size: int, n_blocks: int) -> tuple[int, int]:
        """The number of rounds and of blocks in each, which keep all tasks busy."""
        slots = self.rows.sparkSession.sparkContext.defaultParallelism
        wanted = math.ceil((VECTOR_BYTES + 8 * size) / (SENT_SHARE * PAIR_BYTES))
        if n_blocks < 2 * slots:
            return 1, n_blocks
        in_each = slots * math.ceil(n_blocks / (slots * wanted))
        return math.ceil(n_blocks / in_each), in_each

    def _in_rounds(self, at: str | tuple[str, int]) -> list[tuple[DataFrame, DataFrame]]:
        key, n_rounds, n_blocks = (at, 1, self.partitions) if isinstance(at, str) else (
            at[0], *self._n_rounds(at[1], self._n_blocks(at[1])))
        other, hot = KEYS[key == KEYS[0]], self.hot[key]
        rows = _numbered(self.rows, key, other, hot)
        shared = F.lit(False)
        if hot is not None:
            rows = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
            shared = F.coalesce("_hot", F.lit(False))
        number = F.pmod(F.xxhash64(key, f"{key}_split"), F.lit(n_rounds * n_blocks)).cast("int")
        in_round = F.pmod(number, F.lit(n_blocks))
        block = in_round if n_blocks > NAMED_BLOCKS else F.element_at(
            F.array(*map(F.lit, _names(self.rows.sparkSession, n_blocks))), in_round + 1)
        columns = other, "n", "total", "squares"
        found = []
        for i in range(n_rounds):
            of_round = rows if n_rounds == 1 else rows.filter(F.floor(number / n_blocks) == i)
            # the aggregate keeps the partitions; the lists of a row are in the same order
            packed = pin(of_round.select(block.cast("bigint").alias("block"), key, shared.alias("shared"), *columns),
                         ["block"], n_blocks, ["block", key], then=lambda df: df.groupBy("block", key, "shared").agg(
                             *[F.collect_list(c).alias(c) for c in columns]))
            routes = packed.select(F.explode(other).alias(other), F.col("block").cast("int").alias("block")).distinct()
            found.append((packed, pin(routes, [other], n_blocks, then=lambda df: df.groupBy(other).agg(
                F.collect_list("block").alias("blocks")))))
            release(self.rows.sparkSession)
        return found

    def _in_blocks(self, at: str | tuple[str, int]) -> tuple[DataFrame, DataFrame]:
        rounds = self.rounds[at]
        pairs, routes = [], []
        for i, (packed, sent_to) in enumerate(rounds):
            other, *values = packed.columns[3:]
            pair = F.inline(F.arrays_zip(other, *values))
            block = (F.col("block") * len(rounds) + i).alias("block")
            pairs.append(packed.select(block, packed.columns[1], "shared", pair).select(
                "block", packed.columns[1], other, *values, "shared"))
            routes.append(sent_to.select(other, F.explode(F.col("blocks").cast("array<bigint>")).alias("block")).select(other, block))
        return reduce(DataFrame.unionAll, pairs), reduce(DataFrame.unionAll, routes)

    def meet(self, key: str, side: DataFrame) -> DataFrame:
        """Join the pairs to ``side``, one row per ``key``; the pairs stay where they are."""
        hot = self.hot[key]
        if hot is None:
            met = self.by[key].join(side, key)
        else:
            split = f"{key}_split"
            met = self.by[key].join(repeat_per_split(side, key, hot, split), [key, split])
        return met.select(*side.columns, F.inline("pairs"))


def _numbered(rows: DataFrame, key: str, other: str, hot: DataFrame | None) -> DataFrame:
    split = f"{key}_split"
    return rows.withColumn(split, F.lit(0)) if hot is None else with_split(rows, key, hot, [other], split)


def _names(spark, n: int) -> list[int]:
    """For each of ``n`` partitions the least number that hash partitioning sends there."""
    found: dict[int, int] = {}
    tried = 0
    while len(found) < n:
        part = F.pmod(F.hash("id"), F.lit(n))
        for r in spark.range(tried, tried + 16 * n, 1, 1).select(part.alias("p"), "id").collect():
            found.setdefault(r.p, r.id)
        tried += 16 * n
    return [found[p] for p in range(n)]


def lay_out(ratings: DataFrame, rows_per_split: int = ROWS_PER_SPLIT, alpha: float | None = None) -> Pairs:
    """Reduce ratings to pairs and find their hot keys.

    A pair has ``n``, the weight of its outer product, ``total``, the weight of its vector on the right-hand
    side, and ``squares``, which is only summed. For explicit ratings these are count, sum and sum of squares.
    With ``alpha`` ratings are implicit feedback: confidence beyond one, confidence of a liked item, and the
    number of likes. A block holds some ``rows_per_split`` pairs, up to three times as many if that needs no more than ``BLOCK_BYTES``.
    """
    rating = F.col("rating").cast("double")
    if alpha is None:
        sums = F.count(F.lit(1)).cast("double"), F.sum(rating), F.sum(rating * rating)
    else:
        liked = F.when(rating > 0, 1.0).otherwise(0.0)
        sums = F.sum(alpha * F.abs(rating)), F.sum(liked * (1.0 + alpha * rating)), F.sum(liked)
    pairs = cut_lineage(
        ratings.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("rating").isNotNull())
               .groupBy(*KEYS)
               .agg(*[c.alias(name) for c, name in zip(sums, ("n", "total", "squares"))]))
    n_pairs = pairs.count()
    hot = hot_keys_by(pairs, list(KEYS), rows_per_split) if n_pairs > rows_per_split else dict.fromkeys(KEYS)
    slots = ratings.sparkSession.sparkContext.defaultParallelism
    return Pairs(pairs, hot, max(slots, math.ceil(n_pairs / rows_per_split)), n_pairs, rows_per_split)


def solve_side(pairs: Pairs, key: str, fixed: DataFrame, fixed_key: str, ridge: list[float],
               widest: int = WIDEST_COLUMN_SUMS, base: list[list[float]] | None = None,
               by_count: bool = False) -> DataFrame:
    """Solve ``key`` against ``fixed(fixed_key, design, offset)``: ``(key, solution, n, squared_error)``.

    ``solution`` minimises the sum over the key's ratings of ``(rating - offset - solution . design)²`` plus
    ``ridge . solution²``, with ``by_count`` plus that once for every rating of the key. ``squared_error`` is the sum
    without the ridge, taken from the same equations, so that watching convergence costs no further join.

    For implicit feedback ``base`` is the outer-product sum over all fixed vectors, which every key's equations
    start from; the ridge then counts once per liked item and ``squared_error`` means nothing.
    """
    size = len(ridge)
    times = "likes" if base is not None else "ratings" if by_count else "once"
    side = fixed.select(fixed_key, "design", "offset")
    if size > widest:
        return _solved_in_blocks(pairs, key, side, fixed_key, ridge, base, times)
    met = pairs.meet(fixed_key, side)
    met = met.select(key, "design", "n",
                     (F.col("total") - F.col("n") * F.col("offset")).alias("target"),
                     (F.col("squares") - 2.0 * F.col("offset") * F.col("total")
                      + F.col("n") * F.col("offset") * F.col("offset")).alias("power"))
    sums = _column_sums(met, key, size)
    if size == 1 and base is None:
        gram, target = F.col("sums")[0], F.col("sums")[1]
        scale = F.col("n") if by_count else F.lit(1.0)
        solved = sums.withColumn("x", target / (gram + scale * F.lit(float(ridge[0]))))
        error = F.col("sums")[2] - 2.0 * F.col("x") * target + F.col("x") * F.col("x") * gram
        return solved.select(key, F.array("x").alias("solution"), "n", error.alias("squared_error"))
    return _solved(sums, key, ridge, base, times)


def _solved(sums: DataFrame, key: str, ridge: list[float], base: list[list[float]] | None, times: str) -> DataFrame:
    return sums.mapInArrow(_solve_kernel(key, ridge, base, times),
                           f"{key} {_type(sums, key)}, solution array<double>, n double, squared_error double")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _solved_in_blocks(pairs: Pairs, key: str, side: DataFrame, fixed_key: str, ridge: list[float],
                      base: list[list[float]] | None, times: str) -> DataFrame:
    rounds, spark = pairs.rounds[key, len(ridge)], side.sparkSession
    if len(rounds) > 1:
        # all rounds read it, where their routes are
        side = pin(side, [fixed_key], rounds[0][1].rdd.getNumPartitions())
    shared, columns, found = pairs.hot[key] is not None, [key, "solution", "n", "squared_error"], []
    for placed, routes in rounds:
        sent = routes.join(side, fixed_key).select(F.explode(F.col("blocks").cast("array<bigint>")).alias("to"),
                                                   F.col(fixed_key).alias("fixed"), "design", "offset")
        out = placed.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(
            _packed_kernel(key, fixed_key, _type(placed, key), ridge, base, times),
            f"{key} {_type(placed, key)}, solution array<double>, n double, squared_error double, sums array<double>")
        out = out if shared else out.select(columns)
        if shared or len(rounds) > 1:
            out = cut_lineage(out)
        if len(rounds) > 1:
            del sent
            release(spark)
        found.append(out)
    out = reduce(DataFrame.unionAll, found)
    if not shared:
        return out
    # a hot key's blocks have sums only, which are added up; the others are done
    added = out.filter("sums is not null").groupBy(key).agg(F.sum("n").alias("n"), vector_sum("sums").alias("sums"))
    return out.filter("sums is null").select(columns).unionAll(_solved(added, key, ridge, base, times))


def gram_matrix(vectors: DataFrame, size: int) -> list[list[float]]:
    """The sum of the outer products of ``vectors(features)``: one matrix a task, added up before it reaches the driver."""
    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((size, size))
        for batch in batches:
            part = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            total += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["outer"])

    partial = vectors.select(F.col("features").cast("array<double>").alias("features")).mapInArrow(kernel, "outer array<double>")
    flat = partial.agg(vector_sum("outer")).first()[0]
    return [list(flat[i * size:(i + 1) * size]) for i in range(size)]


def _triangle(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def _column_sums(met: DataFrame, key: str, size: int) -> DataFrame:
    y, n, target = F.col("design"), F.col("n"), F.col("target")
    sums = [F.sum(n * y[i] * y[j]) for i, j in _triangle(size)]
    sums += [F.sum(target * y[i]) for i in range(size)]
    sums.append(F.sum("power"))
    aggregated = met.groupBy(key).agg(F.sum("n").alias("n"), *[s.alias(f"_{i}") for i, s in enumerate(sums)])
    return aggregated.select(key, "n", F.array(*[F.col(f"_{i}") for i in range(len(sums))]).alias("sums"))


# The kernels are nested functions so that they are shipped by value: workers need numpy and pyarrow only.


def _block_kernel(key: str, fixed_key: str, key_type: str, ridge: list[float], base: list[list[float]] | None, times: str,
                  cells: int = 2_000_000, at_once: int = PAIRS_AT_ONCE):
    """Solutions of a block's keys from its pairs and the vectors sent to it; sums only for keys that other blocks share."""
    size = len(ridge)
    ridges = _ridge_rule(ridge, base, times)

    def kernel(pairs, sent):
        import numpy as np
        import pyarrow as pa

        left, right = np.triu_indices(size)
        width = len(left) + size + 1

        def numbers(table, column):
            return table.column(column).to_numpy()

        def result(keys, x, n, error, sums, shared):
            def lists(rows, values, null):
                ends = np.cumsum(np.where(null, 0, values.shape[1]))
                return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values[rows].ravel()),
                                                mask=pa.array(null))

            solution = lists(~shared, x, shared)
            packed = np.empty((len(keys), 0)) if sums is None else sums
            return pa.Table.from_arrays(
                [pa.array(keys), solution, pa.array(n), pa.array(error),
                 pa.nulls(len(keys), pa.list_(pa.float64())) if sums is None else lists(shared, packed, ~shared)],
                names=[key, "solution", "n", "squared_error", "sums"])

        nothing = result(np.empty(0, {"int": np.int32, "bigint": np.int64}.get(key_type, np.int64)), np.empty((0, size)),
                         np.empty(0), np.empty(0), None, np.empty(0, bool))
        if not pairs.num_rows or not sent.num_rows:
            return nothing
        ids = numbers(sent, "fixed")
        order = np.argsort(ids).astype(np.int32)
        ids, offsets = ids[order], numbers(sent, "offset")
        # vectors stay in the batches that they came in
        held = [c.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) for c in sent.column("design").chunks if len(c)]
        begins = np.cumsum([0, *map(len, held)])

        def vectors(rows):
            if len(held) == 1:
                return held[0][rows]
            found, batch = np.empty((len(rows), size)), np.searchsorted(begins, rows, side="right") - 1
            by_batch = np.argsort(batch.astype(np.int16 if len(held) < 2 ** 15 else np.int32), kind="stable")
            ends = np.searchsorted(batch[by_batch], np.arange(len(held) + 1))
            for i, part in enumerate(held):
                mine = by_batch[ends[i]:ends[i + 1]]
                found[mine] = part[rows[mine] - begins[i]]
            return found

        def solved(pairs):
            """The result for some keys' pairs, sorted by key."""
            at = np.minimum(np.searchsorted(ids, numbers(pairs, fixed_key)), len(ids) - 1)
            use = ids[at] == numbers(pairs, fixed_key)  # a pair without a vector counts nowhere
            if not use.any():
                return nothing
            row = order[at[use]]
            keys, n, shared = (numbers(pairs, c)[use] for c in (key, "n", "shared"))
            total, squares, offset = numbers(pairs, "total")[use], numbers(pairs, "squares")[use], offsets[row]
            target = total - n * offset
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            lengths = np.diff(np.r_[starts, len(keys)])
            counts = np.add.reduceat(n, starts)
            powers = np.add.reduceat(squares - 2.0 * offset * total + n * offset * offset, starts)
            shared = shared[starts]
            x, error = np.zeros((len(starts), size)), np.zeros(len(starts))
            sums = np.zeros((len(starts), width)) if shared.any() else None

            def equations(runs, length):
                """Gram matrices and right-hand sides of runs of about one length, padded to ``length``."""
                inside = np.arange(length) < lengths[runs, None]
                place = starts[runs, None] + np.where(inside, np.arange(length), 0)
                part = vectors(row[place].ravel()).reshape(len(runs), length, size)
                gram = np.matmul(part.transpose(0, 2, 1), part * np.where(inside, n[place], 0.0)[:, :, None])
                return gram, np.matmul(np.where(inside, target[place], 0.0)[:, None, :], part)[:, 0]

            def long_equations(run):
                gram, rhs, piece = np.zeros((1, size, size)), np.zeros((1, size)), max(1, cells // size)
                for lo in range(starts[run], starts[run] + lengths[run], piece):
                    hi = min(lo + piece, starts[run] + lengths[run])
                    part = vectors(row[lo:hi])
                    gram[0] += part.T @ (part * n[lo:hi, None])
                    rhs[0] += target[lo:hi] @ part
                return gram, rhs

            by_length, at = np.argsort(lengths, kind="stable"), 0
            while at < len(by_length):
                end = min(len(by_length), at + max(1, cells // (size * max(size, int(lengths[by_length[at]])))))
                while end > at + 1 and (end - at) * int(lengths[by_length[end - 1]]) * size > 2 * cells:
                    end = at + (end - at + 1) // 2
                runs, length = by_length[at:end], int(lengths[by_length[end - 1]])
                gram, rhs = long_equations(runs[0]) if len(runs) == 1 and length * size > cells else equations(runs, length)
                system = gram + ridges(counts[runs], powers[runs])
                x[runs] = np.linalg.solve(system, rhs[:, :, None])[:, :, 0]
                error[runs] = (powers[runs] - 2.0 * (x[runs] * rhs).sum(axis=1)
                               + np.einsum("ki,kij,kj->k", x[runs], gram, x[runs]))
                if sums is not None:
                    sums[runs] = np.column_stack([gram[:, left, right], rhs, powers[runs]])
                at = end
            return result(keys[starts], x, counts, error, sums, shared)

        keys = numbers(pairs, key)
        if (keys[1:] < keys[:-1]).any():
            pairs = pairs.take(pa.array(np.argsort(keys, kind="stable")))
            keys = numbers(pairs, key)
        # some whole keys at a time, so that what is made of their pairs stays small
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
        done, lo = [], 0
        while lo < len(keys):
            i = np.searchsorted(ends, lo + at_once, side="right")
            hi = int(ends[i - 1]) if i and ends[i - 1] > lo else int(ends[i])
            done.append(solved(pairs.slice(lo, hi - lo)))
            lo = hi
        return pa.concat_tables(done)

    return kernel


def _packed_kernel(key: str, fixed_key: str, *how):
    """``_block_kernel`` for pairs in one row for each key."""
    solve = _block_kernel(key, fixed_key, *how)

    def kernel(packed, sent):
        import numpy as np
        import pyarrow as pa

        columns = {name: [] for name in (key, "shared", fixed_key, "n", "total", "squares")}
        for batch in packed.to_batches():
            lengths = np.diff(batch.column("n").offsets.to_numpy())
            for name, parts in columns.items():
                part = batch.column(name)
                parts.append(pa.array(np.repeat(part.to_numpy(zero_copy_only=False), lengths)) if name in (key, "shared")
                             else part.flatten())
        types = {name: packed.schema.field(name).type for name in columns}
        flat = pa.table({name: pa.chunked_array(parts, types[name] if name in (key, "shared") else types[name].value_type)
                         for name, parts in columns.items()})
        return solve(flat, sent)

    return kernel


def _ridge_rule(ridge: list[float], base: list[list[float]] | None, times: str):
    def added(n, power):
        """What is added to the Gram matrices of keys with ``n`` ratings and, for implicit feedback, ``power`` likes."""
        import numpy as np

        scale = {"once": np.ones(len(n)), "ratings": n, "likes": power}[times]
        diagonal = scale[:, None, None] * np.diag(ridge)
        return diagonal if base is None else diagonal + np.array(base)

    return added


def _solve_kernel(key: str, ridge: list[float], base: list[list[float]] | None, times: str, chunk: int = 1024):
    size = len(ridge)
    ridges = _ridge_rule(ridge, base, times)

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        left, right = np.triu_indices(size)
        width = len(left) + size + 1
        for batch in batches:
            count = batch.num_rows
            packed = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(count, width)
            x, error = np.empty((count, size)), np.empty(count)
            for at in range(0, count, chunk):
                part = packed[at:at + chunk]
                gram = np.zeros((len(part), size, size))
                gram[:, left, right] = part[:, :len(left)]
                gram[:, right, left] = part[:, :len(left)]
                target = part[:, len(left):-1]
                counts = batch.column("n").to_numpy(zero_copy_only=False)[at:at + chunk]
                system = gram + ridges(counts, part[:, -1])
                solved = np.linalg.solve(system, target[:, :, None])[:, :, 0]
                x[at:at + chunk] = solved
                error[at:at + chunk] = (part[:, -1] - 2.0 * (solved * target).sum(axis=1)
                                        + np.einsum("ki,kij,kj->k", solved, gram, solved))
            offsets = pa.array(np.arange(0, count * size + 1, size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), batch.column("n"),
                 pa.array(error)],
                names=[key, "solution", "n", "squared_error"])

    return kernel
