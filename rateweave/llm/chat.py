"""Chat formatting: the cheapest repair of a conversation's roles, then the rendered sequence.

A legal conversation is an optional system turn followed by user and assistant turns in alternation, ending with the
assistant. Every given turn keeps its role or gets another one (``relabel``); a turn whose role equals the one before is
joined to it (``merge``); empty turns may be put in where one is missing (``insert``). The automaton's states are the role
of the last turn; the cheapest path through it is found by dynamic programming, in (min, +) matrices.

Matrices make long conversations divisible: a block of at most ``BLOCK`` turns becomes a 4 x 4 matrix of costs between
states, matrices of a conversation are multiplied in groups, level by level, and the best states at the blocks' borders
are handed down again. So turns of one conversation are spread over tasks and no task holds more than a block's texts.
Blocks are cut by a turn's place in its conversation, so they are the same however the rows lie.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateweave.llm.bpe import arrow_type
from rateweave.llm.common import saved
from rateweave.llm.manifest import placed

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", *ROLES)
BLOCK = 512
#: Matrices that are multiplied in one group.
GROUP = 512
NEVER = 1 << 40


@dataclass(frozen=True)
class Costs:
    """What a repair costs; ``unknown`` is the price of giving a role to a turn that has none of the three."""

    merge: int = 1
    relabel: int = 4
    insert: int = 2
    unknown: int = 1


DEFAULT = Costs()
#: Empty turns between a state and the turn that follows, where that is legal without a merge.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (ASSISTANT, USER): (), (USER, USER): (ASSISTANT,), (ASSISTANT, ASSISTANT): (USER,),
}
#: Empty turns that end a conversation.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def step(before: int, after: int, role: int, costs: Costs) -> tuple[int, bool]:
    """The price of a turn of ``role`` (0: unknown) as ``after`` in state ``before``, and whether it is merged."""
    if after == START:
        return NEVER, False
    price = 0 if role == after else costs.unknown if role == 0 else costs.relabel
    merged = costs.merge if before == after else NEVER
    apart = costs.insert * len(BETWEEN[before, after]) if (before, after) in BETWEEN else NEVER
    return price + min(merged, apart), merged <= apart  # a tie is merged


def turn_matrix(role: int, costs: Costs) -> np.ndarray:
    return np.array([[step(a, b, role, costs)[0] for b in range(4)] for a in range(4)])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def closing_costs(costs: Costs) -> np.ndarray:
    return np.array([costs.insert * len(CLOSING[s]) for s in range(4)])


def best_path(matrices: list[np.ndarray], enter: int, ends: np.ndarray) -> list[int]:
    """States after each matrix on the cheapest path from ``enter``; ``ends`` is the price of the last state.

    Among equally cheap paths the one with the smallest last state wins, then the smallest state before it, and so on.
    """
    price = np.full(4, NEVER)
    price[enter] = 0
    prices = [price]
    for m in matrices:
        price = np.minimum((price[:, None] + m).min(axis=0), NEVER)
        prices.append(price)
    states = [int((price + ends).argmin())]
    for m, price in zip(matrices[::-1], prices[-2::-1]):
        states.append(int((price + m[:, states[-1]]).argmin()))
    return states[::-1][1:]


def repaired(turns: list[tuple[int, str]], enter: int, leave: int, closes: bool, costs: Costs = DEFAULT):
    """``(pieces, cost, counts)`` of a block between two states.

    ``pieces`` are ``(role, text, joined)``; a joined one continues the turn before. ``counts``: merges, relabels, inserts.
    """
    matrices = {r: turn_matrix(r, costs) for r in range(4)}
    ends = np.full(4, NEVER)
    ends[leave] = 0
    states = best_path([matrices[r] for r, _ in turns], enter, ends)
    pieces, merges, relabels, inserts, cost, before = [], 0, 0, 0, 0, enter
    for (role, text), after in zip(turns, states):
        price, merged = step(before, after, role, costs)
        cost += price
        relabels += role != after
        merges += merged
        empty = () if merged else BETWEEN[before, after]
        inserts += len(empty)
        pieces += [(r, "", False) for r in empty]
        pieces.append((after, text, merged))
        before = after
    if closes:
        inserts += len(CLOSING[before])
        cost += costs.insert * len(CLOSING[before])
        pieces += [(r, "", False) for r in CLOSING[before]]
    return pieces, cost, (merges, relabels, inserts)


def escaped(text: str) -> str:
    """``text`` without turn marks: every ``<|`` in it gets a backslash in between, one more if there are some already."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def rendered(pieces, opens: bool) -> str:
    """Chat markup: every turn between markers, joined texts on a new line, texts ``escaped``. A block may end inside a turn: a turn is
    closed by what follows it, so the blocks' texts make up the conversation's."""
    out = []
    for role, text, joined in pieces:
        text = escaped(text)
        out.append("\n" + text if joined else ("" if opens and not out else "<|end|>\n") + f"<|{NAMES[role]}|>\n{text}")
    return "".join(out)


def _matrix(flat) -> np.ndarray:
    return np.array(flat, np.int64).reshape(4, 4)


def _borders(blocks: DataFrame, costs: Costs, kind: str) -> DataFrame:
    """``(conv, idx, enter, leave, last)`` for ``blocks(conv, idx, matrix)``: states at the borders on the best path.

    ``idx`` grows along a conversation. Groups of consecutive numbers become one matrix each until a conversation has a
    single group, so a task meets at most ``GROUP`` matrices of a conversation at a time.
    """
    grouped = blocks.withColumn("up", F.floor(F.col("idx") / GROUP))
    lists = grouped.groupBy("conv", "up").agg(F.sort_array(F.collect_list(F.struct("idx", "matrix"))).alias("parts"))
    lists = saved(lists, "chat-groups")
    if lists.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        def multiply(batches):
            for batch in batches:
                out = []
                for parts in batch.column(2).to_pylist():
                    m = _matrix(parts[0]["matrix"])
                    for p in parts[1:]:
                        m = product(m, _matrix(p["matrix"]))
                    out.append(m.ravel().tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))],
                                                 names=["conv", "idx", "matrix"])

        above = _borders(lists.mapInArrow(multiply, f"conv {kind}, idx bigint, matrix array<bigint>"), costs, kind)
        above = above.withColumnRenamed("idx", "up")
        bounded = lists.join(above, [lists.conv.eqNullSafe(above.conv), lists.up == above.up]).select(
            lists.conv, "parts", "enter", "leave", "last")
    else:
        bounded = lists.select("conv", "parts", F.lit(START).alias("enter"), F.lit(-1).alias("leave"), F.lit(True).alias("last"))

    def descend(batches):
        closing = closing_costs(costs)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parts, enter = r["parts"], r["enter"]
                ends = closing if r["leave"] < 0 else np.where(np.arange(4) == r["leave"], 0, NEVER)
                states = best_path([_matrix(p["matrix"]) for p in parts], enter, ends)
                for n, (p, state) in enumerate(zip(parts, states)):
                    rows.append((r["conv"], p["idx"], enter, state, r["last"] and n == len(parts) - 1))
                    enter = state
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (arrow_type(kind), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["conv", "idx", "enter", "leave", "last"])

    return bounded.mapInArrow(descend, f"conv {kind}, idx bigint, enter int, leave int, last boolean")


def _role_number(name) -> int:
    name = (name or "").strip().lower()
    return NAMES.index(name) if name in ROLES else 0


def formatted(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              costs: Costs = DEFAULT, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """``(key, segment, n_turns, n_merged, n_relabelled, n_inserted, cost, text)``: conversations in repaired, rendered form.

    A conversation of at most ``block`` turns is one row. A longer one is cut after every ``block`` turns into rows whose
    texts follow each other by ``segment`` (from 0) and whose numbers add up, so a conversation of any length is returned
    whole and rows do not depend on how the table is partitioned. The sum of ``cost`` is the least possible.

    Turns are ordered by ``turn`` (nulls first), then role, then text, so ties are decided; repeated rows are turns of
    their own, which merge. A null text is an empty one; a role other than the three, or null, may become any. A text that
    holds turn marks is ``escaped``, which can be undone, so no text can open or close a turn. A very long text is one
    value of its turn. Rows without a conversation id form one conversation of their own. Ids are bigint, int or string. An
    empty table gives an empty table; other columns are ignored. Only conversations longer than a block are ordered over
    several tasks, and they are spread by conversation and turn, so one that holds a third of all rows is spread as well.
    """
    kind = turns.schema[key].dataType.simpleString()
    id_type = arrow_type(kind)
    rows = turns.select(F.col(key).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                        F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ["turn", "role", "h", "text"]
    rows = rows.withColumn("h", F.xxhash64("text"))
    sized = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns")).filter(F.col("n_turns") > block)
    long = saved(sized.select(F.col("conv").alias("long_conv")), "chat-long")
    parts = rows.withColumn("idx", F.lit(0).cast("bigint"))
    if not long.isEmpty():
        same = F.col("conv").eqNullSafe(F.col("long_conv"))
        of_long = rows.join(long, same, "left_semi").withColumns(
            {"tree": F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), "row": F.monotonically_increasing_id()})
        cut_long = placed(of_long, "tree", [*order, "row"]).withColumn("idx", F.expr(f"place div {block}"))
        parts = parts.join(long, same, "left_anti").unionByName(cut_long.select(*parts.columns))
    near = parts.repartition("conv", "idx") if partitions is None else parts.repartition(partitions, "conv", "idx")
    near = near.sortWithinPartitions("conv", "idx", *order)

    def cut(batches):
        matrices = {r: turn_matrix(r, costs) for r in range(4)}
        block_of, roles, texts = None, [], []

        def closed():
            m = matrices[roles[0]]
            for r in roles[1:]:
                m = product(m, matrices[r])
            kinds = (id_type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()))
            values = (*block_of, roles, texts, m.ravel().tolist())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                              names=["conv", "idx", "roles", "texts", "matrix"])

        for batch in batches:
            for c, i, name, value in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if block_of != (c, i):
                    if roles:
                        yield closed()
                    block_of, roles, texts = (c, i), [], []
                roles.append(_role_number(name))
                texts.append(value.as_py())
        if roles:
            yield closed()

    blocks = saved(near.select("conv", "idx", "role", "text").mapInArrow(
        cut, f"conv {kind}, idx bigint, roles array<int>, texts array<string>, matrix array<bigint>"), "chat-blocks")
    borders = _borders(blocks.select("conv", "idx", "matrix"), costs, kind).withColumnsRenamed({"conv": "conv_2", "idx": "idx_2"})

    def render(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                pieces, cost, counts = repaired(list(zip(r["roles"], r["texts"])), r["enter"], r["leave"], r["last"], costs)
                opens = r["enter"] == START
                out.append((r["conv"], r["idx"], len(r["roles"]), *counts, cost,
                            rendered(pieces, opens) + ("<|end|>\n" if r["last"] else "")))
            kinds = (id_type, *[pa.int64()] * 6, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else
                                             [pa.array([], k) for k in kinds],
                                             names=[key, "segment", "n_turns", "n_merged", "n_relabelled", "n_inserted", "cost", "text"])

    numbers = ", ".join(f"{c} bigint" for c in ("segment", "n_turns", "n_merged", "n_relabelled", "n_inserted", "cost"))
    met = blocks.drop("matrix").join(borders, [F.col("conv").eqNullSafe(F.col("conv_2")), F.col("idx") == F.col("idx_2")])
    return met.select("conv", "idx", "roles", "texts", "enter", "leave", "last").mapInArrow(
        render, f"`{key}` {kind}, {numbers}, text string")
