"""A Merkle manifest of a dataset, built and read back by time-forward processing.

Every row is a leaf. Leaves of one group (``source``) form a tree, and the groups' subroots form the tree above them. A
node's label is ``(tree, level, place)``; a child's label comes before its parent's. Nodes are processed in the order of
their labels and send what they compute to a queue of messages that is ordered by the receiver's label: a digest goes to
the parent, and a node is processed when all messages with its label are taken from the queue. The queue is external, a
distributed table: one step takes all messages of the least level, brings those of one label together in a shuffle on the
label, and writes the messages to the next level. A second sweep in reversed order sends each node's proof suffix, the
siblings on its way to the root, to its children and so to the leaves.

A node has at most ``FAN`` children, so nothing gathers more than that under one label, however large a group is, and
levels shrink by that factor: all steps above the leaves together handle a fifteenth of the leaves' rows. Places come from
a range partitioning with one offset row per partition and group, so a hot group is spread like any other rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rateweave.llm.common import saved

FAN = 16
#: The columns that a leaf is made of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0) within their ``tree`` and ``n``, how many rows the tree has.

    ``order`` is unique within a tree. No tree is gathered: rows are partitioned by ranges of (tree, order) and written
    once; a partition's share of a tree is one row, whose offset is a running sum over the partitions that hold the tree.
    """
    ranged = saved(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
                       .withColumn("_at", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_at", 33)
    shares = ranged.groupBy(part.alias("_part"), tree).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shares.select("_part", tree, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"),
                            F.sum("_n").over(Window.partitionBy(tree)).alias("n"))
    return (ranged.withColumn("_part", part).join(offsets, ["_part", tree])
                  .withColumn("place", F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset"))


@dataclass(frozen=True)
class Forest:
    """Trees over the rows of one table.

    ``levels[k]`` holds the nodes of level ``k + 1``, ``(tree, place, n, children, digest)`` with ``n`` nodes of the tree
    on that level and the children in order; ``single`` holds rows that are a whole tree, ``(tree, node)``. ``roots`` is
    ``(tree, digest)``. A child of level 1 is the struct ``node`` of the given row, one of a higher level ``(digest)``.
    """

    levels: list[DataFrame]
    single: DataFrame
    roots: DataFrame


def sweep(rows: DataFrame, fan: int = FAN) -> Forest:
    """Trees over ``rows(tree, place, n, node)``, ``node`` being a struct with a field ``digest``, from leaves to roots."""
    if fan < 2:
        raise ValueError("a node needs at least two children")
    most = rows.agg(F.max("n")).first()[0] or 0
    single = rows.filter("n = 1").select("tree", "node")
    roots = single.select("tree", F.col("node.digest").alias("digest"))
    messages, levels = rows.filter("n > 1").select("tree", "place", "n", "node"), []
    while most > 1:
        most = -(-most // fan)
        label = ["tree", F.ceil(F.col("n") / fan).cast("bigint").alias("n"), F.expr(f"place div {fan}").alias("place")]
        taken = messages.groupBy(*label).agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("sent"))
        nodes = taken.select("tree", "place", "n", F.col("sent.node").alias("children")).withColumn(
            "digest", digest(F.array_join("children.digest", "")))
        nodes = saved(nodes, "nodes")
        levels.append(nodes)
        roots = roots.unionAll(nodes.filter("n = 1").select("tree", "digest"))
        messages = nodes.filter("n > 1").select("tree", "place", "n", F.struct("digest").alias("node"))
    return Forest(levels, single, roots)


def unsweep(forest: Forest, suffixes: DataFrame, fan: int = FAN) -> DataFrame:
    """``(tree, place, node, *more, path)`` for every row of the forest, from roots to leaves.

    ``suffixes`` is ``(tree, path, *more)``: what is above each tree's root. ``path`` has a pair per level, from the leaf
    upwards: the digests before and after the node in its run, each in one text.
    """
    more = [c for c in suffixes.columns if c not in ("tree", "path")]
    at_root = suffixes.select("tree", "path", *more)
    messages = None
    for nodes in reversed(forest.levels):
        nodes = nodes.select("tree", "place", "n", "children")
        met = nodes.filter("n = 1").join(at_root, "tree").select("tree", "place", "children", "path", *more)
        if messages is not None:
            met = met.unionAll(nodes.filter("n > 1").join(messages.drop("node"), ["tree", "place"])
                                    .select("tree", "place", "children", "path", *more))
        each = met.select("tree", "place", "path", *more, F.col("children.digest").alias("run"),
                          F.posexplode("children").alias("pos", "node"))
        beside = F.struct(F.array_join(F.slice("run", F.lit(1), F.col("pos")), "").alias("left"),
                          F.array_join(F.slice("run", F.col("pos") + 2, F.lit(fan)), "").alias("right"))
        messages = each.select("tree", (F.col("place") * fan + F.col("pos")).alias("place"), "node", *more,
                               F.concat(F.array(beside), F.col("path")).alias("path"))
    alone = forest.single.join(at_root, "tree").select("tree", F.lit(0).cast("bigint").alias("place"), "node", *more, "path")
    return alone if messages is None else messages.unionAll(alone)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda below, step: digest(F.concat(step["left"], below, step["right"])))


def manifest(leaves: DataFrame, key: str = "doc_id", group: str = "source", leaf: str = "leaf", again: str | None = None,
             fan: int = FAN) -> DataFrame:
    """``(key, leaf, subroot, root, path, again)`` for every row of ``leaves``, whose digests are in column ``leaf``.

    Leaves of a group ascend by ``key``, groups ascend by name, null first in both; rows equal in group and key go by
    digest, and equal rows are leaves of their own, whose order makes no difference. ``again`` names a column of digests
    to hold against the root, by default ``leaf``. An empty table gives an empty table. Other columns are ignored,
    whatever they are called; texts are not needed here, so their length does not matter.
    """
    name = F.col(group).cast("string")
    given = saved(leaves.select(F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("tree"), F.col(key).alias("id"),
                                F.col(leaf).alias("digest"), F.col(again or leaf).alias("again")), "leaves")
    # equal rows are told apart by their place in the written table, so that they can be spread too
    given = given.withColumn("row", F.monotonically_increasing_id())
    rows = placed(given, "tree", ["id", "digest", "row"])
    below = sweep(rows.select("tree", "place", "n", F.struct("digest", "id", "again").alias("node")), fan)
    tops = below.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "digest")
    above = sweep(placed(tops, "tree", ["name"]).select("tree", "place", "n", F.struct("digest", "name").alias("node")), fan)
    top = above.roots.first()
    root = F.lit(top.digest if top else None).cast("string")
    start = above.roots.select("tree", F.array().cast(_PATH).alias("path"))
    suffixes = unsweep(above, start, fan).select(F.col("node.name").alias("tree"), "path", F.col("node.digest").alias("subroot"))
    found = unsweep(below, suffixes, fan)
    return found.select(F.col("node.id").alias(key), F.col("node.digest").alias("leaf"), "subroot", root.alias("root"), "path",
                        F.col("node.again").alias("again"))


def audited(docs: DataFrame, changed: Column, key: str = "doc_id", group: str = "source", text: str = "text",
            fields: tuple[str, ...] = FIELDS, fan: int = FAN) -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, folded_root, verified)``: does a row still lead to the root of ``docs``?

    The manifest is made of ``docs`` as it is; then every row is read with ``changed`` in place of its ``text`` and folded
    with its proof. Nulls in any column are fields of their own (``-``). A text of any length is read once, in one row;
    repeated rows each have a proof; an empty table gives an empty table; other columns are ignored.
    """
    values = [F.col(c) for c in fields]
    other = [changed if c == text else F.col(c) for c in fields]
    before, after = leaf_of(*values), leaf_of(*other)
    leaves = docs.select(F.col(key).alias("id"), F.col(group).alias("name"), before.alias("digest"), after.alias("again"))
    found = manifest(leaves, "id", "name", "digest", "again", fan)
    return found.select(F.col("id").alias(key), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                        folded(F.col("again"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
