"""Merkle manifest of a table: one tree for each value of a column, and a tree over their roots.

A row becomes a leaf, the hash of its fields. Inside a tree the leaves ascend by id; every `FANOUT`
consecutive nodes become one, until one is left. The roots, ordered by the tree's value (null first, then
bytewise), form the top tree in the same way.

Slot pivot: the nodes of a level are grouped by parent, and one conditional aggregate for each slot spreads
the children into `FANOUT` columns. All slot columns, concatenated, hash to the parent; the columns before
and after a child's own slot are its siblings. Levels are stored on the way up. On the way down each group
meets the path of its parent and hands every child its own step and that path, so a path is written once
for each parent, not once for each leaf. Everything is DataFrame functions.

Rows are numbered without a window over a tree: they are sorted by ranges of (tree, id, leaf) and stored with
their place in the task; counts by tree and task, one row for each, give the first number of each run. A tree
that holds most rows is thus spread over all tasks. The driver sees the largest tree's size, one number for
each level and the root.

Defined cases: a null field is `-`. Null trees are a tree of their own, the first one. Null ids come first in
their tree; rows that repeat an id follow each other by leaf; equal rows are leaves of their own. A lone leaf is
its tree's root, a lone tree's root is the root, and the proof of a lone row is the hash of nothing. Empty and very
long texts are hashed whole, inside the scan; no text is shuffled. An empty table gives an empty result. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarflow.session import write_and_reload

FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """`-` for null, otherwise the length of the value's text in bytes, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*texts: Column) -> Column:
    """Binary SHA-256 of concatenated texts."""
    return F.unhex(F.sha2(F.concat(*texts).cast("binary"), 256))


def digest_of(nodes: Column) -> Column:
    """Binary SHA-256 of digests that are concatenated as lower-case hexadecimal text."""
    return F.unhex(F.sha2(written(nodes).cast("binary"), 256))


def written(nodes: Column) -> Column:
    return F.lower(F.hex(nodes))


def leaf(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def numbered(frame: DataFrame, within: str, *order: str) -> DataFrame:
    """frame with `at`, the place from 0 of each row among those with its value of `within`, and `n`, their number.

    `within` must not be null.
    """
    # the identifier holds the task in the upper bits and the place in the task in the lower 33
    ranged = frame.repartitionByRange(within, *order).sortWithinPartitions(within, *order)
    stored = write_and_reload(ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("task", F.shiftright("place", 33)), "numbered")
    runs = stored.groupBy(within, "task").agg(F.min("place").alias("first"), F.count("*").alias("run"))
    tree = Window.partitionBy(within)  # a row for each task that holds part of the tree
    before = F.coalesce(F.sum("run").over(tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = runs.select(within, "task", (before - F.col("first")).alias("shift"), F.sum("run").over(tree).alias("n"))
    return stored.join(starts, [within, "task"]).select(*frame.columns, (F.col("place") + F.col("shift")).alias("at"), "n")


def _slots() -> list[str]:
    return [f"slot{i}" for i in range(FANOUT)]


def _pivoted(nodes: DataFrame) -> DataFrame:
    """One row for each parent: tree, up (its place), n (nodes of the tree at the children's level) and the children by slot."""
    child = F.struct(*[c for c in nodes.columns if c not in ("tree", "at", "n")])
    spread = [F.max(F.when(F.col("at") % FANOUT == i, child)).alias(s) for i, s in enumerate(_slots())]
    return nodes.withColumn("up", F.floor(F.col("at") / FANOUT)).groupBy("tree", "up", "n").agg(*spread)


def _joined_slots(names: list[str]) -> Column:
    return F.concat(*[F.coalesce(F.col(s)["node"], F.lit(b"")) for s in names]) if names else F.lit(b"")


def _parents(groups: DataFrame) -> DataFrame:
    above = F.ceil(F.col("n") / FANOUT).alias("n")
    return groups.select("tree", F.col("up").alias("at"), above, digest_of(_joined_slots(_slots())).alias("node"))


class Forest:
    """Levels of all trees, from the leaves up, and the roots (tree, node)."""

    def __init__(self, leaves: DataFrame) -> None:
        """leaves: tree, at, n, node and columns that stay with the leaf."""
        self.leaves, self.levels = leaves, []
        largest = leaves.agg(F.max("n")).first()[0] or 0
        nodes = leaves
        while largest > 1:
            groups = write_and_reload(_pivoted(nodes.filter("n > 1")), "merkle-level")
            self.levels.append(groups)
            nodes = _parents(groups)
            largest = -(-largest // FANOUT)

    def roots(self) -> DataFrame:
        found = self.leaves.filter("n = 1").select("tree", "node")
        for groups in self.levels:
            found = found.unionByName(_parents(groups.filter(F.col("n") <= FANOUT)).select("tree", "node"))
        return found

    def paths(self, start: DataFrame) -> DataFrame:
        """The leaves' columns with those of start and path: the steps from the leaf up, each with the nodes left and right.

        start: tree, path (the steps above the tree's root) and columns that go to all leaves of the tree.
        """
        above = None
        for groups in reversed(self.levels):
            top = groups.filter(F.col("n") <= FANOUT).join(start, "tree")
            if above is not None:
                inner = groups.filter(F.col("n") > FANOUT).join(above.withColumnRenamed("at", "up"), ["tree", "up"])
                top = top.unionByName(inner)
            above = _children(top, [c for c in start.columns if c not in ("tree", "path")])
            if groups is not self.levels[0]:  # what meets the next level is one row for each of its groups
                above = above.drop("node")
        lone = self.leaves.filter("n = 1").drop("n").join(start, "tree")
        return lone if above is None else above.unionByName(lone)


def _children(groups: DataFrame, carry: list[str]) -> DataFrame:
    names = _slots()
    each = [
        F.when(F.col(s).isNotNull(), F.struct(F.lit(i).alias("slot"), F.col(s).alias("child"), F.struct(
            _joined_slots(names[:i]).alias("left"), _joined_slots(names[i + 1 :]).alias("right")).alias("step")))
        for i, s in enumerate(names)
    ]
    rows = groups.withColumn("each", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())))
    at = (F.col("up") * FANOUT + F.col("each.slot")).alias("at")
    return rows.select("tree", at, "each.child.*", F.concat(F.array("each.step"), "path").alias("path"), *carry)


def proof(path: Column) -> Column:
    """Hash of all siblings from the leaf up, left to right."""
    return digest_of(F.aggregate(path, F.lit(b""), lambda all_, step: F.concat(all_, step["left"], step["right"])))


def folded(path: Column, node: Column) -> Column:
    """Root that the node gives with the siblings on its path."""
    return F.aggregate(path, node, lambda below, step: digest_of(F.concat(step["left"], below, step["right"])))


def manifest(rows: DataFrame, id_col: str, tree_col: str, fields: list[str], replaced: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row for each row of rows: id, leaf, subroot, root, proof (hash of the siblings), folded (root recomputed), verified.

    fields are hashed in their order. For rows that `where` selects, the root is recomputed from a leaf in which
    `replaced` stands for the fields that it names, and `verified` says whether the change went unnoticed.
    """
    other = {**{c: F.col(c) for c in fields}, **(replaced or {})}
    changed = F.when(F.coalesce(where, F.lit(False)), leaf([other[c] for c in fields])) if where is not None else F.lit(None).cast("binary")
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("")).alias("tree"),
        F.col(id_col).alias("id"), leaf([F.col(c) for c in fields]).alias("node"), changed.alias("changed"),
    )
    # texts are read and hashed once; ranges are sampled from the small table
    trees = Forest(numbered(write_and_reload(leaves, "merkle-leaves"), "tree", "id", "node"))
    roots = write_and_reload(trees.roots(), "merkle-roots")
    forest = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    top = Forest(numbered(forest, "tree", "name"))
    root = top.roots().first()
    if root is None:
        root = [None, None]
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    above = rows.sparkSession.range(1).select(F.lit("").alias("tree"), none.alias("path"))
    start = write_and_reload(
        top.paths(above).select(F.col("name").alias("tree"), F.col("node").alias("subroot"), "path"), "merkle-top")
    whole = F.lit(bytes(root[1]) if root[1] is not None else None).cast("binary")
    found = trees.paths(start).withColumn("folded", folded(F.col("path"), F.coalesce("changed", "node")))
    return found.select(
        "id", F.col("node").alias("leaf"), "subroot", whole.alias("root"), proof(F.col("path")).alias("proof"), "folded",
        (F.col("folded") == whole).alias("verified"),
    )
