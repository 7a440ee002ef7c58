"""A Merkle manifest of a table: a binary hash tree over the rows of each group, one tree over the groups' roots, and inclusion proofs.

A leaf is H (lowercase hex SHA-256) of a row's fields. Leaves of a group ascend by doc_id; while a level has several nodes, each two
consecutive ones become the H of their concatenation, a last one alone the H of itself. The last node is the group's subroot; the
subroots in order of the group, null first, give the root the same way.

Checkpoint and recompute: only every STEP-th level is written (the leaves, level STEP, level 2 STEP, ...). A node of a written level
and its aligned subtree of 2^STEP nodes one written level below are one group of rows, so no task ever holds more than that, however
large a group of the table is. Proofs go down again: each subtree's inner nodes are regenerated from the written level below it, the
siblings of its members are put before the path of its top node, and the inner nodes are discarded. Where only written levels and
inputs are kept, a lost executor costs the subtrees it was at work on.

Leaves get their places by range partitions of (group, doc_id, leaf), counts of each partition and running sums over those counts.

Defined cases: null fields are `-`; a null doc_id comes first; of equal doc_ids the smaller leaf comes first; equal rows are leaves of their
own, whose places can be swapped without any effect on the tree; a null group is a group, the first; long texts are hashed whole; other
columns are no part of a leaf; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Levels between two written ones: subtrees have 2^STEP members.
STEP = 8
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64


def leaf_hash(fields: list[Column]) -> Column:
    """H of the fields, each `-` if null, else its UTF-8 byte count, `:` and the value."""
    told = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in told)), 256)


def in_order(rows: DataFrame, key: str, by: list[str], parts: int) -> DataFrame:
    """rows (staged) with place, 0, 1, ... along `by` within each value of key (null: one of them), and size, the key's number of rows."""
    # the row number comes last, so that equal rows, however many, can be dealt to several tasks
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    line = [F.col(key).asc_nulls_first(), *(F.col(x).asc_nulls_first() for x in by), F.col("_row")]
    spread = spread.repartitionByRange(parts, *line).sortWithinPartitions(*line).drop("_row")
    dealt = c.stage(spread.withColumn("_nth", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("_nth", 33)
    counts = dealt.groupBy(key, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_nth").alias("_first"))
    along = Window.partitionBy(key).orderBy("_part")
    before = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(
        F.col(key).alias("_key"), F.col("_part"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(key)).alias("size"),
    )
    counts = c.stage(counts, "counts")  # a row for each key and partition that holds it
    joined = dealt.withColumn("_part", part)
    joined = joined.join(F.broadcast(counts) if c.small(counts) else counts, [joined[key].eqNullSafe(counts["_key"]), joined["_part"] == counts["_part"]])
    return joined.select(*rows.columns, (F.col("_nth") + F.col("_shift")).alias("place"), "size")


def _h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _levels(nodes: list[str], level: int, size: int, up: int) -> list[list[str]]:
    """Levels of an aligned subtree whose lowest nodes lie at `level` of a tree over `size` leaves: `up` levels more, or fewer where the tree ends."""
    levels = [nodes]
    for at in range(level, level + up):
        if -(-size >> at) <= 1:  # that level has one node
            break
        below = levels[-1]
        levels.append([_h("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def _siblings(levels: list[list[str]], i: int) -> str:
    """The siblings of the i-th lowest node, from below, as far as they exist."""
    out = []
    for nodes in levels[:-1]:
        if i ^ 1 < len(nodes):
            out.append(nodes[i ^ 1])
        i >>= 1
    return "".join(out)


def fold(node: str, place: int, size: int, path: str) -> tuple[str, str]:
    """The node that a leaf at this place leads to with these siblings, and the siblings left over."""
    used = 0
    while size > 1:
        if place ^ 1 < size:
            other = path[used : used + HEX]
            used += HEX
            node = _h(other + node if place & 1 else node + other)
        else:
            node = _h(node)
        place, size = place >> 1, (size + 1) >> 1
    return node, path[used:]


def _sorted(table: pa.Table, *names: str) -> list[list]:
    table = table.sort_by("place")
    return [table.column(n).to_pylist() for n in names]


class Tree:
    """Written levels of one tree for each key: rows of (key, place, node, size), from the leaves to the tops."""

    def __init__(self, leaves: DataFrame, key: str, step: int = STEP) -> None:
        """leaves: a staged table with key, place, node, size and any other columns."""
        self.key, self.step = key, step
        self.kind = dict(leaves.dtypes)[key]
        most = leaves.agg(F.max("size")).first()[0] or 0
        self.levels = [leaves]
        while most > 1:
            level = step * (len(self.levels) - 1)
            self.levels.append(c.stage(self._up(self.levels[-1], level), "level"))
            most = -(-most >> step)

    def _block(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", F.shiftright("place", self.step))

    def _up(self, rows: DataFrame, level: int) -> DataFrame:
        step, key = self.step, self.key

        def top(table: pa.Table) -> pa.Table:
            (nodes,) = _sorted(table, "node")
            size = table.column("size")[0].as_py()
            node = _levels(nodes, level, size, step)[-1][0]
            return pa.table({key: table.column(key)[:1], "place": table.column("block")[:1], "node": [node], "size": pa.array([size], pa.int64())})

        members = self._block(rows.select(key, "place", "node", "size"))
        return members.groupBy(key, "block").applyInArrow(top, f"{key} {self.kind}, place long, node string, size long")

    def tops(self) -> DataFrame:
        """key, node: the top of each tree."""
        return self.levels[-1].select(self.key, "node")

    def proofs(self, tops: DataFrame, carry: list[str], emit: Callable[..., dict[str, list]], schema: str, adds: dict[str, str]) -> DataFrame:
        """What `emit` makes of the leaves' columns `carry`, their places, size and paths, and what tops tells of their tree.

        tops: key, path (siblings of the top itself, above this tree) and the columns of `adds` (name to type), a row a key."""
        above = self.levels[-1].select(self.key, "place").alias("a").join(
            tops.alias("t"), F.col(f"a.{self.key}").eqNullSafe(F.col(f"t.{self.key}")),
        ).select(f"a.{self.key}", "a.place", "t.path", *(f"t.{n}" for n in adds))
        for n in range(len(self.levels) - 2, 0, -1):
            above = c.stage(self._down(n, above, [], adds, None, ""), "paths")
        return self._down(0, above, carry, adds, emit, schema)

    def _down(self, n: int, above: DataFrame, carry: list[str], adds: dict[str, str], emit: Callable[..., dict[str, list]] | None, schema: str) -> DataFrame:
        """key, place, path and adds of the n-th written level's nodes (or what emit makes of them), from those of the level above."""
        key, step, level, told = self.key, self.step, n * self.step, list(adds)

        def down(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by("place")
            nodes, size = left.column("node").to_pylist(), left.column("size")[0].as_py()
            levels, path = _levels(nodes, level, size, step), right.column("path")[0].as_py()
            paths = [_siblings(levels, i) + path for i in range(len(nodes))]
            whole = {x: right.column(x)[0].as_py() for x in told}
            if emit:
                return pa.table(emit({x: left.column(x).to_pylist() for x in carry}, nodes, left.column("place").to_pylist(), size, paths, whole))
            columns = {key: left.column(key), "place": left.column("place"), "path": paths}
            return pa.table(columns | {x: pa.array([whole[x]] * len(nodes)) for x in told})

        shape = schema or f"{key} {self.kind}, place long, path string, " + ", ".join(f"{x} {t}" for x, t in adds.items())
        members = self._block(self.levels[n].select(key, "place", "node", "size", *(x for x in carry if x != key)))
        upper = above.withColumnRenamed("place", "block")
        return members.groupBy(key, "block").cogroup(upper.groupBy(key, "block")).applyInArrow(down, shape)


def manifest(docs: DataFrame, forged: Column | None = None, step: int = STEP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row; trees by lang.

    forged: n_chars as it is found when a proof is checked (by default what 7 dividing crc32(doc_id) makes of it: one more)."""
    spark = docs.sparkSession
    c.ship(spark)
    if forged is None:
        forged = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(1)).otherwise(F.lit(0))
    own = [F.col(x) for x in FIELDS]
    seen = [forged if x == "n_chars" else F.col(x) for x in FIELDS]
    changed = ~forged.eqNullSafe(F.col("n_chars"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    leaves = c.stage(rows.select("lang", "doc_id", leaf_hash(own).alias("node"), F.when(changed, leaf_hash(seen)).alias("found")), "leaves")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tree = Tree(c.stage(in_order(leaves, "lang", ["doc_id", "node"], parts), "places"), "lang", step)
    subroots = c.stage(tree.tops().select(F.lit(0).alias("whole"), "lang", "node"), "subroots")
    upper = Tree(c.stage(in_order(subroots, "whole", ["lang"], parts), "places"), "whole", step)
    roots = upper.tops().select("whole", F.lit("").alias("path"), F.col("node").alias("root"))

    def groups(kept: dict, nodes: list, places: list, size: int, paths: list, whole: dict) -> dict[str, list]:
        return {
            "lang": pa.array(kept["lang"], pa.string()), "path": paths, "subroot": nodes, "root": pa.array([whole["root"]] * len(nodes)),
            "spot": pa.array(places, pa.int64()), "groups": pa.array([size] * len(nodes), pa.int64()),
        }

    adds = {"subroot": "string", "root": "string", "spot": "long", "groups": "long"}
    if len(upper.levels) == 1:  # one group or none
        tops = upper.levels[0].select(
            "lang", F.lit("").alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"), F.lit(0).cast("long").alias("spot"),
            F.lit(1).cast("long").alias("groups"),
        )
    else:
        tops = upper.proofs(roots, ["lang"], groups, "lang string, path string, subroot string, root string, spot long, groups long", {"root": "string"})
    tops = c.stage(tops, "tops")

    def check(kept: dict, nodes: list, places: list, size: int, paths: list, whole: dict) -> dict[str, list]:
        folded = []
        for node, found, place, path in zip(nodes, kept["found"], places, paths, strict=True):
            subroot, rest = fold(found or node, place, size, path)
            folded.append(fold(subroot, whole["spot"], whole["groups"], rest)[0])
        n = len(nodes)
        return {
            "doc_id": pa.array(kept["doc_id"], pa.int64()), "leaf": nodes, "subroot": [whole["subroot"]] * n, "root": [whole["root"]] * n,
            "proof_sha256": [_h(p) for p in paths], "folded_root": folded, "verified": pa.array([f == whole["root"] for f in folded], pa.bool_()),
        }

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if len(tree.levels) == 1:  # groups of one leaf each: their levels are one

        def alone(batches):
            for b in batches:
                for i in range(b.num_rows):
                    row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                    got = check({"doc_id": [row["doc_id"]], "found": [row["found"]]}, [row["node"]], [0], 1, [row["path"]], row)
                    yield pa.RecordBatch.from_pydict(got)

        met = tree.levels[0].alias("a").join(tops.alias("t"), F.col("a.lang").eqNullSafe(F.col("t.lang")))
        return met.select("doc_id", "found", "node", "path", "subroot", "root", "spot", "groups").mapInArrow(alone, schema)
    return tree.proofs(tops, ["doc_id", "found"], check, schema, adds)
