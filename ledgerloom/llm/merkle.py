"""A Merkle manifest of a dataset, climbed by butterfly exchange.

Every row is a leaf: the SHA-256 of its columns, each with its length before it. The
leaves of a tree (all rows of one group value, by rising id) are dealt into aligned
*parts* of ``FANOUT ** HEIGHT`` leaves, and each part hashes its own subtree. Then the
parts climb together: in round r, those parts whose numbers differ in digit r only (to
base ``FANOUT``) swap the roots of the subtrees they stand for; each part hashes the
parent by itself and keeps what came before and after its own subtree as one more step
of its proof. After the last round each part has the tree's root and the upper half of
its leaves' proofs, and nothing has to be handed down. Where the last subtree of a run
holds fewer parts than its neighbours, each of its parts answers for several of theirs.
The roots of all trees, by group value, are the leaves of one more tree, climbed alike.

A round moves one short row a part, so all rounds together move far less than the
leaves do. Ranks come from a range partitioning and one count for each partition and
tree; a group that holds a third of all rows is many parts like any other.

Defined results: a null column is ``-`` in its leaf; a null group value is a tree of its
own, the first one; null ids follow the other ids of their tree; repeated rows are
leaves of their own, rows with one id being ordered by their leaf; an empty table gives an
empty result; only the named columns are read, so that others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage, wide
from ledgerloom.llm.textscan import chunks

FANOUT, HEIGHT = 8, 4
STEPS = "array<struct<before string, after string>>"
PROVED = f"item string, leaf string, subroot string, root string, folded string, proof {STEPS}"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its proof lead to; a step is what stands before and after in the run."""
    for before, after in steps:
        leaf = digest(before + leaf + after)
    return leaf


def leaf_digests(docs: DataFrame, columns: list[str], id_column: str, group_column: str, change: Callable[[object, dict], dict] | None = None) -> DataFrame:
    """tree, item, no_id, leaf and seen: the leaf of the row as ``change(id, values)`` leaves it, null if that is the same.

    ``values`` are the named columns' as bytes or None, integers decimal.
    """
    at = columns.index(id_column)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, columns[-1]):
                values = [part.column(k).cast(pa.binary()).to_pylist() for k in range(len(columns))]
                leaf, seen = [], []
                for row in zip(*values):
                    leaf.append(sha256(_joined(row)).hexdigest())
                    other = row if change is None else change(row[at], row)
                    seen.append(None if other is row else sha256(_joined(other)).hexdigest())
                yield pa.RecordBatch.from_arrays([part["tree"], part["item"], pa.array(leaf), pa.array(seen, pa.string())], ["tree", "item", "leaf", "seen"])

    rows = docs.select(
        *(F.col(c).cast("string").alias(c) for c in columns), F.coalesce(F.concat(F.lit("1"), F.col(group_column).cast("string")), F.lit("0")).alias("tree"),
        F.col(id_column).cast("string").alias("item"))
    return rows.mapInArrow(run, "tree string, item string, leaf string, seen string")


def _joined(values) -> bytes:
    return b"".join(b"-" if v is None else b"%d:%b" % (len(v), v) for v in values)


def _parts(rows: DataFrame, order: list, height: int) -> DataFrame:
    """A row for each part of each tree: tree, part, of (the tree's parts), leaves (item, leaf, seen by position)."""
    # the last key makes every row's place its own, so that no range is larger for equal rows
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col("tree"), *order, F.col("leaf"), F.col("tie")]
    ranged = rows.repartitionByRange(wide(rows.sparkSession), *keys).sortWithinPartitions(*keys).drop("tie")
    ranged = stage(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("tree", "range").agg(F.min("at").alias("least"), F.count("*").alias("many"))
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "tree", "range", (F.coalesce(F.sum("many").over(before), F.lit(0)) - F.col("least")).alias("shift"), F.sum("many").over(Window.partitionBy("tree")).alias("all"))
    size = FANOUT**height
    placed = ranged.join(counts, ["tree", "range"]).withColumn("place", F.col("at") + F.col("shift"))
    return placed.groupBy("tree", F.expr(f"place div {size}").alias("part"), F.expr(f"(all + {size - 1}) div {size}").alias("of")).agg(
        F.sort_array(F.collect_list(F.struct("place", "item", "leaf", "seen"))).alias("leaves"))


def _climb(level: list[str], whole: bool, height: int) -> list[list[str]]:
    """The levels over a part's leaves: to one node if the part is the whole tree, else ``height`` ones."""
    levels = [level]
    while len(levels[-1]) > 1 if whole else len(levels) <= height:
        levels.append([digest("".join(levels[-1][k : k + FANOUT])) for k in range(0, len(levels[-1]), FANOUT)])
    return levels


def _roots(batches, height: int):
    """Each part's own root."""
    for batch in batches:
        nodes = [_climb([x["leaf"] for x in leaves], of == 1, height)[-1][0] for leaves, of in zip(batch["leaves"].to_pylist(), batch["of"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["tree"], batch["part"], batch["of"], pa.array(nodes)], ["tree", "part", "of", "node"])


def exchange(nodes: DataFrame, rounds: int) -> DataFrame:
    """The butterfly: tree, part, of, node (in the end the tree's root), steps (the part's proof).

    In round r a part stands for subtree ``part div FANOUT**r`` and meets those of the same
    ``part mod FANOUT**r`` in its run. Subtrees but the last have ``FANOUT**r`` parts.
    """
    nodes = nodes.withColumn("steps", F.expr(f"CAST(array() AS {STEPS})"))
    for r in range(rounds):
        stride = FANOUT**r
        nodes = nodes.selectExpr("*", f"part div {stride} AS sub", f"part % {stride} AS lane", f"(of + {stride - 1}) div {stride} AS subs")
        # the last subtree's parts answer for the lanes that it lacks
        lanes = F.expr(f"IF(sub = subs - 1 AND subs > 1, sequence(lane, {stride - 1}L, of - (subs - 1) * {stride}), array(lane))")
        sent = nodes.withColumn("to", F.explode(lanes)).selectExpr(
            "tree", "of", "subs", f"sub div {FANOUT} AS run", "to", "struct(sub, to = lane AS own, part, node, IF(to = lane, steps, NULL) AS steps) AS said")
        met = sent.groupBy("tree", "of", "subs", "run", "to").agg(F.sort_array(F.collect_list("said")).alias("said"))
        nodes = met.withColumn("me", F.explode(F.expr("filter(said, x -> x.own)"))).selectExpr(
            "tree", "me.part AS part", "of", "IF(subs > 1, sha2(array_join(transform(said, x -> x.node), ''), 256), me.node) AS node",
            """IF(subs > 1, concat(me.steps, array(struct(array_join(transform(filter(said, x -> x.sub < me.sub), x -> x.node), '') AS before,
               array_join(transform(filter(said, x -> x.sub > me.sub), x -> x.node), '') AS after))), me.steps) AS steps""")  # fmt: skip
    return nodes


def _trees(rows: DataFrame, order: list, height: int) -> DataFrame:
    """Every part with its leaves, its tree's root (node) and its proof from the part's own root on (steps)."""
    parts = stage(_parts(rows, order, height), "parts")
    most = parts.agg(F.max("of")).head()[0] or 0
    rounds = 0
    while FANOUT**rounds < most:
        rounds += 1
    nodes = parts.mapInArrow(partial(_roots, height=height), "tree string, part long, of long, node string")
    return parts.join(stage(exchange(nodes, rounds), "nodes"), ["tree", "part", "of"])


def _prove(batches, height: int):
    """A row for each leaf: its proof from the leaf to the last root, and where its seen form leads."""
    for batch in batches:
        for leaves, of, node, upper, last, root in zip(*(batch[c].to_pylist() for c in ("leaves", "of", "node", "steps", "last", "root"))):
            levels = _climb([x["leaf"] for x in leaves], of == 1, height)
            own = []
            for level in levels[:-1]:
                runs = [level[k : k + FANOUT] for k in range(0, len(level), FANOUT)]
                own.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
            shared = [(s["before"], s["after"]) for s in (*upper, *last)]
            out = []
            for k, x in enumerate(leaves):
                steps = [level[k // FANOUT**h] for h, level in enumerate(own)] + shared
                out.append((x["item"], x["leaf"], node, root, fold(x["seen"] or x["leaf"], steps), [{"before": b, "after": a} for b, a in steps]))
            step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
            for k in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, step if n == "proof" else pa.string()) for n, c in zip(("item", "leaf", "subroot", "root", "folded", "proof"), zip(*out[k : k + 512]))], ["item", "leaf", "subroot", "root", "folded", "proof"])


def build_manifest(docs: DataFrame, columns: list[str], id_column: str = "doc_id", group_column: str = "lang", change: Callable | None = None, height: int = HEIGHT) -> DataFrame:
    """item (the id as text), leaf, subroot, root, folded and proof of each row of ``docs``.

    ``proof`` holds the steps from the leaf to the root; ``folded`` is where they lead from
    the leaf of the row as ``change`` leaves it (by default the row itself). The last of
    ``columns`` should be the longest. A part holds ``FANOUT ** height`` leaves.
    """
    rows = stage(leaf_digests(docs, columns, id_column, group_column, change), "leaves")
    number = F.col("item").cast(docs.schema[id_column].dataType)
    trees = _trees(rows, [number.isNull(), number], height)
    trees = stage(trees, "trees")
    roots = trees.filter("part = 0").selectExpr("'' AS tree", "tree AS item", "node AS leaf", "CAST(NULL AS string) AS seen")
    top = _trees(roots, [F.col("item")], height).selectExpr("leaves", "of", "node", "steps", "CAST(array() AS " + STEPS + ") AS last", "node AS root")
    top = top.mapInArrow(partial(_prove, height=height), PROVED).selectExpr("item AS tree", "proof AS last", "root")
    return trees.join(top, "tree").mapInArrow(partial(_prove, height=height), PROVED)
