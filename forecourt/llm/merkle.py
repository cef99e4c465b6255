"""Merkle manifests of grouped rows: stored every second level, proofs by recomputation (operator 13).

Digests are lower-case hexadecimal SHA-256; the digest of several is that of their hexadecimal
text joined.  Each group's leaves, in order, are the lowest level of its tree.  While a level has
several nodes, each run of ``ARITY`` consecutive ones (the last may be shorter, even one)
becomes its digest on the next level.  What remains is the group's subroot, and the
subroots in order of their groups give the root in the same way.

A manifest folder holds, for the groups (``groups``) and for the tree of subroots (``top``),
every second level only: rows (key, block, total, items), where a block is ``BLOCK`` consecutive
nodes, an aligned subtree, and total the number of nodes of that level of the group.  The
levels between are made again, block by block, where a proof needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forecourt.functions.text import let
from forecourt.session import stage

ARITY = 16
BLOCK = ARITY**2
STEP = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(*columns: Column) -> Column:
    """Digest of a row: each value as its number of UTF-8 bytes, a colon and the value; null as -."""
    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return digest(F.concat(*map(field, columns)))


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _runs(nodes: Column) -> Column:
    """Array of the runs of an array of nodes."""
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(ARITY)), lambda i: F.slice(nodes, i, ARITY))


def _above(nodes: Column) -> Column:
    """The next level's nodes."""
    return F.transform(_runs(nodes), lambda run: digest(_joined(run)))


def _top(nodes: Column, total: Column) -> Column:
    """What a block of a level with ``total`` nodes becomes two levels up, or at the end of its tree."""
    return F.when(total == 1, nodes[0]).when(total <= ARITY, digest(_joined(nodes))).otherwise(
        digest(_joined(_above(nodes))))


def _step(nodes: Column, i: Column) -> Column:
    """The siblings of the i-th node (from 0) of a run, left and right of it."""
    return F.struct(
        _joined(F.slice(nodes, F.lit(1), i)).alias("left"),
        _joined(F.slice(nodes, i + 2, ARITY)).alias("right"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(steps, leaf, lambda x, s: digest(F.concat(s["left"], x, s["right"])))


def siblings(steps: Column) -> Column:
    """Digest of a proof's siblings, level by level, left to right."""
    return digest(_joined(F.transform(steps, lambda s: F.concat(s["left"], s["right"]))))


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``pos``, the place from 0 in the group by id and leaf, and ``total``, the group's rows.

    One shuffle by range over (group, id, leaf, row number): a group, an id or a repeated row that
    holds a large share of all rows is spread over many tasks.  Groups continue from task to task by
    their counts, of which there are no more than tasks and groups.
    """
    order = ["key", "id", "leaf", "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    rows = stage(rows.withColumn("n", F.monotonically_increasing_id()), "merkle-leaves")
    part = F.shiftright("n", 33)
    counts = rows.groupBy(F.col("key").alias("k"), part.alias("p")).agg(
        F.min("n").alias("first"), F.count("*").alias("m"))
    group = Window.partitionBy("k")
    before = F.sum("m").over(group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("k", "p", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("m").over(group).alias("total"))
    joined = rows.join(counts, rows["key"].eqNullSafe(counts["k"]) & (part == counts["p"]))
    return joined.select("key", "id", "leaf", "carried", (F.col("n") + F.col("shift")).alias("pos"), "total")


def _blocks(nodes: DataFrame, *columns: str) -> DataFrame:
    """Rows (key, block, total, items) of the nodes of one level; a block is ``BLOCK`` of them at most."""
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    return nodes.groupBy("key", block, "total").agg(
        F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("items"))


def _write_tree(rows: DataFrame, path: str) -> DataFrame:
    """Store the trees of (key, id, leaf, carried); gives (key, node, height), a row for each tree."""
    spark, tops, level = rows.sparkSession, [], 0
    nodes = _numbered(rows.select("key", "id", "leaf", "carried"))
    columns = ["leaf", "id", "carried"]
    while True:
        _blocks(nodes, *columns).write.parquet(f"{path}/level-{level}")
        stored = spark.read.parquet(f"{path}/level-{level}")
        top = let(F.col("items.leaf"), lambda x: _top(x, F.col("total")))
        tops.append(stored.where(F.col("total") <= BLOCK).select(
            "key", top.alias("node"), F.lit(level).alias("height")))
        level += 1
        # The new total comes after the digests: beside them it would stand for the old one in ``top``.
        above = stored.where(F.col("total") > BLOCK).select("key", F.col("block").alias("pos"), "total", top.alias("leaf"))
        above = above.withColumn("total", F.ceil(F.col("total") / BLOCK))
        if above.isEmpty():
            break
        nodes, columns = above, ["leaf"]
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return out


def write(docs: DataFrame, path: str, columns: list[str], group: str, order: str = "doc_id",
          carry: list[str] | None = None) -> None:
    """Write the manifest of a table as a folder.

    A leaf is the digest of the named ``columns`` of a row; leaves are grouped by ``group`` and
    ordered by ``order`` (null first; rows of one id by leaf, so that the manifest does not depend
    on how rows are dealt).  ``carry`` names columns that ``proofs`` gives back.  Null and empty
    values, repeated rows and null groups are as any other; an empty table has an empty manifest.
    The texts are read once and not shuffled, whatever their length: only digests are.
    Other columns may have any names.
    """
    carried = F.struct(*([F.col(c) for c in carry] if carry else [F.lit(None).cast("string").alias("none")]))
    leaves = stage(docs.select(
        F.col(group).alias("key"), F.col(order).alias("id"), leaf(*map(F.col, columns)).alias("leaf"),
        carried.alias("carried")), "merkle-rows")
    subroots = _write_tree(leaves, f"{path}/groups")
    subroots.write.parquet(f"{path}/subroots")
    subroots = docs.sparkSession.read.parquet(f"{path}/subroots")
    root = _write_tree(subroots.select(
        F.lit(0).alias("key"), F.col("key").alias("id"), F.col("node").alias("leaf"),
        F.struct("height").alias("carried")), f"{path}/top")
    root.select(F.col("node").alias("root"), "height").write.parquet(f"{path}/root")


def _down(spark: SparkSession, path: str, ends: DataFrame) -> DataFrame:
    """(key, id, leaf, carried, known, steps) of every leaf of the trees stored at ``path``.

    ``ends`` has for each key the ``height`` of its highest block, the ``steps`` above its subroot
    and what is ``known`` of it.  From the highest level down, each block makes its missing
    level again, gives its nodes their siblings, and hands them to the blocks below.
    """
    above, level = None, ends.agg(F.max("height")).first()[0]
    level = 0 if level is None else level
    while True:
        here = ends.where(F.col("height") == level).select(
            F.col("key").alias("k"), F.lit(0).cast("long").alias("b"), "known", "steps")
        above = here if above is None else above.unionByName(here)
        blocks = spark.read.parquet(f"{path}/level-{level}")
        blocks = blocks.join(above, blocks["key"].eqNullSafe(above["k"]) & (blocks["block"] == above["b"]))
        nodes = let(F.col("items.leaf"), lambda x: F.when(F.col("total") > ARITY, _above(x)))
        blocks = blocks.select("key", "known", "steps", "total", nodes.alias("nodes"), F.posexplode(
            _runs(F.col("items"))).alias("r", "run"))
        second = F.when(F.col("total") > ARITY, F.array(_step(F.col("nodes"), F.col("r")))).otherwise(
            F.array().cast(STEP))
        # Siblings in the made-again level are those of the whole run.
        runs = blocks.select("key", "known", "total", F.concat(second, "steps").alias("steps"),
                             F.col("run.leaf").alias("leaves"), F.posexplode("run").alias("i", "item"))
        first = F.when(F.col("total") > 1, F.array(_step(F.col("leaves"), F.col("i")))).otherwise(
            F.array().cast(STEP))
        nodes = runs.select("key", "known", "item", F.concat(first, "steps").alias("steps"))
        if level == 0:
            return nodes.select("key", "item.id", "item.leaf", "item.carried", "known", "steps")
        above = nodes.select(F.col("key").alias("k"), F.col("item.pos").alias("b"), "known", "steps")
        level -= 1


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """(key, id, leaf, carried, subroot, root, steps) of every row of a manifest.

    ``steps`` are the siblings on every level from the leaf to the root, those left and those right
    of the own node; ``folded`` gives the root from them.  No task sees more of a tree than a
    block of ``BLOCK`` nodes.
    """
    top = spark.read.parquet(f"{path}/root").select(  # one row
        F.lit(0).alias("key"), "height", F.array().cast(STEP).alias("steps"), F.struct("root").alias("known"))
    groups = _down(spark, f"{path}/top", top)
    ends = stage(groups.select(
        F.col("id").alias("key"), F.col("carried.height").alias("height"), "steps",
        F.struct(F.col("leaf").alias("subroot"), "known.root").alias("known")), "merkle-groups")
    rows = _down(spark, f"{path}/groups", ends)
    return rows.select("key", "id", "leaf", "carried", "known.subroot", "known.root", "steps")
