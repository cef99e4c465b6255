"""Mixing sources to target weights with exact quotas per output shard (operator 3).

Built-in functions only.  Every source is cut into cells by a hash of its documents, at
most ``CELLS`` of them, which are its blocks.  A source is taken as often as its target
holds it whole; the rest of the target comes from blocks in a fixed permuted order, the
last of them cut to the word.  The block quotas of all sources are then split among the
output shards: a tree halves the shards again and again, and at each node the left half
gets a multivariate hypergeometric draw of the node's quotas.  So each shard knows how
many blocks of each source it holds, takes the next ones of the permuted order, and
shuffles its documents by a hash; no two shards share a draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.session import stage

CELLS = 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank, tab and line ends; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST
            ) -> DataFrame:
    """(source, source_size, cells, target) from rows (source, cell, size), one per cell.

    Sources by code point, null last, take the weights in turn.  They share ``share``
    times all sizes by weight; a target stops at ``most`` times its source's size and the
    excess is shared again by weight.  What that ends in is the level L with
    sum(min(most * size, L * weight)) = total, found from sources in order of size per
    weight.  Sources without words have target 0.  One row per source goes through one
    task: a catalogue, not the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"),
                                      F.count("*").alias("cells"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = per.withColumn("number", F.row_number().over(by_name)).withColumn("weight", pick)
    cap = F.col("source_size") * F.lit(most)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("number").rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)
    level = weighed.withColumn("cap", cap).withColumn(
        "level", (share * F.sum("source_size").over(everything)
                  - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # The first source whose cap is not below the level sets it for all that follow.
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
        F.col("cap") / F.col("weight"), "number", "level"))).over(everything)
    return level.withColumn("free", free).select(
        "source", "source_size", "cells", "number",
        F.least("cap", F.coalesce(F.col("free.level") * F.col("weight"), "cap")).alias("target"))


def draw(n: str, kind: str, total: str, u: str) -> str:
    """SQL of a draw without replacement: how many of n blocks are of one kind.

    The population has ``total`` blocks, ``kind`` of that kind.  The chances of all counts
    within 12 standard deviations of the most likely one are taken relative to each other
    and summed until they pass the random number u.
    """
    return f"""element_at(transform(array(named_struct(
        'n', {n}, 'kind', {kind}, 'total', {total}, 'u', {u},
        'low', greatest(0L, {n} - ({total} - {kind})), 'high', least({n}, {kind}))), v ->
      if(v.low >= v.high, v.low,
        element_at(transform(array(named_struct(
            'mode', cast(floor((v.n + 1D) * (v.kind + 1D) / (v.total + 2D)) as bigint),
            'reach', 2L + cast(ceil(12 * sqrt(v.n * (v.kind / v.total) * (1 - v.kind / v.total)
                * (v.total - v.n) / greatest(v.total - 1D, 1D))) as bigint))), m ->
          element_at(transform(array(named_struct(
              'from', greatest(v.low, least(m.mode, v.high) - m.reach),
              'to', least(v.high, greatest(m.mode, v.low) + m.reach))), r ->
            element_at(transform(array(aggregate(sequence(r.from, r.to),
                named_struct('log', 0D, 'logs', cast(array() as array<double>)),
                (s, k) -> named_struct(
                    'log', s.log + if(k >= r.to, 0D,
                        ln((v.kind - k) * 1D) + ln((v.n - k) * 1D) - ln(k + 1D)
                        - ln(v.total - v.kind - v.n + k + 1D)),
                    'logs', concat(s.logs, array(s.log))),
                s -> transform(s.logs, x -> exp(x - array_max(s.logs))))), p ->
              r.from + aggregate(p,
                named_struct('left', v.u * aggregate(p, 0D, (a, x) -> a + x), 'at', 0L),
                (s, x) -> named_struct('left', s.left - x, 'at', s.at + if(s.left > x, 1L, 0L)),
                s -> least(s.at, size(p) - 1L))), 1)), 1)), 1))), 1)"""


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(number, ends): per source the running block counts after each shard.

    ``quotas`` has (number, blocks).  ``shards`` must be a power of two.  The rows of the
    tree hold the quotas of all sources, a number each; there are 2 * shards - 1 of them.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("number", "blocks"))).alias("q")).select(
        F.lit(0).alias("node"), F.col("q.number").alias("numbers"), F.col("q.blocks").alias("q"))
    width = shards
    while width > 1:
        uniform = ("(pmod(xxhash64(node, s.i, %d, %d), 1048576L) + 0.5D) / 1048576D" % (width, seed))
        nodes = nodes.withColumn("left", F.expr(f"""
            aggregate(q, named_struct('i', 0, 'rest', aggregate(q, 0L, (a, x) -> a + x),
                'need', aggregate(q, 0L, (a, x) -> a + x) div 2, 'out', cast(array() as array<bigint>)),
              (s, kind) -> element_at(transform(array({draw('s.need', 'kind', 's.rest', uniform)}), k ->
                named_struct('i', s.i + 1, 'rest', s.rest - kind, 'need', s.need - k,
                             'out', concat(s.out, array(k)))), 1),
              s -> s.out)"""))
        nodes = nodes.selectExpr("numbers", "inline(array("
                                 "named_struct('node', node * 2, 'q', left), "
                                 "named_struct('node', node * 2 + 1, 'q', zip_with(q, left, (a, b) -> a - b))))")
        width //= 2
    parts = nodes.select("node", F.explode(F.arrays_zip("numbers", "q")).alias("z")).groupBy(
        F.col("z.numbers").alias("number")).agg(
        F.array_sort(F.collect_list(F.struct("node", F.col("z.q").alias("blocks")))).alias("p"))
    return parts.select("number", F.expr(
        "aggregate(p.blocks, cast(array(0L) as array<bigint>), "
        "(s, x) -> concat(s, array(element_at(s, -1) + x)), s -> slice(s, 2, size(p)))").alias("ends"))


def plan(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Each document with what the mix takes of it.

    ``docs`` needs _source, _id, _order (a number that tells rows of one id apart, such as
    a hash of the text) and _size.  Adds source_size, target, taken and ``copies``, an array
    of (shard, words) with one entry for each time that the document is in the mix.  Of
    rows that nothing tells apart, those at the cut share its words evenly.
    """
    rows = docs.withColumn("_mark", F.xxhash64("_id", "_order", F.lit(seed))).withColumn(
        "_cell", F.pmod("_mark", F.lit(CELLS)).cast("int"))
    sizes = rows.groupBy(F.col("_source").alias("source"), F.col("_cell").alias("cell")).agg(
        F.sum("_size").alias("size"))
    sizes = stage(sizes, "cells")
    goal = targets(sizes).withColumn("want", F.round("target").cast("long")).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size")))
        .otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("want") - F.col("whole") * F.col("source_size"))
    permuted = Window.partitionBy("number").orderBy(F.xxhash64("number", "cell", F.lit(seed + 1)), "cell")
    cells = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    cells = cells.withColumn("place", F.row_number().over(permuted) - 1).withColumn(
        "before", F.sum("size").over(permuted) - F.col("size"))
    cells = cells.withColumn(
        "part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before"))))
    # Blocks without words are not drawn for the rest and take no turn.
    cells = stage(cells.withColumn("turn", F.count_if(F.col("part") > 0).over(permuted) - 1), "blocks")
    quotas = cells.groupBy("number").agg((F.max("whole") * F.max("cells")
                                          + F.count_if(F.col("part") > 0)).alias("blocks"))
    ends = split_quotas(quotas, shards, seed)

    # Only the block in which a target ends is ordered document by document.
    ending = cells.where("part > 0 and part < size").select(
        "number", "part", F.col("source").alias("end_source"), F.col("cell").alias("end_cell"))
    inside = rows.select("_source", "_cell", "_mark", "_size").join(
        ending, F.col("_source").eqNullSafe(F.col("end_source")) & (F.col("_cell") == F.col("end_cell")))
    by_mark = Window.partitionBy("number").orderBy("_mark")
    cut = inside.groupBy("number", "part", "_mark").agg(
        F.sum("_size").alias("words"), F.count("*").alias("rows")).withColumn(
        "ahead", F.sum("words").over(by_mark) - F.col("words")).where(
        "ahead < part and part <= ahead + words").select(
        "number", F.col("_mark").alias("cut"), F.expr("(part - ahead) div rows").alias("at_cut"))

    def shard_of(copy: Column, turn: str = "place") -> Column:
        at = copy * F.col("cells") + F.col(turn)
        return F.size(F.filter("ends", lambda e: e <= at)).cast("int")

    known = cells.join(ends, "number").join(cut, "number", "left").select(
        F.col("source").alias("_in"), F.col("cell").alias("_at"), "source_size", "target", "whole",
        "part", (F.col("part") == F.col("size")).alias("entire"), "cut", "at_cut",
        shard_of(F.lit(0)).alias("first"), shard_of(F.lit(1)).alias("second"),
        shard_of(F.col("whole"), "turn").alias("last"))
    joined = rows.join(known, F.col("_source").eqNullSafe(F.col("_in")) & (F.col("_cell") == F.col("_at")))
    extra = (F.when(F.col("part") <= 0, 0).when(F.col("entire") | (F.col("_mark") < F.col("cut")), F.col("_size"))
             .when(F.col("_mark") == F.col("cut"), F.least("_size", "at_cut")).otherwise(0))
    done = joined.withColumn("_extra", extra.cast("long"))

    def copy(shard: str, words: Column) -> Column:
        return F.struct(F.col(shard).alias("shard"), words.alias("words"))
    copies = F.filter(F.array(
        copy("first", F.when(F.col("whole") > 0, F.col("_size"))),
        copy("second", F.when(F.col("whole") > 1, F.col("_size"))),
        copy("last", F.when(F.col("_extra") > 0, F.col("_extra")))), lambda c: c["words"].isNotNull())
    return done.select(*docs.columns, "source_size", "target", (
        F.col("whole") * F.col("_size") + F.col("_extra")).alias("taken"), copies.alias("copies"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """What ``plan`` needs of each row, and the row itself in one column, so that no names meet."""
    return docs.select(
        F.struct(*docs.columns).alias("_row"), F.col(source).alias("_source"), F.col(doc_id).alias("_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_order"), word_count(F.col(text)).alias("_size"))


def takings(docs: DataFrame, shards: int = 16, seed: int = 0, doc_id: str = "doc_id",
            text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) of every row.

    A null source is a source of its own.  Null texts and texts without words have size 0
    and are taken with 0 words.  Repeated rows count each; an empty frame gives no rows.
    The texts are read once: ids and sizes are a written table.
    """
    thin = stage(_sized(docs, doc_id, text, source).select("_source", "_id", "_order", "_size"), "sizes")
    return plan(thin, shards, seed).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken",
        F.col("copies.shard").alias("shards"))


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its n-th word; the whole text if it has no more words."""
    cut = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(cut, F.lit(1), words.cast("int")), "")


def mix(docs: DataFrame, shards: int = 16, seed: int = 0, doc_id: str = "doc_id",
        text: str = "text", source: str = "source", shard: str | None = None) -> DataFrame:
    """The mix itself: a row for each time that a document is taken, texts cut where a target ends.

    Has the columns of ``docs``, whatever their names, and the shard number where a name for
    it is given.  Rows with nothing taken are not in it, nor are texts without words of sources that are not
    taken whole.
    """
    drawn = plan(_sized(docs, doc_id, text, source), shards, seed).withColumn("_copy", F.explode("copies"))
    whole = F.col("_row")[text]
    cut = F.when(F.col("_copy.words") < F.col("_size"), first_words(whole, F.col("_copy.words"))).otherwise(whole)
    kept = [(cut if c == text else F.col("_row")[c]).alias(c) for c in docs.columns]
    return drawn.select(*kept, *([F.col("_copy.shard").alias(shard)] if shard else []))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 0, **columns: str) -> None:
    """Write the mix as one folder per shard, each in a random order of its own."""
    mixed = mix(docs, shards, seed, shard="shard", **columns)
    order = F.xxhash64(*mixed.columns, F.lit(seed + 3))
    (mixed.repartition(shards, "shard").withColumn("_order", order)
     .sortWithinPartitions("shard", "_order").drop("_order").write.partitionBy("shard").parquet(path))
