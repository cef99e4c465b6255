"""Cross-entropy difference of two matched n-gram models (operator 1).

The target model is counted over wanted texts, the background model over all documents.
Both predict a byte from the three before it, share the vocabulary (256 bytes and the
start of a text) and the smoothing (Witten-Bell, down to a uniform choice), so their
losses per token differ only by what they were counted on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from forecourt.llm.batches import flat, fresh, pieces, ship, tidy
from forecourt.session import stage

ORDER = 4
BLOCK_BYTES = 1 << 21
BLOCK_ROWS = 4096


def grams(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Of each byte: itself and the three before it in its text, 0 before the start."""
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    keys = raw.astype(np.uint64)
    for back in range(1, ORDER):
        own = np.flatnonzero(place >= back)
        keys[own] |= raw[own - back].astype(np.uint64) << np.uint64(8 * back)
    return keys


def gram_counts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """(gram, count) over all texts of a frame; each task adds up its pieces first."""
    def run(batches):
        keys, counts = [], []

        def joined():
            all_keys, of = np.unique(np.concatenate(keys), return_inverse=True)
            return [all_keys], [np.bincount(of, np.concatenate(counts), len(all_keys)).astype(np.int64)]

        for batch in batches:
            offsets, raw = flat(batch.column("text"))
            for i, j in pieces(offsets):
                own = offsets[i:j + 1]
                k, n = np.unique(grams(own - own[0], raw[own[0]:own[-1]]), return_counts=True)
                keys.append(k)
                counts.append(n)
                if sum(map(len, keys)) > 1 << 21:
                    keys, counts = joined()
        if keys:
            keys, counts = joined()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[0].view(np.int64)), pa.array(counts[0])], ["gram", "n"])

    ship(docs.sparkSession)
    return docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "gram long, n long").groupBy(
        "gram").agg(F.sum("n").alias(name))


def _levels(grams: DataFrame) -> DataFrame:
    """(gram, target, background): log2 chances of the last byte of each gram.

    ``grams`` has (gram, t, b).  An order's chance is (count + kinds * chance of the next
    shorter order) / (all + kinds), with all and kinds those of the bytes before.
    """
    lower = None
    for m in range(1, ORDER + 1):
        mask = (1 << 8 * m) - 1
        own = grams if m == ORDER else grams.groupBy(
            F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(
            F.sum("t").alias("t"), F.sum("b").alias("b"))
        own = own.withColumn("before", F.shiftrightunsigned("gram", 8))
        stats = own.groupBy("before").agg(
            *(f(c).alias(f"{c}_{n}") for c in "tb" for n, f in (
                ("all", F.sum), ("kinds", lambda x: F.count_if(F.col(x) > 0)))))
        own = own.join(stats, "before")
        if lower is None:
            own = own.withColumns({f"{c}_low": F.lit(1 / 256) for c in "tb"})
        else:
            own = own.withColumn("shorter", F.col("gram").bitwiseAND(F.lit(mask >> 8))).join(lower, "shorter")
        lower = own.select("gram", *(F.when(
            F.col(f"{c}_all") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_low"))
            / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_low")).alias(f"{c}_p")
            for c in "tb"))
        if m < ORDER:
            lower = lower.select(F.col("gram").alias("shorter"), F.col("t_p").alias("t_low"),
                                 F.col("b_p").alias("b_low"))
    return lower.select("gram", F.log2("t_p").alias("target"), F.log2("b_p").alias("background"))


class Losses:
    """Bits per gram for both models: a written table of every gram counted.

    A gram that was never counted costs what its last two bytes cost on average.
    """

    def __init__(self, levels: DataFrame, counts: DataFrame):
        rows = stage(levels.join(counts.select("gram", "b"), "gram"), "losses")
        self.bits = rows.select("gram", *((-F.col(c)).alias(c) for c in ("target", "background")))
        pairs = rows.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(
            *((F.sum(F.col(c) * F.col("b")) / F.sum("b")).cast("float").alias(c)
              for c in ("target", "background"))).toArrow()  # 65,536 rows at most
        self.pair = np.full((2, 1 << 16), 8.0, np.float32)
        self.pair[:, pairs.column(0).to_numpy()] = -np.stack(
            [pairs.column(c).to_numpy() for c in (1, 2)])


def _score(offsets: np.ndarray, raw: np.ndarray, known: np.ndarray, bits: np.ndarray,
           pair: np.ndarray) -> list[np.ndarray]:
    """Per text: tokens, bits per token of the target and of the background model.

    ``known`` are sorted grams, ``bits`` theirs by model.
    """
    docs = len(offsets) - 1
    size = np.diff(offsets)
    keys = grams(offsets, raw)
    doc = np.repeat(np.arange(docs), size)
    low = (keys & np.uint64(0xFFFF)).astype(np.int64)
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    seen = known[at] == keys if len(known) else np.zeros(len(keys), bool)
    out = []
    for model in (0, 1):
        own = pair[model][low].astype(np.float64)
        own[seen] = bits[model][at[seen]]
        out.append(np.bincount(doc, own, docs) / np.maximum(size, 1))
    return [size, *out]


def _spread(text: str):
    """Rows (block, gram, rows): of a block of rows its different grams, and the rows themselves.

    The row that holds a block has a negative gram of its own, so it goes to any task.
    """
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        names = ["block", "gram", "rows"]
        for batch in batches:
            offsets, raw = flat(batch.column(batch.schema.get_field_index(text)))
            for i, j in pieces(offsets, BLOCK_BYTES, BLOCK_ROWS):
                keys = np.zeros(0, np.uint64)
                own = offsets[i:j + 1]
                for a, z in pieces(own):
                    some = own[a:z + 1]
                    keys = np.union1d(keys, grams(some - some[0], raw[some[0]:some[-1]]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([-1 - block]),
                     pa.array([sink.getvalue().to_pybytes()], pa.binary())], names)
                if len(keys):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), block)), pa.array(keys.view(np.int64)),
                         pa.nulls(len(keys), pa.binary())], names)
                block += 1
    return run


def _gathered(pair, fields: list[T.StructField], schema: T.StructType):
    """The rows of each block with their scores, from rows sorted by block and gram."""
    arrow = to_arrow_schema(T.StructType(fields))
    names = [f.name for f in schema.fields]

    def scored(text_at, rows, found):
        known = np.concatenate([x[0] for x in found]).view(np.uint64)
        bits = np.concatenate([x[1] for x in found], axis=1)
        has = ~np.isnan(bits[0])
        known, bits = known[has], bits[:, has]
        for batch in pa.ipc.open_stream(rows):
            offsets, raw = flat(batch.column(text_at))
            for i, j in pieces(offsets):
                own = offsets[i:j + 1]
                got = _score(own - own[0], raw[own[0]:own[-1]], known, bits, pair.value)
                made = [pa.array(x, f.type) for x, f in zip(got, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, j - i) for c in batch.columns] + made, names)

    def make(text_at):
        def run(batches):
            block, rows, found = None, None, []
            for batch in batches:
                blocks = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == z:
                        continue
                    if blocks[a] != block:
                        if block is not None:
                            yield from scored(text_at, rows, found)
                        block, found = blocks[a], []
                        rows = batch.column(4)[a].as_py()
                        a += 1
                    part = [batch.column(c).slice(a, z - a).to_numpy(zero_copy_only=False) for c in (1, 2, 3)]
                    found.append((part[0].astype(np.int64), np.stack(part[1:]).astype(np.float64)))
            if block is not None:
                yield from scored(text_at, rows, found)
        return run
    return make


def fit(docs: DataFrame, wanted: DataFrame, text: str = "text") -> Losses:
    """Count both models: ``wanted`` texts for the target, all documents for the background.

    Every text counts, whole.  The counts are a written table of one row per different
    gram of four bytes.
    """
    background = gram_counts(docs, text, "b")
    target = gram_counts(wanted, text, "t")
    counts = stage(background.join(target, "gram", "full").select(
        "gram", F.coalesce("t", F.lit(0)).alias("t"),
        F.greatest(F.coalesce("b", F.lit(0)), F.coalesce("t", F.lit(0))).alias("b")), "grams")
    return Losses(_levels(counts), counts)


def cross_entropy_difference(docs: DataFrame, losses: Losses, text: str = "text") -> DataFrame:
    """Add n_tokens, ce_target, ce_background and ce_difference (bits per token) to every row.

    Blocks of rows send their different grams to the table and meet what these cost again,
    so no task holds the table and a frequent gram is one row of a block.  A lower
    difference means more like the target.  Null and empty texts have no tokens
    and 0 bits.  Whole texts are read, repeated rows score alike, an empty frame stays
    empty, and a taken column name gets an underscore.
    """
    ship(docs.sparkSession)
    pair = docs.sparkSession.sparkContext.broadcast(losses.pair)
    target, background = fresh(docs, "ce_target"), fresh(docs, "ce_background")
    fields = [T.StructField(fresh(docs, "n_tokens"), T.LongType()),
              T.StructField(target, T.DoubleType()), T.StructField(background, T.DoubleType())]
    schema = T.StructType(docs.schema.fields + fields)
    spread = docs.mapInArrow(tidy(_spread(text)), "block long, gram long, rows binary")
    met = spread.join(losses.bits.hint("merge"), "gram", "left").select(
        "block", "gram", "target", "background", "rows")
    scored = met.repartition("block").sortWithinPartitions("block", "gram").mapInArrow(
        tidy(_gathered(pair, fields, schema)(docs.columns.index(text))), schema)
    return scored.withColumn(fresh(docs, "ce_difference"), F.col(target) - F.col(background))
