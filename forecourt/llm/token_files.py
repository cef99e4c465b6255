"""Token files of directly addressable codes, with any token at hand (operator 12).

A token folder holds two Parquet tables.  ``blocks`` has a row for each run of whole
documents of about ``BLOCK`` ids, in ascending order of part and block:

- ``part``, ``block``: the task that wrote it and its number there;
- ``first``: ids of the same part before it; ``n_ids``: its ids;
- ``doc_ids``, ``sizes``: its documents and how many ids each has, with the end id;
- ``levels``: the ids cut into chunks of eight bits, lowest first.  A level has the ``chunks``,
  a bit for each (``more``, lowest bit first) that says whether the id goes on in the next
  level, and ``ranks``, the number of set bits before every 512th (32 bits, little-endian).
  The set bits number the next level's chunks, so an id is found without its neighbours.

``parts`` has the number of ids before each part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from forecourt.llm.batches import fresh, ship, tidy
from forecourt.llm.pretokens import SPLIT, vocabulary

BLOCK = 1 << 13
STEP = 512

Codes = list[dict[str, bytes]]


def pack(ids: np.ndarray) -> Codes:
    """The levels of an array of ids below 2^32."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        ones = np.concatenate(([0], more.cumsum()))[:len(more):STEP]
        levels.append({
            "chunks": (rest & 0xFF).astype(np.uint8).tobytes(),
            "more": np.packbits(more, bitorder="little").tobytes(),
            "ranks": ones.astype("<u4").tobytes()})
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return levels


def unpack(levels: Codes) -> np.ndarray:
    """All ids of the levels."""
    above = np.zeros(0, np.uint32)
    for level in reversed(levels):
        ids = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["more"], np.uint8), bitorder="little", count=len(ids))
        ids[more.view(bool)] |= above << np.uint32(8)
        above = ids
    return above


def _rank(more: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits before each place: the directory's count and the bits since then."""
    base = at // STEP
    byte = base[:, None] * (STEP // 8) + np.arange(STEP // 8)
    bits = more[np.minimum(byte, len(more) - 1)]
    here = (at // 8)[:, None]
    part = (1 << (at % 8)[:, None]) - 1
    bits = np.where(byte < here, bits, np.where(byte == here, bits & part, 0)).astype(np.uint8)
    return ranks[base] + np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def at(levels: Codes, places: np.ndarray) -> np.ndarray:
    """The ids at some places, each by one step a level; nothing else is decoded."""
    out, live, place = np.zeros(len(places), np.uint32), np.arange(len(places)), np.asarray(places, np.int64)
    for shift, level in enumerate(levels):
        chunks, more = (np.frombuffer(level[k], np.uint8) for k in ("chunks", "more"))
        out[live] |= chunks[place].astype(np.uint32) << np.uint32(8 * shift)
        goes_on = (more[place // 8] >> (place % 8).astype(np.uint8)) & 1 == 1
        live, place = live[goes_on], place[goes_on]
        if not len(live):
            break
        place = _rank(more, np.frombuffer(level["ranks"], "<u4").astype(np.int64), place)
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, made once per worker.

    Merges by id equal merges by rank, since such a file numbers tokens in the order of their
    merges.  The ids are those of the tokenizers library, at a quarter of its time.
    """
    vocab = vocabulary(path)
    special = set(vocab.special.values())
    ranks = {token: i for i, token in vocab.bytes_of.items() if i not in special}
    if (np.diff(vocab.merged) <= 0).any():
        raise ValueError(f"{path}: tokens are not numbered in the order of their merges")
    return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=vocab.special)


def _schema(key: T.DataType) -> T.StructType:
    level = T.StructType([T.StructField(n, T.BinaryType()) for n in ("chunks", "more", "ranks")])
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(key)), T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("levels", T.ArrayType(level))])


def write(docs: DataFrame, path: str, tokens: str, doc_id: str = "doc_id", text: str = "text",
          end: int = 0, block_ids: int = BLOCK) -> None:
    """Write the ids of every whole text, each followed by ``end``, as a token folder.

    The documents are in ascending order of id, rows without an id first, rows of one id in
    an order that depends on their texts alone.  A null or empty text has the end id only;
    repeated rows are written each; an empty frame gives empty tables; other columns, whatever
    their names, stay out.  One shuffle by range sorts the texts; a row number as last key
    splits an id that many rows share.  A block is whole documents, so a very long text
    makes a block of its own.  Spark commits the files, so a lost task is written again.
    """
    ship(docs.sparkSession)
    schema = _schema(docs.schema[doc_id].dataType)
    arrow = to_arrow_schema(schema)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "tie", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, last = tokenizer(tokens), np.array([end], np.uint32)
        block = first = held = 0
        ids, keys, sizes = [], [], []

        def cut(part: int) -> pa.RecordBatch:
            values = [[part], [block], [first], [held], [keys], [sizes], [pack(np.concatenate(ids))]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        part = None
        for batch in batches:
            for key, text, part in zip(*batch.columns, strict=True):
                ids += tool.encode_to_numpy(text.as_py(), allowed_special="all"), last
                keys.append(key.as_py())
                sizes.append(len(ids[-2]) + 1)
                held += sizes[-1]
                if held >= block_ids:
                    yield cut(part.as_py())
                    block, first, held = block + 1, first + held, 0
                    ids, keys, sizes = [], [], []
        if ids:
            yield cut(part.as_py())

    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))
    rows.mapInArrow(tidy(run), schema).write.parquet(f"{path}/blocks")
    # One row per task of the write above, whatever the input.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = docs.sparkSession.read.schema(schema).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.parquet(f"{path}/parts")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the ids of all documents before them."""
    parts = spark.read.parquet(f"{path}/parts")  # one row per task that wrote the folder
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(parts), "part")
    return blocks.withColumn("start", F.col("before") + F.col("first"))


def _read_documents(spark: SparkSession, path: str, name: str, kind: T.DataType, value: Callable) -> DataFrame:
    """(doc_id, start, n_tokens) and a value made of each document's ids as little-endian 32-bit numbers."""
    ship(spark)
    blocks = _blocks(spark, path).select("start", "doc_ids", "sizes", "levels")
    key = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("doc_id", key), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField(name, kind)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                start, keys, sizes, levels = (c[i] for c in batch.columns)
                sizes = np.asarray(sizes.values)
                raw = memoryview(unpack(levels.as_py()).astype("<u4").tobytes())
                ends = sizes.cumsum()
                values = [keys.values, start.as_py() + ends - sizes, sizes, [
                    value(raw[4 * a:4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)
    return blocks.mapInArrow(tidy(run), schema)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a token folder.

    ``start`` counts the ids of all documents before it, ``n_tokens`` its own with the end
    id; ``ids`` are these as little-endian 32-bit numbers in one binary value.
    """
    return _read_documents(spark, path, "ids", T.BinaryType(), lambda raw: raw)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, crc32) of every document: as ``documents``, the ids as their checksum."""
    return _read_documents(spark, path, "crc32", T.LongType(), zlib.crc32)


def tokens_at(positions: DataFrame, path: str, position: str = "position") -> DataFrame:
    """Add ``id``, the token at each position among all ids of a token folder.

    A null position, or one beyond the last id, has a null id; a taken name gets an
    underscore.  Positions meet their block through cells of ``BLOCK`` positions; a block's
    different positions, which are no more than its ids, are looked up together.
    """
    spark = positions.sparkSession
    ship(spark)
    name = fresh(positions, "id")
    blocks = _blocks(spark, path)
    cells = blocks.select("part", "block", "start", "n_ids", F.explode(F.sequence(
        F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("n_ids") - 1) / BLOCK))).alias("cell"))
    wanted = positions.select(F.col(position).cast("long").alias("place")).where("place >= 0").distinct()
    wanted = wanted.withColumn("cell", F.floor(F.col("place") / BLOCK)).join(cells, "cell")
    wanted = wanted.withColumn("inside", F.col("place") - F.col("start")).where("inside between 0 and n_ids - 1")
    wanted = wanted.groupBy("part", "block").agg(F.collect_list("inside").alias("inside"))
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField(name, T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                start, inside, levels = (c[i] for c in batch.columns)
                inside = np.asarray(inside.values)
                values = [start.as_py() + inside, at(levels.as_py(), inside)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    found = blocks.join(wanted, ["part", "block"]).select("start", "inside", "levels").mapInArrow(tidy(run), schema)
    return positions.join(found, positions[position].cast("long") == found["place"], "left").drop("place")
