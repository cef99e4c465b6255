"""Keywords, n-grams and key phrases.

Term counts need no shuffle by document: each row emits its terms once per
occurrence and once per distinct term, and one hash aggregation by term yields
frequency and document frequency together.  What crosses the network is the
vocabulary, pre-aggregated per task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from forecourt import lexicon as lx
from forecourt.functions import text as tx
from forecourt.functions.text import let
from forecourt.operators.ranking import top_per_group
from forecourt.session import explode_once, send_code, stage, tidy

SLOT_BITS = 24
PIECE_TOKENS, BLOCK_TOKENS = 1 << 20, 1 << 19
FIRST_WORDS, MOST_WORDS = 1_000, 20_000
FIRST_TERMS = 20_000


def top_keywords(
    df: DataFrame, k: int = 12, text: str = "text", by: str = "sentiment",
    stop_words: list[str] | None = None,
) -> DataFrame:
    """The k most frequent keywords per group."""
    stop = lx.DEFAULT.keyword_stop_words if stop_words is None else stop_words
    rows = explode_once(
        df.where(F.col(by).isNotNull()), [by], tx.keyword_tokens(F.col(text)), "term"
    )
    counts = rows.where(~F.col("term").isin(stop)).groupBy(by, "term").agg(
        F.count("*").alias("n")
    )
    return top_per_group(counts, by, "n", "term", k)


def term_stats(df: DataFrame, terms: Column, by: list[str] | None = None) -> DataFrame:
    """Frequency and document frequency of each term, per group if asked."""
    by = by or []

    def marks(ts: Column) -> Column:
        def mark(source: Column, tf: int, df_: int) -> Column:
            return F.transform(source, lambda t: F.struct(
                t.alias("term"), F.lit(tf).alias("tf"), F.lit(df_).alias("df")))
        return F.concat(mark(ts, 1, 0), mark(F.array_distinct(ts), 0, 1))

    rows = explode_once(df, by, let(terms, marks), "m").select(*by, "m.*")
    return rows.groupBy(*by, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary(
    stats: DataFrame, max_features: int | None = None, min_df: int = 2,
    max_df: Column | int | None = None,
) -> DataFrame:
    """Terms within the document-frequency bounds; with a limit, the most frequent ones."""
    kept = stats.where(F.col("df") >= min_df)
    if max_df is not None:
        kept = kept.where(F.col("df") <= max_df)
    return kept if max_features is None else kept.orderBy(F.desc("tf"), "term").limit(max_features)


def top_ngrams(
    df: DataFrame, n: int = 2, top_k: int = 15, text: str = "text",
    stop_words: list[str] | None = None, min_df: int = 2,
) -> DataFrame:
    """The most frequent n-grams; stop words go before the grams form.

    Single words and bigrams are counted from tokens that are written once; of bigrams only those
    of words as frequent as the answer's last, unless these are too many (``likely_bigrams``).
    """
    tokens = tx.word_tokens(F.col(text), stop_words)
    if n > 2:
        stats = term_stats(df, tx.ngrams(tokens, n))
    else:
        docs = stage(df.select(tokens.alias("tokens")), "tokens")
        stats = word_stats(docs) if n == 1 else likely_bigrams(docs, top_k, min_df)
    return vocabulary(stats, top_k, min_df).select("term", F.col("tf").alias("n"))


def _summaries(docs: DataFrame, tokens: Column, n: int, size: int) -> DataFrame:
    """(term, low, lost): per task the counts of its most frequent n-grams and how much any count may lack.

    A task keeps twice ``size`` counters at most.  When there are more, the largest one that has to go is
    taken off all of them, so ``lost`` is at most the task's n-grams / ``size``; it stands on a row
    without a term.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        lost = 0
        for batch in batches:
            for ts in batch.column(0).to_pylist():
                ts = ts or []
                counts.update(map(" ".join, zip(*(ts[i:] for i in range(n)), strict=False)) if n > 1 else ts)
                if len(counts) > 2 * size:
                    off = sorted(counts.values(), reverse=True)[size]
                    counts = Counter({t: c - off for t, c in counts.items() if c > off})
                    lost += off
        yield pa.RecordBatch.from_arrays(
            [pa.array([*counts, None], pa.string()), pa.array([*counts.values(), 0], pa.int64()),
             pa.array([0] * len(counts) + [lost], pa.int64())], ["term", "low", "lost"])
    return docs.select(tokens.alias("ts")).mapInArrow(run, "term string, low long, lost long")


def heavy_ngrams(
    df: DataFrame, n: int = 2, top_k: int = 15, text: str = "text",
    stop_words: list[str] | None = None, min_df: int = 2, size: int = 50_000,
) -> DataFrame:
    """``top_ngrams`` without a shuffle of the vocabulary, where the vocabulary is skewed enough.

    The tasks' summaries add up to a lower bound of each count, which no count exceeds by more than
    the sum of what they lost.  N-grams whose upper bound reaches the k-th lower bound are counted
    exactly in a second pass.  If the k-th of these counts is above what any other n-gram can
    have, they are the answer, else (a flat vocabulary) everything is counted as ``top_ngrams`` does.
    """
    docs = stage(df.select(tx.word_tokens(F.col(text), stop_words).alias("tokens")), "tokens")
    tokens = F.col("tokens")
    found = stage(_summaries(docs, tokens, n, size), "summaries")  # at most 2 * size rows a task
    lost = found.agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]
    lows = found.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("low").alias("low"))
    # Some of the first may fall to the document frequency, so the bound is taken further down.
    first = lows.orderBy(F.desc("low")).limit(2 * top_k).agg(F.min("low"), F.count("*")).first()
    bound = 0 if lost == 0 and first[1] < 2 * top_k else first[0] or 0
    if lost == 0 or bound > lost:
        likely = lows.where(F.col("low") + lost >= bound).select("term")
        grams = explode_once(docs.select(F.monotonically_increasing_id().alias("doc"), tx.ngrams(tokens, n).alias("ts")),
                             ["doc"], F.col("ts"), "term")
        counted = grams.join(likely, "term").groupBy("term", "doc").agg(F.count("*").alias("m")).groupBy("term").agg(
            F.sum("m").alias("n"), F.count("*").alias("df")).where(F.col("df") >= min_df)
        top = stage(counted.orderBy(F.desc("n"), "term").limit(top_k).select("term", "n"), "heavy")
        least, rows = top.agg(F.min("n"), F.count("*")).first()
        if bound == 0 or (rows == top_k and least > max(lost, bound - 1)):
            return top.orderBy(F.desc("n"), "term")
    return top_ngrams(df, n, top_k, text, stop_words, min_df)


def phrase_terms(text: Column, stand_in: str, stop_words: list[str] | None = None) -> Column:
    """Unigrams and bigrams of the mining tokens."""
    tokens = tx.fill_empty(tx.tokenize(text, stop_words), stand_in)
    return let(tokens, lambda ts: F.concat(ts, tx.ngrams(ts, 2)))


def _pieces(batch: pa.RecordBatch, limit: int = PIECE_TOKENS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """(rows, each token's row among them, tokens) of a batch whose last column are tokens, some rows at a time."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy())])
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, side="right")) - 1)
        rows = batch.slice(i, j - i)
        yield rows, np.repeat(np.arange(j - i), np.diff(ends[i:j + 1])), rows.column(rows.num_columns - 1).flatten()
        i = j


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in ascending order and how often each comes; by sorting, which is quicker here than hashing."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))
    return x[at], np.diff(np.append(at, len(x)))


def word_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, tf, df) of every token; the rows are counted in pieces, whose sums are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, words in _pieces(batch):
                found = words.dictionary_encode()
                code, n = found.indices.to_numpy(), len(found.dictionary)
                of_rows = _distinct(row * n + code)[0] % max(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [found.dictionary, pa.array(np.bincount(code, minlength=n)), pa.array(np.bincount(of_rows, minlength=n))],
                    ["term", "tf", "df"])
    send_code(docs.sparkSession)
    sums = docs.select(tokens).mapInArrow(run, "term string, tf long, df long")
    return sums.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def coded_terms(docs: DataFrame, words: list[str], keep: dict[int, int] | None = None, tokens: str = "tokens") -> DataFrame:
    """Other columns and ``terms``, ``counts``: which of the words, and which pairs of them side by side, a row has.

    The code of the i-th word is i, that of the pair i, j is (i + 1) * len(words) + j.  With ``keep``
    only its codes count, under the numbers that it gives them.
    """
    others = [c for c in docs.columns if c != tokens]
    width, known = len(words), pa.array(words, pa.string())
    codes = np.array(sorted(keep or ()), np.int64)
    places = np.array([(keep or {})[c] for c in codes.tolist()], np.int64)
    span = width * (width + 1) if keep is None else int(places.max(initial=0)) + 1
    schema = T.StructType([*docs.select(others).schema.fields, T.StructField("terms", T.ArrayType(T.LongType())),
                           T.StructField("counts", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, row, ts in _pieces(batch):
                at = pc.fill_null(pc.index_in(ts, known), -1).to_numpy().astype(np.int64)
                pair = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & (row[:-1] == row[1:]))
                own = np.flatnonzero(at >= 0)
                row = np.concatenate([row[own], row[pair]])
                code = np.concatenate([at[own], (at[pair] + 1) * width + at[pair + 1]])
                if keep is not None:
                    i = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
                    kept = np.flatnonzero(codes[i] == code) if len(codes) else i[:0]
                    row, code = row[kept], places[i[kept]]
                found, counts = _distinct(row * span + code)
                ends = pa.array(np.searchsorted(found, np.arange(len(rows) + 1) * span).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(found % span)),
                         pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], *(x.cast(f.type) for x, f in zip(lists, list(arrow)[-2:], strict=True))], schema=arrow)
    send_code(docs.sparkSession)
    return docs.select(*others, tokens).mapInArrow(run, schema)


def pair_stats(docs: DataFrame, names: list[str], tokens: str = "tokens") -> DataFrame:
    """(term, tf, df) of every bigram of two of the words."""
    width = len(names)
    pairs = explode_once(coded_terms(docs.select(tokens), names), [], F.arrays_zip("terms", "counts"), "m").where(
        F.col("m.terms") >= width).groupBy(F.col("m.terms").alias("code")).agg(
        F.sum("m.counts").alias("tf"), F.count("*").alias("df"))
    # As an Arrow table, which no Python worker has to make rows of.
    named = docs.sparkSession.createDataFrame(pa.table({"i": pa.array(range(width), pa.int64()), "term": pa.array(names, pa.string())}))
    one, two = (named.select(F.col("i").alias(c), F.col("term").alias(f"{c}_word")) for c in ("a", "b"))
    return pairs.withColumns({"a": F.expr(f"code div {max(width, 1)} - 1"), "b": F.col("code") % max(width, 1)}).join(
        one, "a").join(two, "b").select(F.concat_ws(" ", "a_word", "b_word").alias("term"), "tf", "df")


def likely_bigrams(
    docs: DataFrame, top_k: int, min_df: int = 2, first_words: int = FIRST_WORDS, most_words: int = MOST_WORDS,
    tokens: str = "tokens",
) -> DataFrame:
    """(term, tf, df) of bigrams, among them the ``top_k`` most frequent ones in ``min_df`` rows.

    The bigrams of the most frequent words give a bound that the k-th reaches.  A bigram is no more
    frequent than its words, so only words as frequent as the bound can be in the answer, and their
    pairs are counted; all bigrams are where these are more than ``most_words`` (a flat vocabulary).
    """
    words = stage(word_stats(docs, tokens).where(F.col("df") >= min_df), "word-stats")
    first = words.orderBy(F.desc("tf"), "term").limit(first_words).collect()
    found = stage(pair_stats(docs, [r["term"] for r in first], tokens), "pair-stats")
    bound = vocabulary(found, top_k, min_df).agg(F.min("tf"), F.count("*")).first()
    likely = words.where(F.col("tf") >= (bound[0] if bound[1] == top_k else 1))
    n = likely.count()
    if n <= len(first):  # a part of the first words, which come in the same order
        return found
    if n <= max(most_words, first_words):
        return pair_stats(docs, [r["term"] for r in likely.select("term").collect()], tokens)
    return term_stats(docs, tx.ngrams(F.col(tokens), 2))


def frequent_phrases(
    docs: DataFrame, max_features: int, min_df: int = 2, max_df: float | None = None, tokens: str = "tokens",
    most_words: int = MOST_WORDS,
) -> tuple[list[str], list[float]]:
    """The most frequent unigrams and bigrams of all rows and their frequencies, as ``vocabulary`` has them.

    A bigram is no more frequent than its words.  So every term that can be among the first is made of words
    as frequent as the last of the first words, and only their pairs are counted.  Where more than
    ``most_words`` words are as frequent as that (a flat vocabulary) all bigrams are.
    """
    words = stage(word_stats(docs, tokens), "word-stats")
    first = vocabulary(words, max_features, min_df, max_df).agg(F.min("tf"), F.count("*")).first()
    least = first[0] if first[1] == max_features else 1
    likely = words.where((F.col("tf") >= least) & (F.col("df") >= min_df))
    if likely.count() > max(most_words, 2 * max_features):
        every = term_stats(docs, let(F.col(tokens), lambda ts: F.concat(ts, tx.ngrams(ts, 2))))
        found = vocabulary(every, max_features, min_df, max_df).collect()
    else:
        names = [r["term"] for r in likely.select("term").collect()]
        bigrams = pair_stats(docs, names, tokens).where(F.col("tf") >= least)
        found = vocabulary(likely.unionByName(bigrams), max_features, min_df, max_df).collect()
    return [r["term"] for r in found], [float(r["tf"]) for r in found]


def phrase_counts(tokens: Column, stop_words: list[str] | None = None) -> Column:
    """array<struct<term, n>>: how often each unigram and bigram of an array of tokens occurs."""
    stop = pa.array(stop_words or [], pa.string())

    def of_piece(rows: int, row: np.ndarray, words: pa.Array) -> pa.ListArray:
        """The lists of some rows, counted by the numbers of words and of neighbours and named at the end."""
        found = words.dictionary_encode()
        code, n = found.indices.to_numpy().astype(np.int64), max(len(found.dictionary), 1)
        pair = np.flatnonzero(row[1:] == row[:-1])
        own, times = _distinct(row * n + code)
        pairs, pair_times = _distinct((row[pair] * n + code[pair]) * n + code[pair + 1])
        bigrams = pc.binary_join_element_wise(found.dictionary.take(pairs // n % n), found.dictionary.take(pairs % n), " ")
        names = pa.concat_arrays([found.dictionary.take(own % n), bigrams])
        of_row = np.concatenate([own // n, pairs // (n * n)])
        order = np.argsort(of_row, kind="stable")
        order = order[~pc.is_in(names, stop).to_numpy(zero_copy_only=False)[order]]
        counts = np.concatenate([times, pair_times])[order]
        items = pa.StructArray.from_arrays([names.take(order), pa.array(counts.astype(np.int32))], ["term", "n"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(of_row[order], minlength=rows))])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lists = [of_piece(len(rows), row, words) for rows, row, words in _pieces(pa.RecordBatch.from_arrays([batch], ["ts"]))]
            yield pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())])))
    count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(count, "array<struct<term:string,n:int>>")(tokens)


def repeated_slots(terms: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """(word, ones): a table of 2^bits slots, of which those are set that two rows' terms fall in.

    Of distinct terms per document these are the terms that may occur in two documents: none
    that does is missing, and one that does not is among them only where it shares a slot.
    A word holds 32 slots, so the table has at most 2^(bits - 5) rows, whatever the corpus.
    """
    slots = terms.groupBy(_slot("term", bits).alias("slot")).agg(F.count("*").alias("n")).where("n > 1")
    return slots.groupBy(F.shiftright("slot", 5).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(31)).cast("int"))).alias("ones"))


def _slot(term: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(1 << bits))


def maybe_repeated(terms: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """The rows whose term may be in two of them; the rest, each alone, need not be shuffled."""
    slots = F.broadcast(repeated_slots(terms, bits))  # at most 2^(bits - 5) rows of 16 bytes
    marked = terms.withColumn("_slot", _slot("term", bits))
    hit = F.expr("shiftrightunsigned(ones, cast(_slot & 31 as int)) & 1") == 1
    return marked.join(slots, F.shiftright("_slot", 5) == F.col("word")).where(hit).drop("_slot", "word", "ones")


def _word_codes(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words, the most frequent first, and the number of each token among them."""
    found = tokens.dictionary_encode()
    code = found.indices.to_numpy()
    order = np.argsort(-np.bincount(code, minlength=len(found.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found.dictionary.take(order), rank[code]


def _packed_block(words: pa.Array, code: np.ndarray, lengths: np.ndarray) -> bytes:
    """Coded tokens in few bytes: the numbers are mostly small, so equal bytes of all of them lie together."""
    zstd = pa.Codec("zstd")
    parts = ["\n".join(words.to_pylist()).encode(), np.ascontiguousarray(code.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(),
             lengths.astype("<u4").tobytes()]
    batch = pa.RecordBatch.from_arrays([pa.array(map(len, parts), pa.int64()), pa.array(
        [zstd.compress(x, asbytes=True) for x in parts], pa.binary())], ["size", "part"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked_block(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    zstd, batch = pa.Codec("zstd"), pa.ipc.open_stream(data).read_next_batch()
    words, code, lengths = (zstd.decompress(x.as_py(), n.as_py()).to_pybytes() for n, x in zip(*batch.columns, strict=True))
    code = np.ascontiguousarray(np.frombuffer(code, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return (pa.array(words.decode().split("\n") if words else [], pa.string()), code.astype(np.int64),
            np.frombuffer(lengths, "<u4").astype(np.int64))


class _Terms:
    """Unigrams and bigrams of some rows of coded tokens, without stop words, by slot.

    A unigram i has the key i * (words + 1), a bigram i, j the key i * (words + 1) + j + 1.  The slot comes from
    the words alone, so a term has the same in every block.
    """

    def __init__(self, words: pa.Array, code: np.ndarray, row: np.ndarray, stop: list[str], slots: int):
        self.words, self.width = words, len(words) + 1
        pair = np.flatnonzero(row[1:] == row[:-1])
        keys = np.concatenate([code * self.width, code[pair] * self.width + code[pair + 1] + 1])
        own = ~np.isin(keys, self._stop_keys(stop))
        row = np.concatenate([row, row[pair]])[own]
        keys, of = np.unique(keys[own], return_inverse=True)
        del own, pair
        value = np.array([zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()], np.uint64)
        mixed = (value[keys // self.width] * _MIX + np.append(np.uint64(0), value + np.uint64(1))[keys % self.width]) * _MIX
        slot = ((mixed ^ mixed >> np.uint64(29)) * _MIX >> np.uint64(33)) % np.uint64(slots)
        order = np.argsort(slot, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys = keys[order]
        self.ends = np.searchsorted(slot[order], np.arange(slots + 1, dtype=np.uint64))
        n = max(len(keys), 1)
        pairs, self.times = _distinct(row * n + place[of])
        self.row, self.term = pairs // n, pairs % n  # each term of a row once, with its times

    def _stop_keys(self, stop: list[str]) -> np.ndarray:
        parts = [(x.split(" ") + [None])[:2] for x in stop if x.count(" ") < 2]
        one, two = (pc.fill_null(pc.index_in(pa.array([x[i] for x in parts], pa.string()), self.words), -1).to_numpy().astype(np.int64)
                    for i in (0, 1))
        pair = np.array([x[1] is not None for x in parts], bool)
        return (one * self.width + np.where(pair, two + 1, 0))[(one >= 0) & (~pair | (two >= 0))]

    def names(self, which: np.ndarray | slice = slice(None)) -> pa.Array:
        """The terms themselves, in the order of the slots."""
        keys = self.keys[which]
        tails = pa.concat_arrays([pa.array([""]), pc.binary_join_element_wise("", self.words, " ")])
        return pc.binary_join_element_wise(self.words.take(keys // self.width), tails.take(keys % self.width), "")


def _spread_terms(slots: int, stop: list[str]):
    """Rows of tokens as blocks: one row with a block's coded tokens, and one for each slot that has terms of it.

    The latter hold the slot's terms, packed, and in how many rows of the block each is.  The row with the tokens
    has a negative slot of its own, so it goes to any task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        zstd = pa.Codec("zstd")

        def packed(x: bytes) -> bytes:
            return zstd.compress(x, asbytes=True)
        for batch in batches:
            for rows, row, tokens in _pieces(batch, BLOCK_TOKENS):
                words, code = _word_codes(tokens)
                tokens_of = _packed_block(words, code, np.bincount(row, minlength=len(rows)))
                terms = _Terms(words, code, row, stop, slots)
                df = np.bincount(terms.term, minlength=len(terms.keys)).astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(terms.ends.astype(np.int32)), terms.names()), "\n")
                own = np.flatnonzero(np.diff(terms.ends))
                texts = joined.take(own).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own) + 1, block)), pa.array(np.append(-1 - block, own)),
                    pa.array(np.append(len(rows), np.diff(terms.ends)[own]).astype(np.int32)),
                    pa.array([0, *map(len, texts)], pa.int32()), pa.array([tokens_of, *map(packed, texts)], pa.binary()),
                    pa.array([None, *(packed(df[terms.ends[i]:terms.ends[i + 1]].tobytes()) for i in own)], pa.binary())],
                    [n.split()[0] for n in _SPREAD.split(", ")])
                block += 1
    return run


_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = "block long, slot long, n int, size int, data binary, df binary"
_MET = "block long, slot long, n int, size int, data binary"


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[dict]]:
    """Rows that follow each other with equal values in a column, a list for each value."""
    own: list[dict] = []
    for batch in batches:
        name = batch.schema.names[column]
        for i in range(len(batch)):
            row = {c: x[i].as_py() for c, x in zip(batch.schema.names, batch.columns, strict=True)}
            if own and own[0][name] != row[name]:
                yield own
                own = []
            own.append(row)
    if own:
        yield own


def _count_slots(min_df: int, most: int):
    """The spread rows of each slot answered: for every block the document frequencies of its terms, 0 below ``min_df``.

    A row without block holds a slot's largest frequencies, ``most`` at most.  Rows with a block's tokens stay as they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, names = pa.Codec("zstd"), [n.split()[0] for n in _MET.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for rows in _groups(batches, 1):
            slot = rows[0]["slot"]
            if slot < 0:
                yield made([tuple(r[c] for c in names) for r in rows])
                continue
            texts = pa.array([zstd.decompress(r["data"], r["size"]).to_pybytes() for r in rows], pa.large_binary()).cast(pa.large_string())
            terms = pc.split_pattern(texts, "\n").flatten().dictionary_encode()
            of = terms.indices.to_numpy()
            own = np.concatenate([np.frombuffer(zstd.decompress(r["df"], 4 * r["n"]), np.int32) for r in rows])
            df = np.bincount(of, own, len(terms.dictionary)).astype(np.int64)
            df[df < min_df] = 0
            kind = np.int32 if df.max() < 1 << 31 else np.int64
            ends = np.cumsum([0] + [r["n"] for r in rows])
            answers = [df[of[i:j]].astype(kind).tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            first = np.sort(df)[::-1][:most].tobytes()
            yield made([(r["block"], slot, r["n"], len(x), zstd.compress(x, asbytes=True)) for r, x in zip(rows, answers, strict=True)]
                       + [(None, slot, 0, len(first), first)])
    return run


def _block_scores(slots: int, stop: list[str], n_docs: int, least: int, known: list[str] | None):
    """(term, score): of each block's rows and their answers the sums of TF-IDF weights in unit vectors.

    Every term with a frequency is in the vectors (of ``known`` ones, where these are stated); returned are
    those in ``least`` documents or more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd")
        for rows in _groups(batches, 0):
            words, code, lengths = _unpacked_block(rows[0]["data"])
            terms = _Terms(words, code, np.repeat(np.arange(len(lengths)), lengths), stop, slots)
            found = [np.frombuffer(zstd.decompress(r["data"], r["size"]), np.int32 if r["size"] == 4 * r["n"] else np.int64)
                     for r in rows[1:]]
            df = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
            if known is not None:
                df[~pc.is_in(terms.names(), pa.array(known, pa.string())).to_numpy(zero_copy_only=False)] = 0
            idf = np.where(df > 0, np.log((1.0 + n_docs) / (1.0 + df)) + 1.0, 0.0)
            w = terms.times * idf[terms.term]
            norm = np.sqrt(np.bincount(terms.row, w * w, len(lengths)))
            norm[norm == 0] = 1.0
            sums = np.bincount(terms.term, w / norm[terms.row], len(df))
            own = np.flatnonzero((df > 0) & (df >= least))
            yield pa.RecordBatch.from_arrays([terms.names(own), pa.array(sums[own], pa.float64())], ["term", "score"])
    return run


def keyphrases(
    df: DataFrame, key: str, top_k: int = 20, text: str = "text", max_features: int | None = None,
    min_df: int = 2, stop_words: list[str] | None = None,
) -> DataFrame:
    """Terms by mean TF-IDF weight over all documents, each row a document and a unit vector.

    Blocks of about half a million tokens send their different terms, packed, to slots of terms, which count in how
    many documents each is, and meet the answers again beside their coded tokens: each term crosses the network once
    for a block and no row for each document's term exists.  The vocabulary has no bound unless one is stated and never
    reaches the driver.  Every term counts in the norms; a term's score is at most its share of the documents, so first only
    the terms in the most documents are added up, and then those too that this bound cannot rule out.
    """
    stop = lx.DEFAULT.mining_stop_words if stop_words is None else stop_words
    spark = df.sparkSession
    send_code(spark)
    slots = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The stop words apply again to the stand-in document, so it vanishes.
    docs = df.select(tx.fill_empty(tx.tokenize(F.col(text), stop), lx.EMPTY_PHRASE_DOCUMENT).alias("tokens"))
    known = None
    if max_features is not None:
        phrases = sum(" " in x for x in stop)
        docs = stage(docs, "tokens")
        plain = docs.select(F.filter("tokens", lambda w: ~w.isin(stop)).alias("tokens"))
        found = frequent_phrases(plain, max_features + phrases, min_df)[0]
        known = [x for x in found if x not in set(stop)][:max_features]
    spread = docs.mapInArrow(tidy(_spread_terms(slots, stop)), _SPREAD)
    most = max(top_k, -(-4 * FIRST_TERMS // slots))
    met = stage(spread.repartition("slot").sortWithinPartitions("slot").mapInArrow(tidy(_count_slots(min_df, most)), _MET), "term-counts")
    n_docs = met.where("slot < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def scores(least: int) -> DataFrame:
        blocks = met.where(F.col("block").isNotNull()).repartition("block").sortWithinPartitions("block", "slot")
        sums = blocks.mapInArrow(tidy(_block_scores(slots, stop, n_docs, least, known)), "term string, score double")
        return sums.groupBy("term").agg((F.sum("score") / n_docs).alias("score")).orderBy(F.desc("score"), "term").limit(top_k)

    if known is not None:
        return scores(1)
    tops = met.where(F.col("block").isNull()).select("data").toArrow().column(0).to_pylist()
    tops = np.sort(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in tops)]))[::-1]
    least = int(tops[FIRST_TERMS]) if len(tops) > FIRST_TERMS else 1
    if least > min_df:
        top = stage(scores(least), "first-scores")
        lowest, rows = top.agg(F.min("score"), F.count("*")).first()
        if rows == top_k and lowest * n_docs > least - 1:
            return top.orderBy(F.desc("score"), "term")
        least = int(lowest * n_docs * (1 - 1e-9)) if rows == top_k else 1
    return scores(least)


def zone_text_summary(
    df: DataFrame, text: str = "text", k: int = 3, stop_words: list[str] | None = None
) -> DataFrame:
    """Per zone: reviews, negative share and the top words of its negatives."""
    negative = F.col("sentiment") == lx.NEGATIVE
    zoned = df.where(F.col("zone").isNotNull())
    totals = zoned.groupBy("zone").agg(
        F.count("*").alias("total_reviews"),
        F.round(F.count_if(negative) * 100.0 / F.count("*"), 1).alias("negative_pct"),
    )
    stats = term_stats(
        zoned.where(negative), tx.word_tokens(F.col(text), stop_words), ["zone"]
    ).where(F.col("df") >= 2)
    top = top_per_group(stats, "zone", "tf", "term", k)
    words = top.groupBy("zone").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]),
        ", ",
    ).alias("words"))
    return totals.join(words, "zone", "left").select(
        "zone", "total_reviews", "negative_pct",
        F.coalesce("words", F.lit("—")).alias("top_pain_points"),
    )
