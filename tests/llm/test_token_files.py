"""Operator 12: exact round trips, and random access against the library's ids."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forecourt.llm import token_files
from forecourt.llm.queries import byte_bpe, op12_token_files

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(byte_bpe())


def brute(library, rows):
    """(doc_id, start, n_tokens, ids) by ascending id, rows of equal ids in any order."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


numbers = st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1), st.sampled_from([255, 256, 65535, 65536, 2**24]))


@settings(max_examples=200, deadline=None)
@given(st.lists(numbers, max_size=2000), st.integers(1, 40))
def test_codes_round_trip_and_random_access(ids, repeat):
    ids = np.array(ids * repeat, np.uint32)
    levels = token_files.pack(ids)
    assert (token_files.unpack(levels) == ids).all()
    places = np.random.default_rng(0).permutation(len(ids))
    assert (token_files.at(levels, places) == ids[places]).all()
    assert len(levels) == max(1, -(-int(ids.max(initial=0)).bit_length() // 8))


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(" \n\t\xa0'sa1é<|>", max_size=60), st.sampled_from(
    ["a" * 5000, " " * 3000, "\n" * 3000 + "x", "=" * 2000, "<|endoftext|>" * 3 + " <|endoftext", "漢字" * 900])))
def test_ids_are_those_of_the_library(library, text):
    got = token_files.tokenizer(byte_bpe()).encode_to_numpy(text, allowed_special="all").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


def test_the_files_hold_every_text_in_order(spark, library, tmp_path):
    rows = [(i * 7919 % 10_000 - 500, f"document {i} <|endoftext|> naïve \U0001f600 " * (i % 13)) for i in range(3000)]
    rows += [(20_000, None), (20_001, ""), (20_002, "word " * 20_000), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "tokens")
    token_files.write(docs, path, byte_bpe(), block_ids=2000)
    got = sorted((tuple(r) for r in token_files.documents(spark, path).collect()), key=lambda r: r[1])
    want = brute(library, rows)
    assert [(a, b, c, bytes(d)) for a, b, c, d in got] == want
    sums = {tuple(r) for r in token_files.checksums(spark, path).collect()}
    assert sums == {(a, b, c, zlib.crc32(d)) for a, b, c, d in want}
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() > 10 and blocks.agg(F.sum("n_ids")).first()[0] == sum(r[2] for r in want)

    every = np.frombuffer(b"".join(r[3] for r in want), "<u4")
    places = [*np.random.default_rng(1).integers(0, len(every), 500).tolist(), 0, len(every) - 1, 5, 5, 5]
    asked = spark.createDataFrame([(p, "x") for p in [*places, None, -1, len(every)]], "position long, id string")
    found = token_files.tokens_at(asked, path).collect()
    assert found[0].asDict().keys() == {"position", "id", "id_"} and len(found) == len(places) + 3
    assert {(r["position"], r["id_"]) for r in found} == {(p, int(every[p])) for p in places} | {
        (None, None), (-1, None), (len(every), None)}


def test_equal_ids_other_names_and_text_ids(spark, library, tmp_path):
    """Rows of one id follow each other in the same order however the rows are dealt."""
    rows = [("k", f"text {i % 40}", i) for i in range(400)] + [("a", None, 1), ("z", "", 2)]
    docs = spark.createDataFrame(rows, "name string, body string, part int")
    seen = []
    for n in (1, 7):
        path = str(tmp_path / f"{n}")
        token_files.write(docs.repartition(n), path, byte_bpe(), doc_id="name", text="body", end=50256)
        out = sorted((tuple(r) for r in token_files.documents(spark, path).collect()), key=lambda r: r[1])
        seen.append([(k, s, n, bytes(b)) for k, s, n, b in out])
    assert seen[0] == seen[1] and [r[0] for r in seen[0]] == ["a"] + ["k"] * 400 + ["z"]
    own = np.frombuffer(seen[0][-2][3], "<u4").tolist()
    assert own[-1] == 50256 and library.decode(own[:-1]).startswith("text ")


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path, byte_bpe())
    assert token_files.documents(spark, path).collect() == []
    assert token_files.tokens_at(spark.range(2), path, "id").collect() == [(0, None), (1, None)]


def test_the_query_equals_the_library(spark, sf, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op12_token_files(spark, sf).collect())
    assert got == [(a, b, c, zlib.crc32(d)) for a, b, c, d in brute(library, rows)]
