"""Tables whose extra columns have the names that the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from forecourt.llm import language, lmscore, mixing, quality, simhash, sketches

EXTRA = ["target", "part", "cut", "whole", "first", "second", "last", "entire", "source_size", "number", "cell",
         "component_id", "fingerprint", "_print", "_row", "row", "id", "place", "score", "label", "gram", "losses", "words", "shard"]


@pytest.fixture
def crowded(spark):
    texts = ["the quick brown fox jumps over it", "the quick brown fox jumps over it", "", None, "el zorro salta sobre todo",
             "  ", "word " * 400]
    rows = [(i, t, "en" if i < 4 else "es", f"s{i % 3}" if i else None, *(f"{c}{i}" for c in EXTRA))
            for i, t in enumerate(texts * 3)]
    columns = ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {columns}")


def same_rows(found, docs):
    assert found.columns[:len(docs.columns)] == docs.columns
    given = {r["doc_id"]: r for r in docs.collect()}
    rows = found.collect()
    for r in rows:
        assert all(r[c] == given[r["doc_id"]][c] for c in EXTRA)
    return rows


def test_mix(crowded):
    plain = mixing.mix(crowded.select("doc_id", "text", "source")).groupBy("doc_id", "text").count().collect()
    rows = same_rows(mixing.mix(crowded, shard="shard_no"), crowded)
    assert sum(r["count"] for r in plain) == len(rows) > 0
    assert {(r["doc_id"], r["text"]) for r in plain} == {(r["doc_id"], r["text"]) for r in rows}


def test_one_of_each_and_near_duplicates(crowded):
    plain = simhash.one_of_each(crowded.select("doc_id", "text"))
    rows = same_rows(simhash.one_of_each(crowded), crowded)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain.collect()) == [0, 2, 4, 6]
    found = simhash.near_duplicates(crowded, keep=["doc_id", "fingerprint", "component_id"])
    assert found.columns == ["doc_id", "fingerprint", "component_id", "fingerprint_", "component_id_"]
    assert {r["component_id_"] for r in found.collect()} == {0, 2, 4, 6}


def test_scores(crowded, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(21)], "doc_id long, quality int, toxic int")
    losses = lmscore.fit(crowded, crowded.where("doc_id % 2 = 0"))
    assert lmscore.cross_entropy_difference(crowded, losses).count() == 21
    found = language.languages(crowded, language.fit(crowded))
    same_rows(found, crowded)
    evidence = quality.fit(crowded, labels)
    assert quality.quality(crowded, labels, evidence, F.col("source"), F.col("lang")).count() == 21


def test_next_row_needs_whole_numbers(spark):
    docs = spark.createDataFrame([("d0", "a"), ("d1", "b")], "doc_id string, text string")
    with pytest.raises(ValueError, match="whole numbers"):
        sketches.with_next(docs, "doc_id", "text", "text")
