"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from forecourt.llm import mixing, toxicity
from forecourt.llm.queries import ORACLE, QUERIES
from tools.check_oracle import canonical

CONTRACT = {
    "op2": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3": ["doc_id", "size", "source_size", "target", "taken"],
    "op4": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op5": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
            "near_next"],
    "op7": ["query_id", "rank", "vec_id", "score"],
    "op8": ["doc_id", "fingerprint", "component_id"],
    "op10": ["doc_id", "held_out", "lang_pred", "score"],
    "op11": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op13": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
}


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    columns = CONTRACT.get(name.split("_")[0], ["doc_id"])
    assert df.columns[:len(columns)] == columns
    if name in ORACLE:
        con = duckdb.connect()
        for table in ("embeddings", "documents"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        res = con.execute(ORACLE[name])
        names = [c[0] for c in res.description]
        assert canonical(df.columns, [tuple(r) for r in rows]) == canonical(names, res.fetchall())
    else:
        ids = [r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        assert sorted(r["doc_id"] for r in rows) == sorted(ids)


@pytest.mark.parametrize("name", ["op3_source_mix", "op6_fingerprints"])
def test_native_operators_run_no_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, counts = docs.columns, [docs.count()]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "toxicity":
            found = toxicity.toxicity(before, toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet")))
            assert {r[0] for r in found.where("predicted = 0").select("doc_id").collect()} == {
                r[0] for r in docs.select("doc_id").collect()}
        if name == "source_mix":
            taken = {r["doc_id"]: r["taken"] for r in mixing.takings(before).collect()}
            words = {}
            for r in docs.collect():
                words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
                assert text[r["doc_id"]].startswith(r["text"])
            assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] > counts[3] and counts[4] == counts[5]
    assert docs.where("size(ids) > 0").count() > 0


def test_pipeline_of_nothing(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0
