"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.catalog.tables import read
from forecourt.functions.text import let
from forecourt.llm import (
    bpe,
    language,
    lmscore,
    merkle,
    mixing,
    periodic,
    quality,
    simhash,
    sketches,
    token_counts,
    token_files,
    topk,
    toxicity,
)
from forecourt.llm.labels import held_out
from forecourt.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, byte_bpe()).drop("text")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, byte_bpe(), limit=1024).drop("text")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    detector = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, detector).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    found = language.languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                        "cosine", "rejected")


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takings(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE["op7_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


@query
def op1_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that are labelled good; background: all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # The labels have no bound, so they are never broadcast, however few they are.
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").hint("merge")
    losses = lmscore.fit(docs, docs.join(good, "doc_id", "left_semi"))
    return lmscore.cross_entropy_difference(docs, losses).drop("text")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents carry no URL: the source stands for the host, the language for the path."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = read(spark, sf_dir, "labels")
    evidence = quality.fit(docs, labels)
    return quality.quality(docs, labels, evidence, F.col("source"), F.col("lang")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence",
        "host_prior", "path_prior")


def _with_repeats(doc_id: Column, text: Column) -> Column:
    """The text, but in a tenth of the documents its words from some place on repeat in a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic_from(words: Column) -> Column:
        n = F.size(words)
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(
            words, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))
        return F.when(n > 0, F.array_join(again, " ")).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(h % 10 == 0, let(words, periodic_from)).otherwise(text)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", _with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = periodic.periodic_runs(docs).withColumn("longest", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "token-files")
    token_files.write(read(spark, sf_dir, "documents").select("doc_id", "text"), path, byte_bpe(), end=0)
    return token_files.checksums(spark, path).withColumnRenamed("crc32", "ids_crc32")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = read(spark, sf_dir, "documents").select(*columns)
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = merkle.leaf(*(lowered if c == "text" else F.col(c) for c in columns))
    path = work_dir(spark, "merkle")
    merkle.write(docs.withColumn("tampered", F.when(changed, tampered)), path, columns, "source",
                 carry=["tampered"])
    folded = merkle.folded(F.coalesce("carried.tampered", "leaf"), F.col("steps"))
    return merkle.proofs(spark, path).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.siblings(F.col("steps")).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, key: str, levels: int) -> str:
    """CTEs of a tree over ``name``_0 (key, pos, total, h), 16 nodes to one, and of every node's siblings."""
    out = ""
    for k in range(levels):
        whole = f"PARTITION BY {key}, pos // 16 ORDER BY pos ROWS BETWEEN"
        out += f"""
{name}_s{k} AS MATERIALIZED (SELECT {key}, pos, total, CASE WHEN total > 1 THEN coalesce(string_agg(h, '') OVER (
    {whole} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS lh, CASE WHEN total > 1 THEN coalesce(string_agg(h, '') OVER (
    {whole} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS rh FROM {name}_{k}),
{name}_{k + 1} AS MATERIALIZED (SELECT {key}, pos // 16 AS pos, max((total + 15) // 16) AS total,
    CASE WHEN max(total) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h
  FROM {name}_{k} GROUP BY {key}, pos // 16),"""
    return out


def _merkle_sql(levels: int = 5, tops: int = 3) -> str:
    """For at most 16 ** levels rows of a source and 16 ** tops sources."""
    def field(x):
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"

    def leaf(text):
        return f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    # The usual CRC-32 with its reversed polynomial, bit by bit.
    crc = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, length(d) + 1),
      lambda i: CAST(ascii(d[i]) AS BIGINT)), lambda c, b: list_reduce([xor(c, b)] || range(8),
      lambda x, _: xor(x >> 1, (x & 1) * CAST(3988292384 AS BIGINT)))), CAST(4294967295 AS BIGINT))"""
    sources = [(f"s{k}", f"t_s{k} s{k} ON s{k}.source IS NOT DISTINCT FROM l.source AND s{k}.pos = l.pos // {16 ** k}")
               for k in range(levels)]
    roots = [(f"r{k}", f"u_s{k} r{k} ON r{k}.pos = o.pos // {16 ** k}") for k in range(tops)]
    steps = [n for n, _ in sources + roots]
    sibs = " || ".join(f"coalesce({n}.lh || {n}.rh, '')" for n in steps)
    folds = ""
    for i, n in enumerate(steps):
        folds += f",\nf{i} AS (SELECT * EXCLUDE (x), CASE WHEN l{n} IS NULL THEN x ELSE sha256(l{n} || x || r{n}) END AS x FROM {'p' if i == 0 else f'f{i - 1}'})"
    return f"""
WITH d AS (SELECT *, CAST(doc_id AS VARCHAR) AS d FROM documents),
leaves AS MATERIALIZED (SELECT doc_id, source, {leaf("text")} AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS tampered FROM d),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS total FROM leaves),
t_0 AS (SELECT source, pos, total, leaf AS h FROM l),{_levels_sql("t", "source", levels)}
o AS MATERIALIZED (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS total
  FROM t_{levels}),
u_0 AS (SELECT 0 AS one, pos, total, h FROM o),{_levels_sql("u", "one", tops)}
p AS MATERIALIZED (SELECT l.doc_id, l.leaf, o.h AS subroot, u.h AS root, sha256({sibs}) AS proof_sha256, l.tampered AS x,
  {", ".join(f"{n}.lh AS l{n}, {n}.rh AS r{n}" for n in steps)}
  FROM l JOIN o ON o.source IS NOT DISTINCT FROM l.source CROSS JOIN u_{tops} u
  {" ".join("JOIN " + on for _, on in sources + roots)}){folds}
SELECT doc_id, leaf, subroot, root, proof_sha256, x AS folded_root, x = root AS verified FROM f{len(steps) - 1}
"""


ORACLE["op13_merkle_manifest"] = _merkle_sql()
