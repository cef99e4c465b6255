"""Operator 13 against trees built and cut by hand, and against SQL."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from forecourt.llm import merkle
from forecourt.llm.queries import ORACLE, op13_merkle_manifest
from tools.check_oracle import canonical


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes):
    """All levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_siblings(levels, place):
    out = []
    for level in levels[:-1]:
        run = place // 16 * 16
        out.append((level[run:place], level[place + 1:run + 16]))
        place //= 16
    return out


def brute(rows, columns, group, order):
    """(group, id, leaf, subroot, root, proof) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[group], []).append(((r[order] is not None, r[order] or 0), brute_leaf(*(r[c] for c in columns))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([leaf for _, leaf in sorted(groups[g])]) for g in names}
    top = brute_tree([trees[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        upper = brute_siblings(top, i)
        for j, (key, leaf) in enumerate(sorted(groups[g])):
            steps = brute_siblings(trees[g], j) + upper
            out.append((g, key[1] if key[0] else None, leaf, trees[g][-1][0], top[-1][0],
                        sha(*(h for s in steps for side in s for h in side))))
    return out


def key(row):
    return [str(x) for x in row]


SCHEMA = "doc_id long, source string, text string, n long, pos string, level string"


def odd_rows():
    """Groups of 1, 16, 17, 256, 257 and 4,200 rows, a group without name, and 300 small ones."""
    rows, n = [], 0
    for source, count in [("one", 1), ("run", 16), ("run+", 17), ("block", 256), ("block+", 257), ("hot", 4200), (None, 30)]:
        for _ in range(count):
            rows.append((n * 7919 % 100_003, source, f"Text {n}" * (n % 5), n, "p", None))
            n += 1
    rows += [(i, f"small é{i}", None, i, None, "x") for i in range(300)]
    rows += [(5, "run", "", None, "", ""), (5, "run", None, None, "", ""), (5, "hot", "same", 1, "", "")]
    rows += [(5, "hot", "same", 1, "", "")] * 40 + [(None, "one", "no id", 2, "", ""), (7, "one", "x" * 200_000, 3, "", "")]
    return rows


def test_manifest_equals_brute_force(spark, tmp_path):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    columns = ["doc_id", "source", "text", "n", "pos"]
    path = str(tmp_path / "manifest")
    merkle.write(docs, path, columns, "source", carry=["pos", "level"])
    found = merkle.proofs(spark, path).withColumns({
        "proof": merkle.siblings(F.col("steps")), "again": merkle.folded(F.col("leaf"), F.col("steps"))})
    got = found.select("key", "id", "leaf", "subroot", "root", "proof", "again", "carried.*").collect()
    names = SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    want = brute([dict(zip(names, r, strict=True)) for r in rows], columns, "source", "doc_id")
    assert sorted(map(key, (r[:6] for r in got))) == sorted(map(key, want))
    assert all(r["again"] == r["root"] for r in got) and sum(r["level"] == "x" for r in got) == 300
    levels = sorted(p.name for p in (tmp_path / "manifest" / "groups").iterdir())
    assert levels == ["level-0", "level-1"]  # of the four levels of the largest tree


@pytest.mark.parametrize("changed", ["text", "n", "doc_id"])
def test_a_change_of_any_value_breaks_its_proof_only(spark, tmp_path, changed):
    docs = spark.createDataFrame([(i, "s", "t", i, "", "") for i in range(300)], SCHEMA)
    path = str(tmp_path / "manifest")
    other = merkle.leaf(*(F.lit("z") if c == changed else F.col(c) for c in ("doc_id", "text", "n")))
    docs = docs.withColumn("other", F.when(F.col("doc_id") % 7 == 0, other))
    merkle.write(docs, path, ["doc_id", "text", "n"], "source", carry=["other"])
    found = merkle.proofs(spark, path).select(
        "id", (merkle.folded(F.coalesce("carried.other", "leaf"), F.col("steps")) == F.col("root")).alias("ok"))
    assert {(r["id"], r["ok"]) for r in found.collect()} == {(i, i % 7 != 0) for i in range(300)}


def test_the_manifest_does_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    docs = spark.createDataFrame([(i // 40, "s", f"{i % 11}", 0, "", "") for i in range(600)], SCHEMA)
    seen = []
    for n in (1, 6):
        path = str(tmp_path / f"{n}")
        merkle.write(docs.repartition(n), path, ["doc_id", "text"], "source")
        seen.append(sorted(map(key, (r[:6] for r in merkle.proofs(spark, path).select(
            "key", "id", "leaf", "root", merkle.siblings(F.col("steps"))).collect()))))
    assert seen[0] == seen[1]


@pytest.mark.parametrize("count", [0, 1])
def test_no_row_and_one_row(spark, tmp_path, count):
    path = str(tmp_path / "manifest")
    merkle.write(spark.createDataFrame([(1, None, None, None, None, None)] * count, SCHEMA), path, ["text"], "source")
    got = merkle.proofs(spark, path).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["steps"]) for r in got] == [(sha("-"),) * 3 + ([],)] * count


def test_the_query_equals_sql_on_odd_rows(spark, tmp_path):
    rows = [(a, b, c, d, str(e)) for a, b, c, d, e, _ in odd_rows()]
    schema = "doc_id long, source string, text string, n_chars long, lang string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_merkle_manifest(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    res = con.execute(ORACLE["op13_merkle_manifest"])
    names = [c[0] for c in res.description]
    rows = [tuple(r) for r in got.collect()]
    assert canonical(got.columns, rows) == canonical(names, res.fetchall())
    assert 0 < sum(not r[-1] for r in rows) < len(rows) / 4


def test_no_python_runs(spark, sf):
    plan = entry.queries()["op13_merkle_manifest"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
