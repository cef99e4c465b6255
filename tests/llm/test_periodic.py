"""Operator 11 against a search over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forecourt.llm import periodic
from forecourt.llm.queries import op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=6, times=4):
    """Every period and every stretch of it; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def tuples(found):
    return [[tuple(map(int, r)) for r in runs] for runs in found]


# Words, repeated stretches and earlier words again: runs beside, inside and across each other.
piece = st.one_of(
    st.lists(st.integers(0, 2), min_size=1, max_size=6),
    st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(2, 9)).map(lambda p: p[0] * p[1]))
sequence = st.tuples(st.lists(piece, max_size=6), st.integers(1, 3)).map(
    lambda p: [w for part in p[0] for w in part] * p[1])


@settings(max_examples=250, deadline=None)
@given(st.lists(sequence, min_size=1, max_size=4), st.sampled_from([1, 2, 3, 7, 16, 50, 1 << 17]))
def test_runs_equal_brute_force_however_the_words_are_appended(texts, segment):
    found = periodic.runs_of([np.array(t, np.int64) for t in texts], 6, 4, segment)
    assert tuples(found) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("least, times", [(2, 2), (6, 2), (3, 3), (40, 4)])
def test_other_limits(least, times):
    words = [0, 1] * 9 + [5] + [2, 2, 3] * 4 + [0] * 41
    assert tuples(periodic.runs_of([np.array(words)], least, times)) == [brute_runs(words, least, times)]


def test_many_equal_words_and_blocks_that_come_again_in_other_runs():
    """Neither one word 100,000 times nor runs of many lengths side by side take quadratic time."""
    one = np.zeros(100_000, np.int64)
    assert tuples(periodic.runs_of([one], 6, 4)) == [[(0, 100_000, 1)]]
    lengths = [500 + 37 * k % 2500 for k in range(60)]
    many = np.concatenate([np.append(np.zeros(n, np.int64), 1) for n in lengths])
    starts = np.cumsum([0] + [n + 1 for n in lengths])[:-1].tolist()
    assert tuples(periodic.runs_of([many], 6, 4)) == [[(s, n, 1) for s, n in zip(starts, lengths, strict=True)]]


def test_a_chance_of_equal_hashes_makes_no_run(monkeypatch):
    monkeypatch.setattr(periodic.Catchers, "_pair", staticmethod(lambda a, b: np.zeros(len(a), np.uint64)))
    words = list(range(40)) + [7, 8, 9] * 8
    assert tuples(periodic.runs_of([np.array(words)], 6, 4)) == [brute_runs(words)]


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n\x0b ", "x"), (4, "a b " * 4 + "c", "x"), (4, "a b " * 4 + "c", "x"),
            (5, "no\x1cspace\xa0here " * 7, "x"), (None, "z " * 50_000, None), (6, "ü\tü\nü\rü\x0cü ü", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "runs", "runs_", "collapsed"]
    got = [(r["doc_id"], [tuple(x) for x in r["runs_"]], r["collapsed"]) for r in out.collect()]
    assert got == [
        (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 8, 2)], "a b c"), (4, [(0, 8, 2)], "a b c"),
        (5, [(0, 7, 1)], "no\x1cspace\xa0here"), (None, [(0, 50_000, 1)], "z"), (6, [(0, 6, 1)], "ü")]
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_the_query_equals_brute_force(spark, tmp_path):
    base = ["", None, "one", "a a a a a a b", "x y " * 30, "the end of the line " * 8 + "stop",
            " ".join(map(str, range(90))), "\t\n "]
    rows = [(i, base[i % len(base)]) for i in range(400)] + [(None, "p q r " * 5), (8, "a a a a a a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str(brute_row(*r)) for r in rows)
    assert sum(r[1] > 0 for r in got) > 150
