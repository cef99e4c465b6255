"""Derived tables against what their source files hold."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from forecourt.plans import snapshot


@pytest.fixture
def place(spark, tmp_path):
    source, table = tmp_path / "source", str(tmp_path / "table")
    source.mkdir()
    seen = []

    def derive(rows):
        seen.append(rows.count())
        return rows.select(F.upper("value").alias("value"), snapshot.SOURCE)

    def run():
        return snapshot.refresh(spark, str(source), table, derive, form="text", pattern="*.txt")

    def rows(version=None):
        return sorted((Path(r[snapshot.SOURCE]).name, r["value"], r["version"])
                      for r in snapshot.read_table(spark, table, version).collect())
    return source, table, run, rows, seen


def put(path, text, at=None):
    path.write_text(text)
    if at:
        os.utime(path, (at, at))


def test_only_changed_files_are_read_again(place):
    source, _, run, rows, seen = place
    for n, at in (("a", 100), ("b", 200), ("c", 300)):
        put(source / f"{n}.txt", f"{n}1\n{n}2\n", at)
    put(source / "notes.md", "not a source")
    assert run() == 1 and seen == [6]
    first = [("a.txt", "A1", 1), ("a.txt", "A2", 1), ("b.txt", "B1", 1), ("b.txt", "B2", 1), ("c.txt", "C1", 1), ("c.txt", "C2", 1)]
    assert rows() == first
    assert run() == 1 and seen == [6]  # nothing changed: no new version, nothing read
    put(source / "a.txt", "x1\nx2\n", 101)  # same size, other time
    put(source / "b.txt", "b1\n", 200)  # same time, other size
    put(source / "d.txt", "d1\n", 50)
    assert run() == 2 and seen == [6, 4]
    assert rows() == [("a.txt", "X1", 2), ("a.txt", "X2", 2), ("b.txt", "B1", 2), ("c.txt", "C1", 1), ("c.txt", "C2", 1), ("d.txt", "D1", 2)]
    assert rows(1) == first  # an older version stays as it was


def test_rows_of_deleted_files_leave(place):
    source, _, run, rows, seen = place
    put(source / "a.txt", "a\n")
    put(source / "b.txt", "b\n")
    run()
    (source / "a.txt").unlink()
    assert run() == 2 and seen == [2] and rows() == [("b.txt", "B", 1)]
    (source / "b.txt").unlink()
    put(source / "c.txt", "c\n")
    assert run() == 3 and rows() == [("c.txt", "C", 3)]
    (source / "c.txt").unlink()
    put(source / "empty.md", "")
    assert run() == 4 and rows() == []


def test_a_failed_refresh_is_not_seen(spark, place):
    source, table, run, rows, _ = place
    put(source / "a.txt", "a\n")
    run()
    put(source / "b.txt", "b\n")

    def broken(rows):
        return rows.select(F.raise_error(F.lit("stop")).cast("string").alias("value"), snapshot.SOURCE)
    with pytest.raises(Exception, match="stop"):
        snapshot.refresh(spark, str(source), table, broken, form="text", pattern="*.txt")
    # Data of a run whose manifest was never written, and a manifest that was not finished.
    spark.createDataFrame([("Z", "z")], f"value string, {snapshot.SOURCE} string").write.parquet(f"{table}/data/run=dead")
    (Path(table) / "versions" / "7").mkdir()
    (Path(table) / "versions" / "7" / "part-0.parquet").write_bytes(b"half")
    assert snapshot.current_version(spark, table) == 1 and rows() == [("a.txt", "A", 1)]
    assert run() == 2 and rows() == [("a.txt", "A", 1), ("b.txt", "B", 2)]


def test_a_file_that_was_half_written_is_read_again(place):
    source, _, run, rows, _ = place
    put(source / "a.txt", "a1\nha", 100)
    put(source / ".b.txt.tmp", "hidden\n")
    run()
    assert rows() == [("a.txt", "A1", 1), ("a.txt", "HA", 1)]
    put(source / "a.txt", "a1\nhalf no more\n", 100)
    (source / ".b.txt.tmp").rename(source / "b.txt")
    assert run() == 2 and rows() == [("a.txt", "A1", 2), ("a.txt", "HALF NO MORE", 2), ("b.txt", "HIDDEN", 2)]


def test_no_version_and_a_version_written_twice(spark, place, monkeypatch):
    source, table, run, rows, _ = place
    with pytest.raises(ValueError, match="no version"):
        rows()
    put(source / "a.txt", "a\n")
    run()
    put(source / "a.txt", "aa\n")
    monkeypatch.setattr(snapshot, "current_version", lambda *a: 0)  # another refresh was as far
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        run()
