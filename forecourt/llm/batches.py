"""Arrow batches as flat byte arrays, cut into pieces of bounded memory."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from forecourt.session import tidy  # noqa: F401 - the operators take it from here

PIECE_BYTES = 1 << 19
PIECE_ROWS = 256


@lru_cache(maxsize=8)
def _ship(application_id: str, add_file: Callable) -> None:
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="forecourt-code-")) / "forecourt-code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    add_file(str(archive))


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per application.

    The driver's file server hands the archive out, so no folder has to be shared.
    """
    _ship(spark.sparkContext.applicationId, spark.sparkContext.addPyFile)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, UTF-8 bytes) of a string column; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES, rows: int = PIECE_ROWS
           ) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``rows`` rows and about ``limit`` bytes; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def append(df: DataFrame, text: str, score: Callable, fields: list[T.StructField],
           limit: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> DataFrame:
    """All columns of the frame and those that ``score(offsets, bytes)`` gives per row.

    ``score`` gets the rows of one piece (offsets from 0) and returns one array for
    each field.  Works task by task without a shuffle; an empty frame gives no rows.
    """
    ship(df.sparkSession)
    schema = T.StructType(df.schema.fields + fields)
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches):
        for batch in batches:
            offsets, raw = flat(batch.column(batch.schema.get_field_index(text)))
            for i, j in pieces(offsets, limit, rows):
                own = offsets[i:j + 1]
                got = score(own - own[0], raw[own[0]:own[-1]])
                made = [pa.array(x, f.type) for x, f in zip(got, arrow, strict=True)]
                columns = [c.slice(i, j - i) for c in batch.columns] + made
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return df.mapInArrow(tidy(run), schema)
