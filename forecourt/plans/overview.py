"""One job for all the count views of a dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VIEWS: tuple[tuple[str, ...], ...] = (
    (),
    ("sentiment",),
    ("issue_category",),
    ("issue_category", "sentiment"),
    ("bert_star", "sentiment"),
    ("zone", "sentiment"),
    ("brand", "issue_category"),
)


def overview(df: DataFrame, views: Sequence[Sequence[str]] = DEFAULT_VIEWS) -> DataFrame:
    """Counts and negatives of every view, from one scan of the reviews.

    GROUPING SETS copies each input row once per view, so the reviews are first
    counted over all dimensions together; only that small cube is expanded.
    """
    dims = sorted({c for v in views for c in v} | {"sentiment"})
    cube = df.groupBy(*dims).agg(F.count("*").alias("n"))
    negative = F.when(F.col("sentiment") == "Negative", F.col("n")).otherwise(0)
    # The grouping columns are NULL in rolled-up rows, so count from a copy.
    cube = cube.withColumn("_neg", negative)
    sets = [[F.col(c) for c in v] for v in views]
    out = cube.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.sum("n").alias("n"),
        F.sum("_neg").alias("negatives"),
        F.grouping_id().alias("_gid"),
    )
    names = {}
    for v in views:
        gid = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in v)
        names[gid] = "+".join(v) or "total"
    label = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    return out.withColumn(
        "view", F.element_at(label, F.col("_gid").cast("int"))
    ).drop("_gid")
