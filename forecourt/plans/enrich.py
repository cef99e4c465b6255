"""From raw reviews to the enriched fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.functions import issues
from forecourt.operators.filters import with_text
from forecourt.operators.scoring import predict
from forecourt.sources.reviews import keep_first, unseen


def protect_author(df: DataFrame, author: str = "hash", column: str = "author_name",
                   secret: str = ""):
    """Reviewer names are personal data: hash them, drop them, or keep them.

    Without a ``secret`` of the caller's, a list of names can be hashed and compared.
    """
    if column not in df.columns or author == "keep":
        return df
    if author == "drop":
        return df.drop(column)
    if author == "hash":
        return df.withColumn(column, F.sha2(F.concat(F.lit(secret), F.col(column)), 256))
    raise ValueError(f"unknown author mode: {author}")


def enrich(
    df: DataFrame,
    text: str = "text",
    scorer=None,
    lexicon: lx.Lexicon = lx.DEFAULT,
    top_n: int = 3,
    quality: bool = True,
    author: str = "hash",
    max_chars: int | None = None,
    secret: str = "",
) -> DataFrame:
    """Score and classify every review with a text.

    All steps work on one row, so this runs unchanged on a stream, needs no
    shuffle, and label, tags and quality share one search for keywords.
    """
    scored = predict(with_text(df, text), text, scorer, lexicon.overrides, max_chars)
    words, specific = issues.issue_words(lexicon.issues), lexicon.specific if quality else []
    found = scored.withColumn("_found", issues.keywords_of(F.col(text), [*words, *specific]))
    counted = found.withColumn("_scores", issues.issue_scores(F.col(text), lexicon.issues, F.col("_found")))
    columns = {
        "issue_category": issues.primary_issue(F.col("_scores")),
        "issue_tags": issues.issue_tags(F.col("_scores"), top_n),
    }
    if quality:
        hits = F.size(F.filter("_found", lambda i: i >= len(words)))
        columns["quality_score"] = issues.quality_score(F.col(text), specific, hits)
    return protect_author(counted.withColumns(columns).drop("_found", "_scores"), author, secret=secret)


def export_tags(df: DataFrame, column: str = "issue_tags") -> DataFrame:
    """Tags as one string, for flat files."""
    return df.withColumn(column, F.array_join(column, ", "))


def _once(raw: DataFrame, key: str) -> DataFrame:
    return keep_first(raw, [key], [F.xxhash64(*raw.columns)])


def refresh(raw: DataFrame, enriched: DataFrame, key: str = "review_id", **options) -> DataFrame:
    """The enriched table with the raw rows it does not hold yet.

    Only new rows are scored; what was enriched before is read, not recomputed.  Of new
    rows with one key the first by hash of the row counts.
    """
    fresh = enrich(unseen(_once(raw, key), enriched, [key]), **options)
    return enriched.unionByName(fresh.select(*enriched.columns))


def append_new(
    spark: SparkSession, raw: DataFrame, path: str, key: str = "review_id",
    partition_by: str | None = "zone", **options,
) -> None:
    """Bring the enriched table at ``path`` up to date by appending new rows."""
    table = spark.read.parquet(path)
    fresh = enrich(unseen(_once(raw, key), table, [key]), **options).select(*table.columns)
    writer = fresh.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
