"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and
read again as the next stage's docs.  A stage learns what it needs from the documents it
is given and from the label table in ``sf_dir``; it works on every row it is given, drops
none but those it rejects, and keeps null texts, repeated rows and extra columns as the
operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.catalog.tables import read
from forecourt.llm import bpe, language, mixing, simhash, toxicity
from forecourt.llm.labels import held_out
from forecourt.llm.queries import byte_bpe
from forecourt.session import work_dir


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity detector does not reject.

    Null and empty texts have a score too; repeated rows share their fate; an empty table stays empty.
    """
    detector = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    found = toxicity.toxicity(docs, detector)
    rejected = found.columns[-1]
    return found.where(F.col(rejected) == 0).select(*docs.columns)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near enough to one of the learned languages.

    Null texts and those without a letter go; of equally near languages the first counts; repeated
    rows share their fate.
    """
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    found = language.languages(docs, model)
    rejected = found.columns[-1]
    return found.where(~F.col(rejected)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: two differing bits of a SimHash of three-word shingles.

    The smallest id stays, one row where rows repeat; null and blank texts are one group; rows without an
    id stay only where their whole group has none, one of them.
    """
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the source mix takes a document.

    A null source is a source of its own; texts without words weigh nothing and come with sources that are
    taken whole; repeated rows count each.
    """
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; a null or empty text has none, repeated rows have theirs each."""
    return bpe.encode(docs, byte_bpe()).drop("text")


STAGES = [
    ("toxicity", ordinary),
    ("language", in_a_language),
    ("near_dedup", one_of_each),
    ("source_mix", mixed),
    ("bpe", encoded),
]

# No stage after the first two is a query that SQL can state (trained models, trees of
# random draws, token ids), so the pipeline is tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each from the table the one before wrote."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
