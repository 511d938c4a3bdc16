"""Training-corpus pipeline: quality rules, line dedup, near-dedup, source mixing and tokens, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``; the last
returns the token table.

Every row is a document.  A null text is an empty one, a null source the source ``""``, a null id no
name at all: rows of a null or repeated id are told apart by all their columns.  Rows equal in every column
are copies.  Columns that ``docs`` has besides those of ``documents``, whatever their names, pass through the stages but the last.  An empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from tidemill.llm.queries import vocabulary_path
from tidemill.llm.shared import outlasting, scratch, table, written  # noqa: F401

#: Similarity, in percent, from which documents count as near copies.
NEAR_PERCENT = 80


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``n_chars`` of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(columns)


def rule_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject, null and empty texts among them, and lines that too many documents of a source share."""
    return _measured(quality_rules.apply_rules(docs), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of each class of equal or nearly equal lines; documents left without a line go, null and empty texts, which had none, stay."""
    return _measured(line_dedup.drop_repeated_lines(docs), docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that of the smallest id, a null one last; null and empty texts are nobody's copies."""
    return near_dedup.keep_one(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents towards the sources' weights, in shuffled order; rows of one id share their count."""
    return mixing.repeated(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and a digest of the text decoded from them."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary_path()), vocabulary_path())
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", digest)


STAGES = [
    ("quality_rules", rule_out),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("source_mixing", mix_sources),
    ("bpe_encoding", tokenize),
]

#: No SQL engine has the near-duplicate search, the merges or the Poisson order; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; what a stage itself wrote and kept is given back once it is done."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = outlasting(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
