"""The corpus pipeline: from documents to packed sequences of tokens.

Each stage reads all rows that the one before kept: quality rules reject, one document of each group of near duplicates
stays, contaminated documents go, secrets are masked, and the rest is packed. Stages that join work on a row number of their
own, so null and repeated ``doc_id`` are no matter. All stages but the last return the columns of ``documents``; further
columns come through as they are, whatever their names. Null and empty texts fail the quality rules; an empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm import decontamination, jaccard, packing, quality, secrets, tokens
from cohortline.llm.registry import table
from cohortline.llm.text import unused
from cohortline.session import materialize


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """A written copy with a number for each row, which stays the same however often it is read, and that column's name."""
    row = unused(docs.columns, "row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id())), row


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rules and the learned list."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = unused(docs.columns, "judged")
    return quality.judge(docs, rules, judged).where(F.col(f"`{judged}`.kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more, the first stays."""
    rows, row = numbered(docs)
    others = jaccard.similar(rows.select(row, "text"), key=row).where(F.col(row) != F.col("class_id")).select(row)
    return rows.join(others, row, "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    rows, row = numbered(docs)
    found = decontamination.contamination(rows.select(row, "text"), table(spark, sf_dir, "benchmark"), key=row)
    return rows.join(found.where("contaminated").select(row), row, "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask all spans in the texts; ``n_chars`` follows the text."""
    rows, row = numbered(docs)
    found = unused(rows.columns, "found")
    spans = materialize(secrets.scan(rows.select(row, "text"), key=row).where(F.size("spans") > 0).select(row, F.col("spans").alias(found)))
    masked = rows.join(spans, row).withColumn("text", secrets.redacted(F.col("text"), F.col(found))).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    rest = rows.join(spans, row, "left_anti")
    return rest.select(*docs.columns).unionByName(masked.select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokens.default_path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
          ("benchmark_decontamination", benchmark_decontamination), ("secret_scans", secret_scans), ("pack", pack)]
#: Learned rules, similarity joins and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
