"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import dedup_index, mixture, packing, reading_level
from framelake.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup_index.duplicate_pairs(spark, table(spark, d, "processed_files"), table(spark, d, "documents"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return dedup_index.duplicate_classes(spark, table(spark, d, "processed_files"), table(spark, d, "documents"))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p6_packing(spark, d))


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    return packing.broken_limits(p6_packing(spark, d))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(spark, table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(spark, table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mixture.broken_promises(mixture.mixture(spark, documents, targets)[0], documents, targets).drop("records")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    reader = reading_level.train(documents, table(spark, d, "reading_labels"))[0]
    return reading_level.graded(documents, reader).select("doc_id", "band")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    reader = reading_level.train(documents, table(spark, d, "reading_labels"))[0]
    return reading_level.profile(reading_level.graded(documents, reader))


def p8_validation(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return reading_level.validation_report(spark, reading_level.cross_validated(reading_level.labelled_rows(documents, table(spark, d, "reading_labels"))))


QUERIES = {
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p6_packing": p6_packing,
    "p6_report": p6_report,
    "p6_limits": p6_limits,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_limits": p7_limits,
    "p8_found": p8_found,
    "p8_profile": p8_profile,
    "p8_validation": p8_validation,
}

_CLEAN = "nullif(regexp_replace(lower(trim(source)), '[\\s\\-]+', '_', 'g'), '')"

# What holds whatever the packing and the mixture: every text with a token lies in each kind of container, no limit is broken.
ORACLE_SQL: dict[str, str] = {
    "p6_limits": """SELECT container_kind, (SELECT count(*) FROM documents WHERE text <> '') AS documents, CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS over_segments, CAST(0 AS BIGINT) AS over_loss, CAST(0 AS BIGINT) AS cut_short, CAST(0 AS BIGINT) AS gaps
FROM containers WHERE capacity_tokens > 0 AND container_kind IS NOT NULL GROUP BY container_kind""",
    "p7_limits": f"SELECT DISTINCT {_CLEAN} AS source, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS \"foreign\" FROM mix_targets WHERE {_CLEAN} IS NOT NULL",
}
