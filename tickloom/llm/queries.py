"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontaminate, language, licenses, neardup, packing, quality, ragged, rules, secrets, sharding, toxicity


def _in_small_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ragged.small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language.query,
    "op2_histogram_sort": sharding.query,
    "op3_toxicity": toxicity.query,
    "op4_quality_rules": rules.query,
    "op5_decontamination": decontaminate.query,
    "op6_license_scan": licenses.query,
    "op7_quality_classifier": quality.query,
    "op8_secret_scan": secrets.query,
    "op9_near_dedup": neardup.query,
    "op10_packing": packing.query,
}
QUERIES = {name: _in_small_batches(query) for name, query in QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op6_license_scan": licenses.ORACLE_SQL,
    "op9_near_dedup": neardup.ORACLE_SQL,
}
