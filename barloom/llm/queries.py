"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontamination, fill_middle, fingerprint, language_id, license_scan, line_dedup, merkle, near_dedup, packing, pii_crf, quality_rules, secret_scan, suffix_dedup
from barloom.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def _documents(digest: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: digest(read(spark, sf_dir, "documents"))


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_language_id": _documents(language_id.digest),
    "op2_packing": _documents(packing.digest),
    "op3_decontamination": _decontamination,
    "op4_near_dedup": _documents(near_dedup.digest),
    "op5_suffix_dedup": _documents(suffix_dedup.digest),
    "op6_line_dedup": _documents(line_dedup.digest),
    "op7_quality_rules": _documents(quality_rules.digest),
    "op8_license_scan": _documents(license_scan.digest),
    "op9_pii_crf": _documents(pii_crf.digest),
    "op10_secret_scan": _documents(secret_scan.digest),
    "op11_merkle_manifest": _documents(merkle.digest),
    "op12_fill_middle": _documents(fill_middle.digest),
    "op13_fingerprint": _documents(fingerprint.digest),
}

SQL: dict[str, str] = {
    "op3_decontamination": decontamination.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_fill_middle": fill_middle.SQL,
}
