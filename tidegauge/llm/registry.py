"""Queries of the corpus operators over their whole tables, and the SQL oracles of those that SQL can express."""

from __future__ import annotations

from tidegauge.llm import decontaminate, fingerprint, language, license, near_dedup, pii, sentencepiece_sampling, sharding, substrings, warc_audit

QUERIES = {}
ORACLE_SQL = {}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_documents(f):
    return lambda spark, sf_dir: f(_table(spark, sf_dir, "documents"))


QUERIES["op2_decontaminate"] = lambda spark, sf_dir: decontaminate.overlap_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
ORACLE_SQL["op2_decontaminate"] = decontaminate.ORACLE
QUERIES["op4_language"] = _on_documents(language.language_report)
QUERIES["op9_shards"] = _on_documents(sharding.shard_report)
ORACLE_SQL["op9_shards"] = sharding.ORACLE
QUERIES["op7_fingerprint"] = _on_documents(fingerprint.edit_report)
QUERIES["op3_license"] = _on_documents(license.license_report)
QUERIES["op1_pii"] = _on_documents(pii.pii_report)
QUERIES["op8_substrings"] = _on_documents(substrings.repeat_report)
ORACLE_SQL["op8_substrings"] = substrings.ORACLE
QUERIES["op6_near_dedup"] = _on_documents(near_dedup.near_report)
QUERIES["op10_sentencepiece"] = _on_documents(sentencepiece_sampling.sampling_report)
QUERIES["op5_warc_audit"] = lambda spark, sf_dir: warc_audit.audit_report(_table(spark, sf_dir, "pages"))
ORACLE_SQL["op5_warc_audit"] = warc_audit.ORACLE
