"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

from fernlake.llm import bpe_codec, chain_dedup, entropy_mix, html_extract, kneser_ney, license_scan, media_sniff, quality_rules, secret_scan, simhash_dedup

MODULES = (quality_rules, secret_scan, chain_dedup, bpe_codec, kneser_ney, license_scan, entropy_mix, media_sniff, simhash_dedup, html_extract)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
