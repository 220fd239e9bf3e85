"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, language_id, lm_scoring, mixing, pii, simhash, token_output, toxicity, url_filter

MODULES = (token_output, exact_dedup, simhash, decontamination, mixing, pii, language_id, toxicity, url_filter, lm_scoring)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(m, name) for m in MODULES for name in sorted(vars(m)) if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
