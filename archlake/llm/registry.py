"""The operators' queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, html_extract, license_scan, minhash_dedup, packing, substring_dedup, token_counts, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        packing.op1_best_fit_packing,
        url_filter.op2_url_filter,
        exact_dedup.op3_exact_dedup,
        toxicity.op4_toxicity,
        minhash_dedup.op5_minhash_dedup,
        substring_dedup.op6_substring_dedup,
        decontaminate.op7_decontaminate,
        html_extract.op8_html_extract,
        license_scan.op9_license_scan,
        token_counts.op10_token_counts,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": url_filter.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op7_decontaminate": decontaminate.SQL,
}
