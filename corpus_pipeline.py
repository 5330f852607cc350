"""From documents to packed training windows, a stage at a time.

Each stage reads what its predecessor kept; between stages documents are
Parquet tables in the shared folder, so a lost executor costs a stage's tasks
and no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archlake.llm import decontaminate, exact_dedup, minhash_dedup, packing, tables, toxicity

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", minhash_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: A conditional random field and best-fit packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = tables.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
