"""The queries of this subpackage and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import bpe, dedup, jaccard, katz, langid, mixing, quality, tokencount, urls, warc


def _on(table: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": _on("documents", mixing.op1),
        "op2_langid": _on("documents", langid.op2),
        "op3_warc": _on("pages", warc.op3),
        "op4_bpe": _on("documents", bpe.op4),
        "op5_urls": _on("pages", urls.op5),
        "op6_dedup": _on("documents", dedup.op6),
        "op7_katz": _on("documents", katz.op7),
        "op8_jaccard": _on("documents", jaccard.op8),
        "op9_tokens": _on("documents", tokencount.count),
        "op10_quality": _on("documents", quality.op10),
    }


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express; the others are tested against brute force."""
    return {"op3_warc": warc.SQL, "op6_dedup": dedup.SQL, "op8_jaccard": jaccard.SQL}
