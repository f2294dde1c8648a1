"""Writers of the result formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Quote marks inside fields are doubled, white space at their ends stays.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
METRICS = ("precision", "recall", "f1", "accuracy", "balanced_accuracy", "splitting", "lumping")


def write_resolution(df: DataFrame, path: str, append: bool = False, drop_flags: bool = False) -> None:
    """``;``-separated and quoted, sorted without regard to case, then by row content."""
    if drop_flags:
        df = df.drop("is_original_author_weird_id")
    rest = [c for c in df.columns if c != "original_author_id"]
    out = df.orderBy(F.lower("original_author_id"), "original_author_id", *rest)
    out.write.mode("append" if append else "overwrite").csv(path, sep=";", quoteAll=True, **CSV)


def metric_rows(metrics: DataFrame) -> DataFrame:
    """(Metric, Value) with four decimals, from the one-row metrics."""
    pairs = F.array(*[F.struct(F.lit(m).alias("Metric"), F.format_string("%.4f", F.col(m)).alias("Value")) for m in METRICS])
    return metrics.select(F.inline(pairs))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, **CSV)


def write_lookup(df: DataFrame, column: str, path: str) -> None:
    """Sorted distinct values, one per line."""
    df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def per_group_rows(groups: DataFrame, name: str = "username") -> DataFrame:
    """Per-group metrics as their file has them: the percentage with two decimals, ratios with four."""
    digits = {"merge_percentage": "%.2f", **dict.fromkeys(METRICS, "%.4f")}
    return groups.select(F.col("grp").alias(name), F.col("n").alias("num_authors"), *[F.format_string(f, F.col(c)).alias(c) for c, f in digits.items()])


def write_groups(groups: DataFrame, reasons: DataFrame, folder: str, name: str = "username") -> None:
    """Results (name, all_merged, reason) and metrics of groups, a file folder each."""
    write_csv(reasons.withColumnRenamed("grp", name).orderBy(name), f"{folder}/results")
    write_csv(per_group_rows(groups, name).orderBy(name), f"{folder}/per_{name}")


def write_files(files: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV below its name, ordered by its columns; numeric ids by value. A summary keeps its order."""
    for name, df in files.items():
        first = [F.length(F.ltrim(F.col(c), F.lit("0"))) for c in df.columns if c == "numeric_id"]
        write_csv(df if name == "summary" else df.orderBy(*first, *df.columns), f"{folder}/{name}")


def write_commits(df: DataFrame, path: str) -> None:
    """``;``-separated, texts quoted."""
    df.write.mode("overwrite").csv(path, sep=";", quoteAll=True, **CSV)
