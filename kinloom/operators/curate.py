"""Curation of raw repository-to-author relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinloom.functions import text as T


def split_utf8(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows with valid and with invalid UTF-8."""
    ok = F.is_valid_utf8(F.col(column).cast("string"))
    return df.where(ok), df.where(~ok)


def invalid_lines(df: DataFrame) -> DataFrame:
    """(line_number, line) of (pos, raw) rows that aren't UTF-8: ``number:content``, the content read as Latin-1."""
    bad = df.where(~F.is_valid_utf8(F.col("raw").cast("string")))
    return bad.select(F.col("pos").alias("line_number"), F.concat(F.col("pos").cast("string"), F.lit(":"), F.decode("raw", "ISO-8859-1")).alias("line"))


def line_qa(df: DataFrame) -> DataFrame:
    """Adds errors (array) and clean to (pos, value)."""
    return df.withColumn("errors", T.line_errors(F.col("value"))).withColumn("clean", F.size("errors") == 0)


def problem_lines(qa: DataFrame) -> DataFrame:
    return qa.where("not clean").select(F.col("pos").alias("line_number"), F.array_join("errors", ", ").alias("error_types"), F.substring("value", 1, 500).alias("line_content"))


def error_histogram(qa: DataFrame) -> DataFrame:
    """Every reason of every line counts, also a line's second one."""
    c = qa.select(F.explode("errors").alias("e")).groupBy(T.error_head(F.col("e")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.join(F.broadcast(total)).select("error_type", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def repo_sizes(p2a: DataFrame) -> DataFrame:
    return p2a.where("repo <> '' and author <> ''").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


def single_author_repos(p2a: DataFrame) -> DataFrame:
    return repo_sizes(p2a).where("n = 1").select("repo")


def owner_pairs(p2a: DataFrame) -> DataFrame:
    """Distinct (owner, author) of single-author repositories: one aggregation, no join back."""
    one = p2a.where("repo <> '' and author <> ''").groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.first("author").alias("author")).where("n = 1")
    return one.select(T.repo_owner(F.col("repo")).alias("owner"), "author").distinct()


def duplicated_owners(pairs: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (owner, author) of owners with more than one author."""
    d = pairs.select("owner", "author").distinct()
    if exclude:
        d = d.where(~F.col("owner").isin(list(exclude)))
    more = d.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("owner")
    return d.join(more, "owner", "left_semi")


def quality_filter(pairs: DataFrame, exclude: tuple[str, ...] = ("bb", "gl")) -> DataFrame:
    return duplicated_owners(pairs, exclude)


def org_annotate(pairs: DataFrame, account_types: DataFrame) -> DataFrame:
    """Adds org_flag from (username, type): 1 for organizations, else 0; null owners go."""
    kinds = account_types.select(T.canonical_username(F.col("username")).alias("_u"), F.col("type").alias("_t")).groupBy("_u").agg(F.max((F.col("_t") == "Organization").cast("int")).alias("org_flag"))
    d = pairs.where("owner is not null").withColumn("_u", T.canonical_username(F.col("owner")))
    return d.join(kinds, "_u", "left").drop("_u").withColumn("org_flag", F.coalesce("org_flag", F.lit(0)))


def owners_per_author(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("author").agg(F.count_distinct("owner").alias("owners"))


def split_authors(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of authors with several owners, and of the others."""
    n = owners_per_author(pairs)
    d = pairs.join(n, "author")
    return d.where("owners > 1").drop("owners"), d.where("owners <= 1").drop("owners")


def owners_histogram(pairs: DataFrame) -> DataFrame:
    return owners_per_author(pairs).where("owners > 1").groupBy("owners").agg(F.count(F.lit(1)).alias("authors"))


def preview(pairs: DataFrame, authors: int = 10, names: int = 3) -> DataFrame:
    """The first authors with some of their owners and how many more there are."""
    d = pairs.select("author", "owner").distinct()
    w = Window.partitionBy("author").orderBy("owner")
    some = d.withColumn("i", F.row_number().over(w)).where(F.col("i") <= names).groupBy("author").agg(F.array_sort(F.collect_list("owner")).alias("owners"))
    n = owners_per_author(pairs).where("owners > 1").orderBy("author").limit(authors).withColumnRenamed("owners", "n")
    more = F.when(F.col("n") > names, F.concat(F.lit(" +"), (F.col("n") - names).cast("string"), F.lit(" more"))).otherwise("")
    return some.join(F.broadcast(n), "author").select("author", F.concat(F.array_join("owners", ", "), more).alias("usernames"))
