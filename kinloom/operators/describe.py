"""Descriptive statistics over contributors, projects and years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import text as T


def noreply_users(a2p: DataFrame) -> DataFrame:
    """(author, project, email, username, numeric_id, plain) of noreply addresses."""
    d = a2p.withColumn("email", T.clean_quoted(T.email_at_end(F.col("author")))).where(F.contains("email", F.lit("@users.noreply.github.com")))
    d = d.withColumn("username", T.username_of_email(F.col("email")))
    return d.withColumn("numeric_id", T.numeric_id(F.col("username"))).withColumn("plain", T.without_id(F.col("username")))


def numeric_ids(users: DataFrame) -> DataFrame:
    return users.where("numeric_id is not null").select("numeric_id").distinct().orderBy(F.length(F.ltrim(F.col("numeric_id"), F.lit("0"))), "numeric_id")


def username_variants(users: DataFrame) -> DataFrame:
    d = users.where("plain is not null").select("plain", "username", F.col("numeric_id").isNotNull().alias("has_id")).distinct()
    g = d.groupBy("plain").agg(F.array_join(F.array_sort(F.collect_list("username")), "; ").alias("variants"), F.count(F.lit(1)).alias("n"), F.bool_or("has_id").alias("has_id"), F.bool_or(~F.col("has_id")).alias("has_plain"))
    return g.withColumn("merged", F.col("has_id") & F.col("has_plain"))


def noreply_summary(users: DataFrame) -> DataFrame:
    one = users.agg(*[F.count_distinct(c).cast("long").alias(n) for c, n in (("author", "authors"), ("email", "emails"), ("project", "projects"), ("username", "usernames"), ("numeric_id", "id_prefixes_found"), ("plain", "usernames_after_merge"))])
    one = one.withColumn("reduction", F.col("usernames") - F.col("usernames_after_merge"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])))


def distinct_projects(a2p: DataFrame) -> DataFrame:
    noreply = F.contains("author", F.lit("@users.noreply.github.com"))
    hosted = ~F.contains("project", F.lit("/"))
    count = lambda cond, name: F.count_distinct(F.when(cond, F.col("project"))).alias(name)
    return a2p.agg(F.count_distinct("project").alias("projects"), count(hosted, "github_projects"), count(~noreply, "projects_without_noreply"), count(hosted & ~noreply, "github_projects_without_noreply"))


def second_column(relation: DataFrame, column: str) -> DataFrame:
    return relation.select(column).distinct().orderBy(column)


def commit_times(a2c: DataFrame, c2dat: DataFrame) -> DataFrame:
    """Timestamps of the commits of noreply authors."""
    return a2c.where(F.contains("author", F.lit("@users.noreply.github.com"))).join(c2dat, "commit").select("commit", "time")


def lookup(keys: DataFrame, relation: DataFrame, key: str) -> DataFrame:
    return keys.where(F.trim(F.col(key)) != "").join(relation, key)


def sum_years(counts: DataFrame) -> DataFrame:
    """(year, count) summed; rows that don't parse are skipped."""
    d = counts.select(F.expr("try_cast(year as int)").alias("year"), F.expr("try_cast(count as long)").alias("count")).dropna()
    return d.groupBy("year").agg(F.sum("count").alias("count"))


def series_summary(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("all", "noreply")) -> DataFrame:
    both = a.withColumn("source", F.lit(names[0])).unionByName(b.withColumn("source", F.lit(names[1])))
    return both.groupBy("source").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("years"), F.avg("count").alias("mean"), F.median("count").alias("median"))


def core_contributors(commits: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds core to (project, author, n): the authors who together, the busiest first, reach
    ``share`` of a project's commits. Ranks come from the histogram of n, so a project with very
    many authors is not ordered in one task."""
    from pyspark.sql.window import Window

    h = commits.groupBy("project", "n").agg((F.count(F.lit(1)) * F.col("n")).alias("mass"))
    w = Window.partitionBy("project").orderBy(F.desc("n"))
    total = F.sum("mass").over(Window.partitionBy("project"))
    h = h.withColumn("before", F.sum("mass").over(w) - F.col("mass")).withColumn("core", F.col("before") < share * total)
    return commits.join(h.select("project", "n", "core"), ["project", "n"])


# Steps and descriptions of the summary file.
SUMMARY = {
    "authors_in": ("Total author strings", "Original author strings in input data"),
    "authors": ("Unique author strings", "Unique author strings"),
    "projects": ("Total unique projects", "Unique projects"),
    "emails": ("Unique emails (cleaned)", "Unique email addresses (cleaned during extraction)"),
    "usernames": ("Unique username strings", "Unique username strings extracted from emails"),
    "ids": ("Unique numeric IDs", "Unique numeric IDs extracted from id+username patterns"),
    "with_id": ("Usernames with ID prefix", "Usernames with digit+username pattern"),
    "without_id": ("Usernames without ID prefix", "Usernames without ID prefix"),
    "prefixes": ("ID prefixes found", "Total ID+ patterns detected"),
    "merged": ("Unique usernames (merged)", "Unique usernames after merging ID+ with plain"),
    "merges": ("Successful merges", "Cases where ID+ and plain versions were merged"),
    "reduction": ("Reduction from merging", "Username count reduction from merging"),
}


def noreply_files(users: DataFrame) -> dict[str, DataFrame]:
    """The seven result files of noreply users by name, each with its columns; rows in no order."""
    one = lambda c, name: users.select(F.col(c).alias(name)).where(F.col(name).isNotNull()).distinct()
    v = username_variants(users)
    names = v.select(F.col("plain").alias("username"), F.col("n").alias("variant_count"), F.replace("variants", F.lit("; "), F.lit(";")).alias("variants"), F.col("has_id").alias("has_id_prefix"), F.col("has_plain").alias("has_plain_form"), "merged")
    distinct = lambda c, test=F.lit(True): F.count_distinct(F.when(test, F.col(c)))
    has_id = F.col("numeric_id").isNotNull()
    counts = users.agg(
        F.count("author").alias("authors_in"), distinct("author").alias("authors"), distinct("project").alias("projects"), distinct("email").alias("emails"), distinct("username").alias("usernames"),
        distinct("numeric_id").alias("ids"), distinct("username", has_id).alias("with_id"), distinct("username", ~has_id).alias("without_id"), distinct("username", has_id).alias("prefixes"),
    )
    merges = v.agg(F.count(F.lit(1)).alias("merged"), F.count_if("merged").alias("merges"))
    counts = counts.join(F.broadcast(merges)).withColumn("reduction", F.col("usernames") - F.col("merged"))
    rows = [F.struct(F.lit(step).alias("step"), F.col(c).alias("count"), F.lit(text).alias("description")) for c, (step, text) in SUMMARY.items()]
    return {
        "uniqueAuthorStrings": one("author", "author_string"), "uniqueEmailStrings": one("email", "email"), "uniqueUsernameStrings": one("username", "username_string"), "uniqueUsernames": names,
        "uniqueNumericIds": one("numeric_id", "numeric_id"), "uniqueProjects": one("project", "project"), "summary": counts.select(F.inline(F.array(*rows))),
    }
