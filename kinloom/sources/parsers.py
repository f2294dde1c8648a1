"""Text formats as column expressions over ``spark.read.text`` lines, and ground-truth loaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinloom.functions import text as T
from kinloom.plans.scratch import Scratch, small


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of a text file or folder: pos counts lines in file order, without gaps."""
    row, file = F.monotonically_increasing_id(), F.col("_metadata.file_path")
    raw = Scratch(spark).table(spark.read.text(path).select("value", file.alias("file"), F.col("_metadata.file_block_start").alias("at"), row.alias("row")), "lines")
    # rows of a file's block are read one after the other; blocks are counted, and only blocks are ordered
    blocks = raw.groupBy("file", "at").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "at", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(F.broadcast(blocks), ["file", "at"]).select((F.col("before") + F.col("row") - F.col("first")).alias("pos"), "value")


def tolerant_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value, valid): bytes that aren't UTF-8 are read as Latin-1; blank lines go."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("raw"))
    return decoded(raw).where("value <> ''")


def decoded(raw: DataFrame) -> DataFrame:
    """(value, valid) of a binary column ``raw``."""
    valid = F.is_valid_utf8(F.col("raw").cast("string"))
    return raw.withColumn("valid", valid).withColumn("value", T.strip(F.when(valid, F.col("raw").cast("string")).otherwise(F.decode("raw", "ISO-8859-1")))).drop("raw")


def parse_signature(c: Column) -> Column:
    """struct(name, email): needs both brackets, else the whole and an empty email."""
    both = F.contains(c, F.lit("<")) & F.contains(c, F.lit(">"))
    name = F.when(both, T.strip(F.substring_index(c, "<", 1))).otherwise(T.strip(c))
    email = F.when(both, T.strip(F.regexp_extract(c, r"^[^<]*<([^>]*)>", 1))).otherwise("")
    return F.struct(name.alias("name"), email.alias("email"))


def _numbered(df: DataFrame, by: list[str], pos: str, name: str) -> DataFrame:
    """Distinct rows, numbered from 1 by first appearance, those of one place by their values. Ranks are counted per range of
    positions and summed over ranges, so no task orders all rows."""
    first = df.groupBy(*by).agg(F.min(pos).alias("_pos")).repartitionByRange("_pos").withColumn("_part", F.spark_partition_id())
    first = Scratch(df.sparkSession).table(first, "first")
    before = first.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_pos", *by))
    return first.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, (rank + F.col("_before")).cast("long")).drop("_part", "_before", "_pos")


def parse_aliases(df: DataFrame, with_username: bool = False) -> DataFrame:
    """(uid, name, email[, login]) from (pos, value): ``name;email``, ``name <email>`` or words and
    an email; lines that fit none are dropped, repeated aliases keep their first place."""
    v, login = T.strip(F.col("value")), F.lit(None).cast("string")
    if with_username:
        login = F.when(F.contains(v, F.lit(";")), T.strip(F.substring_index(v, ";", -1)))
        v = F.when(F.contains(v, F.lit(";")), F.regexp_replace(v, ";[^;]*$", "")).otherwise(v)
    angle, word = r"^(.+?)\s*<(.+?)>$", r"^(.+?)\s+(\S+)$"
    d = df.select("pos", v.alias("v"), login.alias("login")).where("v <> ''")
    form = F.when(F.contains("v", F.lit(";")), "s").when(F.contains("v", F.lit("<")) & F.contains("v", F.lit(">")), "a").otherwise("w")
    d = d.withColumn("form", form)
    pick = lambda i: F.when(F.col("form") == "s", F.get(F.split("v", ";"), F.lit(i - 1))).when(F.col("form") == "a", F.regexp_extract("v", angle, i)).otherwise(F.regexp_extract("v", word, i))
    d = d.withColumn("name", T.strip(pick(1))).withColumn("email", T.strip(pick(2)))
    d = d.where((F.col("form") == "s") | F.when(F.col("form") == "a", F.col("v").rlike(angle)).otherwise(F.col("v").rlike(word)))
    by = ["name", "email"]
    if with_username:
        d, by = d.withColumn("name", F.when(F.col("name") == "", F.col("login")).otherwise(F.col("name"))), ["name", "email", "login"]
    return _numbered(d, by, "pos", "uid").select("uid", *by)


def parse_git_log(df: DataFrame) -> DataFrame:
    """(pos, name, email, date, timestamp) from ``name;email;date;timestamp`` lines."""
    p = F.split("value", ";", 4)
    return df.where(F.size(p) == 4).select("pos", *[F.get(p, F.lit(i)).alias(c) for i, c in enumerate(("name", "email", "date", "timestamp"))])


def project_authors(relation: DataFrame, project: str) -> DataFrame:
    """Distinct authors of a project from a (project, author) relation."""
    return relation.where(F.col("project") == project).select(parse_signature(F.col("author")).alias("p")).select("p.name", "p.email").distinct()


def relation(df: DataFrame, left: str, right: str) -> DataFrame:
    """Two columns from ``left;right`` lines; lines without the mark are dropped."""
    p = F.split("value", ";", 2)
    return df.where(F.size(p) == 2).select(F.get(p, F.lit(0)).alias(left), F.get(p, F.lit(1)).alias(right))


def parse_assignments(df: DataFrame) -> DataFrame:
    """(searched, assigned) from (pos, value) lines with exactly one ``;``; the last one wins."""
    p = F.split("value", ";")
    d = df.where(F.size(p) == 2).select("pos", T.strip(F.get(p, F.lit(0))).alias("searched"), T.strip(F.get(p, F.lit(1))).alias("assigned"))
    return d.groupBy("searched").agg(F.max_by("assigned", "pos").alias("assigned"))


def developers(df: DataFrame) -> DataFrame:
    """(pos, alias_name, alias_email) from ``"Name <email>"`` lines."""
    v = F.regexp_replace(T.strip(F.col("value")), r'^"+|"+$', "")
    pattern = r"(.+?)\s*<([^>]+)>"
    return df.withColumn("v", v).where(F.col("v").rlike(pattern)).select("pos", T.strip(F.regexp_extract("v", pattern, 1)).alias("alias_name"), T.strip(F.regexp_extract("v", pattern, 2)).alias("alias_email"))


def matrix_pairs(rows: DataFrame) -> DataFrame:
    """(id1, id2, label) above the diagonal of (i, row array<double>)."""
    return rows.select("i", F.posexplode("row").alias("j", "v")).where("j > i").select(F.col("i").cast("long").alias("id1"), F.col("j").cast("long").alias("id2"), (F.col("v") > 0).cast("int").alias("label"))


def pairwise(df: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Aliases (alias_id from 0 by first appearance, alias) and pairs (id1, id2, label) of (pos, c0,
    c1, c2, ...). The label is the first later column whose values are all 0 or 1, else c2."""
    others = [c for c in df.columns if c not in ("pos", "c0", "c1")]
    if label is None:
        fits = df.agg(*[F.bool_and(F.coalesce(F.try_to_number(F.col(c).cast("string"), F.lit("9")).isin(0, 1), F.lit(False))).alias(c) for c in others]).first()
        label = next((c for c in others if fits[c]), others[0])
    seen = df.select("pos", F.posexplode(F.array("c0", "c1")).alias("side", "alias")).withColumn("at", F.col("pos") * 2 + F.col("side"))
    ids = _numbered(seen, ["alias"], "at", "alias_id").withColumn("alias_id", F.col("alias_id") - 1)
    side = lambda c, i: ids.select(F.col("alias").alias(c), F.col("alias_id").alias(i))
    pairs = df.join(side("c0", "id1"), "c0").join(side("c1", "id2"), "c1").select("id1", "id2", F.col(label).cast("int").alias("label"))
    return ids, pairs


def dre_pairs(df: DataFrame) -> DataFrame:
    """(id1, id2, label) of all pairs of aliases in (pos, dre_id, woc_id): an alias' first dre_id
    counts; ids by first appearance, from 0. The output is quadratic in the labelled corpus."""
    first = df.groupBy("woc_id").agg(F.min("pos").alias("pos"), F.min_by("dre_id", "pos").alias("dre_id"))
    ids = _numbered(first, ["woc_id", "dre_id"], "pos", "id").withColumn("id", F.col("id") - 1)
    return _all_pairs(ids, "dre_id")


def _all_pairs(ids: DataFrame, same: str, block: int = 256, task_pairs: int = 4_000_000) -> DataFrame:
    """All pairs of (id, ...), equal or not in ``same``, with ids from 0 without gaps: pairs are counted through, and the ids of
    one follow from its number, so that tasks have about ``task_pairs`` pairs each and no row is made, copied or shuffled but
    those of the result. A value is told by the least id that has it: a task holds one integer an id, gathered as blocks of
    them, and all pairs are far more than that. Ids are fewer than 2 ** 26, or there would be 2 ** 51 pairs."""
    s = Scratch(ids.sparkSession)
    ids = s.table(ids.select("id", same), "ids")
    least = s.table(ids.where(F.col(same).isNotNull()).groupBy(same).agg(F.min("id").alias("of")), "least")
    in_order = lambda c, by: F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c])
    told = ids.join(small(least), same, "left").select("id", F.coalesce("of", F.lit(-1)).cast("int").alias("of"))
    blocks = s.table(told.groupBy(F.floor(F.col("id") / block).alias("b")).agg(in_order("of", "id").alias("v")), "blocks")
    values = s.table(blocks.agg(F.flatten(in_order("v", "b")).alias("v")), "values").scalar()
    if (n := ids.count()) >= 1 << 26:
        raise ValueError(f"{n} ids have more pairs than can be counted through")
    total = n * (n - 1) // 2
    tasks = min(20_000, max(int(s.spark.conf.get("spark.sql.shuffle.partitions")), total // task_pairs + 1))
    # numbers below 2 ** 53 are exact as doubles, and so is which root a pair has; longs would be checked for overflow at each step
    p = s.spark.range(0, total, 1, tasks).select(F.col("id").cast("double").alias("k"))
    p = p.select("k", F.floor((F.sqrt(F.col("k") * 8 + 1) + 1) * 0.5).alias("id2"))
    p = p.select("k", "id2", F.col("id2").cast("double").alias("j"))
    p = p.select(F.floor(F.col("k") - F.col("j") * (F.col("j") - 1) * 0.5).alias("id1"), "id2")
    p = p.select("id1", "id2", F.get(values, F.col("id1")).alias("s1"), F.get(values, F.col("id2")).alias("s2"))
    return p.select("id1", "id2", F.when((F.col("s1") >= 0) & (F.col("s2") >= 0), (F.col("s1") == F.col("s2")).cast("int")).alias("label"))


def wiese(df: DataFrame) -> DataFrame:
    """(pos, cluster_id, names, emails) from ``id#=#n1#;#..##=#e1#;#..`` lines."""
    halves = F.split("value", "##=#")
    left = F.get(halves, F.lit(0))
    parts = F.split(left, "#=#")
    cluster = F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(F.regexp_replace(left, "#=$", ""))
    items = lambda c: F.filter(F.transform(F.split(c, "#;#|#$"), T.strip), lambda x: x != "")
    names = F.when(F.size(parts) == 2, items(F.get(parts, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return df.where(F.size(halves) == 2).select("pos", T.strip(cluster).alias("cluster_id"), names.alias("names"), items(F.get(halves, F.lit(1))).alias("emails"))


def wiese_pairs(clusters: DataFrame) -> DataFrame:
    """All pairs of email occurrences, equal if of one cluster."""
    e = clusters.select("pos", "cluster_id", F.posexplode("emails").alias("k", "email"))
    numbered = _numbered(e.withColumn("at", F.struct("pos", "k")), ["pos", "k", "cluster_id"], "at", "id")
    return _all_pairs(numbered.withColumn("id", F.col("id") - 1), "cluster_id")


def wiese_developers(clusters: DataFrame, devs: DataFrame) -> DataFrame:
    """(id, alias_name, alias_email, cluster_id) of developers whose email has a cluster; of an
    email's clusters the last line's counts."""
    by_email = clusters.select("pos", "cluster_id", F.explode("emails").alias("alias_email")).groupBy("alias_email").agg(F.max_by("cluster_id", "pos").alias("cluster_id"))
    return _numbered(devs.join(by_email, "alias_email"), ["alias_name", "alias_email", "cluster_id"], "pos", "id").withColumn("id", F.col("id") - 1)


def noreply_lines(df: DataFrame) -> DataFrame:
    return df.where(F.contains("value", F.lit("@users.noreply.github.com")))
