"""Queries of line formats, files, text functions and streams over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.config import Config
from kinloom.functions import text as T
from kinloom.functions.normalize import clean_text, unicode_udf
from kinloom.operators import curate, describe, evaluate, resolve
from kinloom.operators.keys import FLAGS, aliases
from kinloom.plans import resolution_sql
from kinloom.plans.catalogue import ERRORS_SQL, GROUP_SQL, LINES_SQL, NOREPLY_SQL, Query, group_view, lines_view, noreply_view, people_view, table
from kinloom.plans.scratch import Scratch
from kinloom.sources import files, parsers, sinks
from kinloom.streaming import qa

PEOPLE = resolution_sql.PEOPLE.replace("WORDS", resolution_sql.WORDS_SQL)
REPO_SQL = "SELECT 'u' || (o_custkey % 50) || '_r' || (o_orderkey % 97) AS repo, 'a' || o_custkey || ' <a' || o_custkey || '@users.noreply.github.com>' AS author, 'c' || o_orderkey AS commit, CAST(o_orderkey * 3 AS BIGINT) AS time FROM orders"


def view(name: str, *columns: str) -> Query:
    return lambda spark, sf_dir: table(spark, sf_dir, name).selectExpr(*columns)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('u', o_custkey % 50, '_r', o_orderkey % 97) repo", "concat('a', o_custkey, ' <a', o_custkey, case when o_custkey % 2 = 0 then '@users.noreply.github.com>' else '@x.org>' end) author", "concat('c', o_orderkey) commit", "o_orderkey * 3 time"
    )


# ---- line formats --------------------------------------------------------------------------


def trailing_username(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three forms with a login at the end, two customers a line's number; some have no name."""
    line = """case c_custkey div 2 % 4 when 0 then concat('N', c_custkey div 2, ' X <e', c_custkey div 2, '@x.org>') when 1 then concat('N', c_custkey div 2, ';e', c_custkey div 2, '@x.org')
      when 2 then concat('N', c_custkey div 2, ' e', c_custkey div 2, '@x.org') else concat(';e', c_custkey div 2, '@x.org') end"""
    return parsers.parse_aliases(view("customer", "c_custkey pos", f"concat({line}, ';', 'login', c_nationkey % 2) value")(spark, sf_dir), True)


def git_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of orders, some broken."""
    return view("orders", "o_orderkey pos", "concat('n', o_custkey % 90, ';m', o_custkey, '@x.org', case when o_orderkey % 7 = 0 then '' else concat(';', o_orderstatus, ';', o_orderpriority, ';more') end) value")(spark, sf_dir)


def tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in UTF-8 or Latin-1 by turns."""
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  é"), "p_name", F.lit("\t ")).alias("t"))
    d = d.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.encode("t", "UTF-8")).otherwise(F.encode("t", "ISO-8859-1")).alias("raw"))
    return parsers.decoded(d)


def invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("é"), "p_name").alias("t"))
    return curate.invalid_lines(d.select("pos", F.when(F.col("pos") % 3 > 0, F.encode("t", "UTF-8")).otherwise(F.encode("t", "ISO-8859-1")).alias("raw")))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster lines of suppliers: with names or without, with one or two addresses, and lines of no such form."""
    line = """concat('k', s_nationkey, case s_suppkey % 3 when 0 then concat('#=#', s_name, '#;#', s_name, ' II') when 1 then '#=' else '' end,
      case when s_suppkey % 10 = 9 then '' else concat('##=#s', s_suppkey, '@x.org', case when s_suppkey % 2 = 0 then concat('#;# t', s_suppkey div 4, '@x.org #;#') else '' end) end)"""
    return parsers.wiese(view("supplier", "s_suppkey pos", f"{line} value")(spark, sf_dir))


CLUSTERS_SQL = """SELECT s_suppkey AS pos, 'k' || s_nationkey AS cluster_id, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['s' || s_suppkey || '@x.org', 't' || s_suppkey // 4 || '@x.org'] ELSE ['s' || s_suppkey || '@x.org'] END) AS email,
  unnest(CASE WHEN s_suppkey % 2 = 0 THEN [0, 1] ELSE [0] END) AS k FROM supplier WHERE s_suppkey % 10 <> 9"""


def developers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.developers(view("customer", "c_custkey pos", """concat(' "', c_name, ' <', case when c_custkey % 3 = 0 then concat('s', c_custkey) else concat('t', c_custkey div 4) end, case when c_custkey % 5 = 0 then '"' else '@x.org>"' end) value""")(spark, sf_dir))


DEVELOPERS_SQL = "SELECT c_custkey AS pos, c_name AS alias_name, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey ELSE 't' || c_custkey // 4 END || '@x.org' AS alias_email FROM customer WHERE c_custkey % 5 <> 0"


# ---- files ---------------------------------------------------------------------------------


def text_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written in order and read back with their numbers."""
    path = Scratch(spark).path("text")
    table(spark, sf_dir, "part").orderBy("p_partkey").coalesce(1).select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("value")).write.text(path)
    return parsers.lines(spark, path)


def resolution_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolution of people as its file has it."""
    s, config = Scratch(spark), Config()
    df = s.table(people_view(spark, sf_dir), "people")
    a = s.table(aliases(df, config), "prepared")
    found = s.table(resolve.report(df, resolve.resolve(df, config, scratch=s, prepared=a), a, "p"), "report")
    sinks.write_resolution(found, path := s.path("resolution"))
    return files.read_commits(spark, path)


def commit_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.write_commits(commits(spark, sf_dir).withColumn("author", F.concat("author", F.lit(' "x"; y'))), path := Scratch(spark).path("commits"))
    return files.read_csv(spark, path, ";", "repo string, author string, commit string, time long")


def lookup_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.write_lookup(commits(spark, sf_dir), "author", path := Scratch(spark).path("lookup"))
    return spark.read.text(path)


def group_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of groups, written and read back."""
    g = group_view(spark, sf_dir)
    sinks.write_groups(evaluate.per_group(g), evaluate.merge_reasons(g.withColumn("cluster", F.col("cluster").cast("string"))), path := Scratch(spark).path("groups"))
    return files.read_csv(spark, f"{path}/per_username").join(files.read_csv(spark, f"{path}/results").select("username", "all_merged"), "username")


def noreply_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary, and of the other six files the number of rows."""
    found = describe.noreply_files(Scratch(spark).table(describe.noreply_users(noreply_view(spark, sf_dir)), "users"))
    sinks.write_files(found, path := Scratch(spark).path("noreply"))
    out = files.read_csv(spark, f"{path}/summary", schema="step string, count long, description string").select("step", "count")
    for name in found:
        if name != "summary":
            out = out.union(files.read_csv(spark, f"{path}/{name}").agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("count")))
    return out


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as JSON and back."""
    d = table(spark, sf_dir, "documents").select(files.to_row("doc_id", "text", "lang", "source").alias("j"))
    return d.select(files.from_row("j", "doc_id long, text string, lang string, source string").alias("r")).select("r.*")


# ---- clusters of other tools ---------------------------------------------------------------


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand follow the part before, by size."""
    d = table(spark, sf_dir, "part")
    m = d.where("p_partkey % 6 > 0").selectExpr("concat('p', p_partkey) source", "concat('p', p_partkey - 1) target")
    return evaluate.mapped(d.selectExpr("p_partkey id", "concat('p', p_partkey) alias"), m)


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part")
    return evaluate.external(d.selectExpr("p_partkey id", "p_name alias"), d.where("p_size > 5").selectExpr("p_partkey id", "p_size author_id"))


def assignments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = commits(spark, sf_dir).select(F.col("author").alias("alias")).distinct()
    return d, d.where(F.length("alias") % 3 > 0).select(F.col("alias").alias("searched"), F.substring("alias", 1, 2).alias("assigned"))


# ---- streams -------------------------------------------------------------------------------


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The rows that a stream gives for all that is there now, from a table in the shared folder."""
    s = Scratch(stream.sparkSession)
    out = s.path(name)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", s.path("state")).trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def stream_line_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of lines that arrive in eight files, two at a time."""
    path = Scratch(spark).path("arriving")
    lines_view(spark, sf_dir).repartition(8, "pos").select("value").write.text(path)
    checked = finished(qa.stream_line_qa(qa.stream_lines(spark, path, 2)), "checked")
    return checked.groupBy(F.array_join("errors", ", ").alias("errors"), "clean").agg(F.count(F.lit(1)).alias("n"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the windows that the watermark, a day before the last event, has closed."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    return finished(qa.stream_counts(stream), "counts").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _on(v: Query, f) -> Query:
    return lambda spark, sf_dir: f(v(spark, sf_dir))


def queries() -> dict[str, Query]:
    part = view("part", "*")
    accents = view("documents", "doc_id", "concat(text, 'é É', lang, '­​') t")
    return {
        "trailing_username": trailing_username,
        "project_lookup": lambda s, d: parsers.project_authors(commits(s, d).withColumnRenamed("repo", "project"), "u7_r7"),
        "git_log_parse": _on(git_log, parsers.parse_git_log),
        "git_log_aliases": _on(git_log, files.log_aliases),
        "tolerant_lines": tolerant,
        "invalid_lines": invalid,
        "wiese_clusters": _on(clusters, lambda x: x.select("pos", "cluster_id", F.size("names").alias("names"), F.array_join("emails", " ").alias("emails"))),
        "wiese_pairs": _on(clusters, parsers.wiese_pairs),
        "developer_list": developers,
        "wiese_developers": lambda s, d: parsers.wiese_developers(clusters(s, d), developers(s, d)),
        "noreply_lines": _on(commits, lambda x: parsers.noreply_lines(x.select("commit", F.col("author").alias("value")))),
        "relation_parse": _on(commits, lambda x: parsers.relation(x.select(F.concat("repo", F.lit(";"), "author", F.lit(";x")).alias("value")), "repo", "author").distinct()),
        "text_file": text_file,
        "resolution_file": resolution_file,
        "commit_file": commit_file,
        "lookup_file": lookup_file,
        "group_files": group_files,
        "noreply_files": noreply_files,
        "json_rows": json_rows,
        "mapped_clusters": mapped,
        "external_clusters": external,
        "assigned_clusters": lambda s, d: evaluate.assigned(*assignments(s, d)),
        "coverage": lambda s, d: evaluate.coverage(*assignments(s, d)),
        "first_groups": _on(group_view, lambda x: evaluate.first_groups(x, 10)),
        "second_column": _on(commits, lambda x: describe.second_column(x, "author")),
        "commit_times": lambda s, d: describe.commit_times(commits(s, d).select("author", "commit"), commits(s, d).select("commit", "time")),
        "lower_nfc": _on(accents, lambda x: x.select("doc_id", unicode_udf()(F.lower("t")).alias("v"))),
        "strip_marks": _on(accents, lambda x: x.select("doc_id", unicode_udf("NFD", False)(F.lower("t")).alias("v"))),
        "control_chars": _on(accents, lambda x: x.select("doc_id", clean_text(F.concat("t", F.lit("\x01\x7f\x9f\n"))).alias("v"))),
        "punctuation": _on(accents, lambda x: x.select("doc_id", T.strip_punctuation(F.col("t")).alias("v"))),
        "german_map": _on(accents, lambda x: x.select("doc_id", T.universal(F.lower("t"), True).alias("v"))),
        "quoted_lines": _on(lines_view, lambda x: x.select("pos", T.quoted_line(F.concat(F.lit("a, "), "value")).alias("v"))),
        "plain_lines": _on(lines_view, lambda x: x.select("pos", T.plain_line(F.col("value")).alias("v"))),
        "abbreviation": _on(part, lambda x: x.select("p_partkey", T.is_abbreviation(F.concat(F.substring("p_name", 1, 1), F.when(F.col("p_partkey") % 3 > 0, ".").otherwise("x")), F.upper(F.substring("p_name", F.lit(1) + (F.col("p_partkey") % 2).cast("int"), F.lit(9)))).alias("v"))),
        "capitalization": _on(part, lambda x: x.select("p_partkey", T.capitalization(F.expr("case p_partkey % 4 when 0 then initcap(p_name) when 1 then p_name when 2 then upper(p_name) else concat(p_name, ' X y') end")).alias("v"))),
        "username_forms": _on(commits, lambda x: x.select("commit", T.canonical_username(F.concat(F.lit(" @"), F.upper("author"))).alias("v"), T.repo_owner(F.col("repo")).alias("owner"))),
        "stream_line_qa": stream_line_qa,
        "stream_counts": stream_counts,
    }


def oracle_sql() -> dict[str, str]:
    config = Config()
    c = f"c AS ({REPO_SQL.replace("'@users.noreply.github.com>'", "CASE WHEN o_custkey % 2 = 0 THEN '@users.noreply.github.com>' ELSE '@x.org>' END")})"
    accents = "a AS (SELECT doc_id, text || 'é É' || lang || '­​' AS t FROM documents)"
    log = "l AS (SELECT o_orderkey AS pos, 'n' || (o_custkey % 90) AS name, 'm' || o_custkey || '@x.org' AS email, o_orderstatus AS date, o_orderpriority || ';more' AS timestamp FROM orders WHERE o_orderkey % 7 <> 0)"
    assigned = f"{c}, a AS (SELECT DISTINCT author AS alias FROM c), b AS (SELECT alias, CASE WHEN length(alias) % 3 > 0 THEN substring(alias, 1, 2) END AS t FROM a)"
    german = resolution_sql._replaced("lower(t)", T.GERMAN)
    universal = f"translate({resolution_sql._replaced(german, T.ONE_TO_MANY)}, '{T.ONE_TO_ONE[0]}', '{T.ONE_TO_ONE[1]}')"
    marks = T.PUNCTUATION.replace("'", "''")
    white = r"'^\s+|\s+$', '', 'g'"
    halves = f"""v AS (SELECT pos, regexp_replace(LINE, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{7F}}-\\x{{9F}}]', '', 'g') AS v FROM ({LINES_SQL})),
      h AS (SELECT pos, v, trim(split_part(v, ';', 1)) AS x, trim(regexp_replace(v, '^[^;]*;', '')) AS y FROM v)"""
    quoted = lambda x: f"""CASE WHEN contains({x}, '"') OR contains({x}, ',') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""
    flags = ", ".join(f"CASE WHEN {f} THEN 'True' WHEN NOT {f} THEN 'False' END" for f in FLAGS)
    signature = lambda p: f"coalesce({p}.name, '') || ' <' || coalesce({p}.email, '') || '>'"
    users = f"""u0 AS (SELECT author, project, regexp_extract(author, '<([^>]+)>\\s*$', 1) AS email FROM ({NOREPLY_SQL})),
      u AS (SELECT *, split_part(email, '@', 1) AS username, nullif(regexp_extract(email, '^(\\d+)\\+', 1), '') AS id, regexp_replace(split_part(email, '@', 1), '^\\d+\\+', '') AS plain FROM u0),
      z AS (SELECT count(*) AS authors_in, count(DISTINCT author) AS authors, count(DISTINCT project) AS projects, count(DISTINCT email) AS emails, count(DISTINCT username) AS usernames, count(DISTINCT id) AS ids,
        count(DISTINCT username) FILTER (id IS NOT NULL) AS with_id, count(DISTINCT username) FILTER (id IS NULL) AS without_id, count(DISTINCT username) FILTER (id IS NOT NULL) AS prefixes,
        count(DISTINCT plain) AS merged, (SELECT count(*) FROM (SELECT plain FROM u GROUP BY 1 HAVING count(id) > 0 AND count(*) > count(id))) AS merges, count(DISTINCT username) - count(DISTINCT plain) AS reduction FROM u)"""
    counts = {s: n for n, (s, _) in describe.SUMMARY.items()} | {"uniqueAuthorStrings": "authors", "uniqueEmailStrings": "emails", "uniqueUsernameStrings": "usernames", "uniqueUsernames": "merged", "uniqueNumericIds": "ids", "uniqueProjects": "projects"}
    ratio = lambda x, f="%.4f": f"printf('{f}', CAST({x} AS DOUBLE))"
    return {
        "trailing_username": """WITH l AS (SELECT c_custkey AS pos, CASE c_custkey // 2 % 4 WHEN 3 THEN 'login' || c_nationkey % 2 WHEN 0 THEN 'N' || c_custkey // 2 || ' X' ELSE 'N' || c_custkey // 2 END AS name, 'e' || c_custkey // 2 || '@x.org' AS email, 'login' || c_nationkey % 2 AS login FROM customer)
          SELECT row_number() OVER (ORDER BY min(pos)) AS uid, name, email, login FROM l GROUP BY name, email, login""",
        "project_lookup": f"WITH {c} SELECT DISTINCT split_part(author, ' <', 1) AS name, rtrim(split_part(author, '<', 2), '>') AS email FROM c WHERE repo = 'u7_r7'",
        "git_log_parse": f"WITH {log} SELECT * FROM l",
        "git_log_aliases": f"WITH {log} SELECT row_number() OVER (ORDER BY min(pos)) AS uid, name, email FROM l GROUP BY name, email",
        "tolerant_lines": "SELECT p_partkey, p_partkey % 2 = 0 AS valid, trim('é' || p_name) AS value FROM part",
        "invalid_lines": "SELECT p_partkey AS line_number, p_partkey || ':é' || p_name AS line FROM part WHERE p_partkey % 3 = 0",
        "wiese_clusters": f"SELECT pos, cluster_id, CASE WHEN pos % 3 = 0 THEN 2 ELSE 0 END AS names, string_agg(email, ' ' ORDER BY k) AS emails FROM ({CLUSTERS_SQL}) GROUP BY 1, 2",
        "wiese_pairs": f"WITH e AS (SELECT *, row_number() OVER (ORDER BY pos, k) - 1 AS id FROM ({CLUSTERS_SQL})) SELECT x.id AS id1, y.id AS id2, CAST(x.cluster_id = y.cluster_id AS INT) AS label FROM e x JOIN e y ON x.id < y.id",
        "developer_list": DEVELOPERS_SQL,
        "wiese_developers": f"""WITH m AS (SELECT email, max_by(cluster_id, pos) AS cluster_id FROM ({CLUSTERS_SQL}) GROUP BY 1), d AS (SELECT min(pos) AS pos, alias_name, alias_email, cluster_id FROM ({DEVELOPERS_SQL}) JOIN m ON email = alias_email GROUP BY 2, 3, 4)
          SELECT row_number() OVER (ORDER BY pos) - 1 AS id, alias_name, alias_email, cluster_id FROM d""",
        "noreply_lines": f"WITH {c} SELECT commit, author AS value FROM c WHERE author LIKE '%@users.noreply.github.com%'",
        "relation_parse": f"WITH {c} SELECT DISTINCT repo, author || ';x' AS author FROM c",
        "text_file": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name || ' ' || p_partkey AS value FROM part",
        "resolution_file": f"""WITH {resolution_sql.represented(config)}, m AS (SELECT al.uid, coalesce(rep_uid, al.uid) AS rep_uid FROM al LEFT JOIN rep ON rep.uid = al.uid)
          SELECT 'p' AS project, {signature("x")} AS original_author_id, {signature("y")} AS dealiased_author_id, '(' || concat_ws(', ', {flags}) || ')' AS is_original_author_weird_id
          FROM m JOIN ({PEOPLE}) x ON x.uid = m.uid JOIN ({PEOPLE}) y ON y.uid = m.rep_uid JOIN ({resolution_sql.flags(PEOPLE, config)}) f ON f.uid = m.uid""",
        "commit_file": f"WITH {c} SELECT repo, author || ' \"x\"; y' AS author, commit, time FROM c",
        "lookup_file": f"WITH {c} SELECT DISTINCT author AS value FROM c",
        "group_files": f"""WITH g AS ({GROUP_SQL}), s AS (SELECT grp, cluster, count(*) AS k FROM g GROUP BY 1, 2), h AS (SELECT grp, sum(k) AS n, count(*) AS m, sum(k * (k - 1) // 2) AS tp FROM s GROUP BY 1),
          e AS (SELECT *, n * (n - 1) // 2 AS every, CASE WHEN n = 1 THEN 1 ELSE tp / (n * (n - 1) // 2) END AS r, CASE WHEN n = 1 OR tp > 0 THEN 1 ELSE 0 END AS p FROM h)
          SELECT grp AS username, CAST(CAST(n AS BIGINT) AS VARCHAR) AS num_authors, {ratio("r * 100", "%.2f")} AS merge_percentage, {ratio("p")} AS precision, {ratio("r")} AS recall, {ratio("CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END")} AS f1, {ratio("r")} AS accuracy,
            {ratio("CASE WHEN n = 1 THEN 1 ELSE r / 2 END")} AS balanced_accuracy, {ratio("CASE WHEN n = 1 THEN 0 ELSE 1 - r END")} AS splitting, '0.0000' AS lumping, CAST(m = 1 AS VARCHAR) AS all_merged FROM e""",
        "noreply_files": f"WITH {users} " + " UNION ALL ".join(f"SELECT '{step}' AS step, {n} AS count FROM z" for step, n in counts.items()),
        "json_rows": "SELECT doc_id, text, lang, source FROM documents",
        "mapped_clusters": "SELECT p_partkey AS id, min('p' || p_partkey) OVER (PARTITION BY p_partkey // 6) AS cluster FROM part",
        "external_clusters": "SELECT p_partkey AS id, CASE WHEN p_size > 5 THEN CAST(p_size AS VARCHAR) ELSE 'own ' || p_partkey END AS cluster FROM part",
        "assigned_clusters": f"WITH {assigned} SELECT alias, coalesce(t, alias) AS cluster FROM b",
        "coverage": f"WITH {assigned} SELECT count(*) AS authors, count(t) AS mapped, count(t) / count(*) AS coverage FROM b",
        "first_groups": f"WITH g AS ({GROUP_SQL}) SELECT * FROM g WHERE grp IN (SELECT grp FROM g GROUP BY 1 ORDER BY min(pos) LIMIT 10)",
        "second_column": f"WITH {c} SELECT DISTINCT author FROM c",
        "commit_times": f"WITH {c} SELECT commit, time FROM c WHERE author LIKE '%@users.noreply.github.com%'",
        "lower_nfc": f"WITH {accents} SELECT doc_id, nfc_normalize(lower(t)) AS v FROM a",
        "strip_marks": f"WITH {accents} SELECT doc_id, strip_accents(lower(t)) AS v FROM a",
        "control_chars": f"WITH {accents} SELECT doc_id, regexp_replace(nfc_normalize(t), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{7F}}-\\x{{9F}}\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}]', '', 'g') || chr(10) AS v FROM a",
        "punctuation": f"WITH {accents} SELECT doc_id, regexp_replace(regexp_replace(t, '{marks}', '', 'g'), {white}) AS v FROM a",
        "german_map": f"WITH {accents} SELECT doc_id, {universal} AS v FROM a",
        "quoted_lines": f"WITH {halves.replace('LINE', "'a, ' || value")} SELECT pos, CASE WHEN contains(v, ';') THEN {quoted('x')} || ';' || {quoted('y')} END AS v FROM h",
        "plain_lines": f"""WITH {halves.replace("LINE", "value")} SELECT pos, CASE WHEN contains(v, ';') THEN replace(x, '"', '') || ';' || replace(y, '"', '') END AS v FROM h""",
        "abbreviation": "SELECT p_partkey, p_partkey % 3 > 0 AND lower(substring(p_name, 1 + p_partkey % 2, 1)) = lower(substring(p_name, 1, 1)) AS v FROM part",
        "capitalization": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS v FROM part",
        "username_forms": f"WITH {c} SELECT commit, lower(author) AS v, split_part(repo, '_', 1) AS owner FROM c",
        "stream_line_qa": f"SELECT array_to_string(errors, ', ') AS errors, len(errors) = 0 AS clean, count(*) AS n FROM ({ERRORS_SQL}) GROUP BY 1, 2",
        "stream_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2",
    }
