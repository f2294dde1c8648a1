"""The queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.config import LABELS, Config
from kinloom.functions import text as T
from kinloom.functions.normalize import forms_udf
from kinloom.operators import curate, describe, evaluate, resolve
from kinloom.operators.components import connected_components
from kinloom.operators.keys import FLAGS, aliases, key_rows
from kinloom.plans import resolution_sql
from kinloom.plans.scratch import Scratch
from kinloom.sources import parsers, sinks

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- views that stand in for identity data -------------------------------------------------

ALIAS_SQL = r"""
  SELECT doc_id + 1 AS uid, array_to_string(w[1:2], ' ') AS name,
         lower(array_to_string(w[1:2], '.')) || '@' || source || '.example.' || lang AS email, source AS location, lang AS login
  FROM (SELECT *, regexp_extract_all(text, '\p{L}+') AS w FROM documents)"""
P2A_SQL = "SELECT DISTINCT 'u' || (o_custkey % 50) || '_r' || (o_orderkey % 997) AS repo, 'a' || o_custkey AS author FROM orders"
OWNER_SQL = """SELECT c_custkey AS pos, c_mktsegment || '_' || c_nationkey AS owner,
  'a' || (CASE WHEN c_custkey % 3 = 0 THEN c_custkey - c_custkey % 6 ELSE c_custkey END) AS author,
  CASE WHEN c_nationkey % 7 = 0 THEN 1 ELSE 0 END AS org_flag FROM customer"""
NOREPLY_SQL = """SELECT 'User ' || user_id || ' <' || (CASE WHEN event_id % 3 = 0 THEN user_id || '+' ELSE '' END) || 'user' || user_id % 97 || '@users.noreply.github.com>' AS author,
  event_type || '_' || event_id % 50 || (CASE WHEN event_id % 10 = 0 THEN '/x' ELSE '' END) AS project FROM events"""


def alias_view(spark: SparkSession, sf_dir: str, more: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("w", F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)))
    email = F.concat(F.lower(F.array_join(F.slice("w", 1, 2), ".")), F.lit("@"), "source", F.lit(".example."), "lang")
    extra = [F.col("source").alias("location"), F.col("lang").alias("login")] if more else []
    return d.select((F.col("doc_id") + 1).alias("uid"), F.array_join(F.slice("w", 1, 2), " ").alias("name"), email.alias("email"), *extra)


def people_view(spark: SparkSession, sf_dir: str, more: bool = False) -> DataFrame:
    """Four aliases a document, with names and addresses of all kinds that rules are about. They are made of its first three
    words, wherever in the text these are; no list of all words is made for that."""
    three = F.regexp_extract("text", r"^(?:\P{L}*+\p{L}++){0,3}", 0)
    w = F.regexp_extract_all(three, F.lit(r"\p{L}+"), F.lit(0))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("p"), F.col("source").alias("s"), F.col("lang").alias("g"), w.alias("w"))
    d = d.select("p", "s", "g", *[F.coalesce(F.get("w", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate("abc")], F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    d = d.selectExpr("*", "lower(a) f", "lower(b) l", "lower(c) m")
    # SQL's upper case is one character of each; Spark's makes two of an ß and others, which other words may have
    upper = "array_join(transform(split(f, ''), x -> if(length(upper(x)) = 1, upper(x), x)), '')"
    extra = (f"{resolution_sql.LOGIN} login", f"{resolution_sql.PLACE} location") if more else ()
    return d.selectExpr("p * 4 + k + 1 uid", f"{resolution_sql.NAME} name", f"{resolution_sql.EMAIL.replace('upper(f)', upper)} email", *extra)


def p2a_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("concat('u', o_custkey % 50, '_r', o_orderkey % 997) repo", "concat('a', o_custkey) author").distinct()


def owner_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey pos", "concat(c_mktsegment, '_', c_nationkey) owner", "concat('a', case when c_custkey % 3 = 0 then c_custkey - c_custkey % 6 else c_custkey end) author", "case when c_nationkey % 7 = 0 then 1 else 0 end org_flag"
    )


def noreply_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('User ', user_id, ' <', case when event_id % 3 = 0 then concat(user_id, '+') else '' end, 'user', user_id % 97, '@users.noreply.github.com>') author",
        "concat(event_type, '_', event_id % 50, case when event_id % 10 = 0 then '/x' else '' end) project",
    )


def group_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner groups whose clusters are authors by number."""
    return owner_view(spark, sf_dir).selectExpr("owner grp", "cast(substring(author, 2) as bigint) % 3 cluster", "author alias", "pos", "org_flag")


GROUP_SQL = f"SELECT owner AS grp, CAST(substring(author, 2) AS BIGINT) % 3 AS cluster, author AS alias, pos, org_flag FROM ({OWNER_SQL})"


def lines_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all kinds from parts: clean ones and each defect."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey pos",
        """case p_partkey % 9 when 0 then p_name when 1 then concat(p_name, repeat(';', 11), p_brand) when 2 then concat(p_name, ';"', p_brand)
        when 3 then concat(p_name, ';', char(1), p_brand) when 4 then concat(repeat('x', 1001), ';', p_brand) when 5 then concat(p_name, ';', repeat('y', 5001))
        when 6 then concat(repeat('z', 10001), '"') else concat(p_name, ';', p_brand) end value""",
    )


LINES_SQL = """SELECT p_partkey AS pos, CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN p_name || repeat(';', 11) || p_brand WHEN 2 THEN p_name || ';"' || p_brand
  WHEN 3 THEN p_name || ';' || chr(1) || p_brand WHEN 4 THEN repeat('x', 1001) || ';' || p_brand WHEN 5 THEN p_name || ';' || repeat('y', 5001)
  WHEN 6 THEN repeat('z', 10001) || '"' ELSE p_name || ';' || p_brand END AS value FROM part"""
ERRORS_SQL = f"""SELECT pos, value, list_filter([
  CASE WHEN regexp_matches(value, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') THEN 'control_chars' END, CASE WHEN s = 0 THEN 'no_semicolon' END, CASE WHEN s > 10 THEN 'too_many_semicolons(' || s || ')' END,
  CASE WHEN (length(value) - length(replace(value, '"', ''))) % 2 = 1 THEN 'unbalanced_quotes' END, CASE WHEN length(value) > 10000 THEN 'line_too_long(' || length(value) || ')' END,
  CASE WHEN s > 0 AND length(split_part(value, ';', 1)) > 1000 THEN 'repo_too_long(' || length(split_part(value, ';', 1)) || ')' END,
  CASE WHEN s > 0 AND length(regexp_replace(value, '^[^;]*;', '')) > 5000 THEN 'author_too_long(' || length(regexp_replace(value, '^[^;]*;', '')) || ')' END], lambda x: x IS NOT NULL) AS errors
  FROM (SELECT *, length(value) - length(replace(value, ';', '')) AS s FROM ({LINES_SQL}))"""


# ---- queries -------------------------------------------------------------------------------


def _docs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def _prepared(spark: SparkSession, sf_dir: str, config: Config, more: bool = True, view=people_view):
    s = Scratch(spark)
    a = s.table(aliases(view(spark, sf_dir, more), config), "aliases")
    return s, a, s.table(resolve.sized_keys(key_rows(a, config), s), "keys")


def rule_query(option: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = Config(rules=frozenset([option]))
        s, a, keys = _prepared(spark, sf_dir, config)
        blocks = resolve.dense_blocks(keys, config, s)
        listed = resolve.candidate_pairs(a, keys, config, blocks).select("grp", "a", "b", "rule").distinct()
        if not blocks:
            return listed.drop("grp")
        marked = blocks.mark(listed.select("grp", "a", "b", F.array("rule").alias("rules")))
        return marked.select("a", "b", F.lit(blocks.label).alias("rule")).union(blocks.pairs().select("a", "b", F.lit(blocks.label)))

    return run


def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = Config()
    s, a, keys = _prepared(spark, sf_dir, config, False)
    c, blocks = resolve.listed_clues(a, keys, config, s)
    d = resolve.decide(c).select("a", "b", F.array_join("rules", ",").alias("rules"), F.array_join("accepted", ",").alias("accepted"))
    return d.union(blocks.pairs().select("a", "b", F.lit(blocks.label), F.lit(blocks.label))) if blocks else d


def cluster_state(spark: SparkSession, sf_dir: str):
    config = Config()
    s, a, keys = _prepared(spark, sf_dir, config, False)
    c, blocks = resolve.listed_clues(a, keys, config, s)
    members, counts = resolve.clusters(resolve.decide(c), s, blocks)
    return a, members, counts, config


def cluster_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, members, counts, config = cluster_state(spark, sf_dir)
    return resolve.validity(a, members, counts, config)


def rule_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_state(spark, sf_dir)[2]


def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, members, counts, config = cluster_state(spark, sf_dir)
    return resolve.representatives(a, members, resolve.validity(a, members, counts, config), False)


def resolve_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(people_view(spark, sf_dir))


def resolve_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language resolved by itself, in one run."""
    d = alias_view(spark, sf_dir, True).withColumnRenamed("login", "lang").drop("location")
    return resolve.resolve(d, group="lang")


def name_email_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by equal email or equal lower-cased name, without block bounds."""
    a = alias_view(spark, sf_dir).select("uid", F.lower("name").alias("n"), "email")
    edges = None
    for c in ("n", "email"):
        first = a.where(F.col(c) != "").groupBy(c).agg(F.min("uid").alias("a"))
        e = a.join(first, c).select("a", F.col("uid").alias("b"))
        edges = e if edges is None else edges.union(e)
    return connected_components(edges).select(F.col("node").alias("uid"), F.col("label").alias("cid"))


def weird_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases(people_view(spark, sf_dir), Config()).select("uid", *FLAGS)


def normalize_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = people_view(spark, sf_dir).select("name").distinct()
    forms = F.get(forms_udf(Config())(F.array("name")), F.lit(0))
    return names.select("name", F.explode(forms).alias("form"))


def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, a, keys = _prepared(spark, sf_dir, Config(), True, alias_view)
    return keys.where("kind in ('email', 'domain', 'domain_main', 'login', 'location')").select("kind", "key", "n").distinct()


def truth_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled pairs of neighbouring documents, and clusters by source."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("cluster"), "lang")
    other = d.select(F.col("id").alias("id2"), F.col("lang").alias("l2"))
    pairs = d.select(F.col("id").alias("id1"), "lang", (F.col("id") + 20).alias("id2")).join(other, "id2").select("id1", "id2", (F.col("lang") == F.col("l2")).cast("int").alias("label"))
    return pairs, d.select("id", F.when(F.col("id") % 7 > 0, F.col("cluster")).alias("cluster")).where("cluster is not null")


TRUTH_SQL = """p AS (SELECT a.doc_id AS id1, b.doc_id AS id2, CAST(a.lang = b.lang AS INT) AS label FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 20),
c AS (SELECT doc_id AS id, source AS cluster FROM documents WHERE doc_id % 7 > 0 AND source IS NOT NULL),
j AS (SELECT id1, id2, label, CASE WHEN x.cluster = y.cluster AND label = 1 THEN 'tp' WHEN x.cluster = y.cluster THEN 'fp' WHEN x.cluster <> y.cluster AND label = 1 THEN 'fn' WHEN x.cluster <> y.cluster THEN 'tn' END AS outcome
  FROM p LEFT JOIN c x ON x.id = id1 LEFT JOIN c y ON y.id = id2)"""
COUNT_SQL = "m AS (SELECT count_if(outcome = 'tp') AS tp, count_if(outcome = 'fp') AS fp, count_if(outcome = 'tn') AS tn, count_if(outcome = 'fn') AS fn, count(*) AS total_pairs FROM j)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.judged(*truth_pairs(spark, sf_dir))


def wrong(outcome: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = alias_view(spark, sf_dir).select((F.col("uid") - 1).alias("id"), "name", "email")
        return evaluate.errors(judged(spark, sf_dir), a, outcome)

    return run


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(evaluate.confusion(judged(spark, sf_dir)))


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly counts as text, as the files hold them."""
    d = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 4).alias("f")).count()
    return d.select(F.col("count").cast("string").alias("count"), F.col("y").cast("string").alias("year"))


def parse_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = alias_view(spark, sf_dir).select("uid", T.signature(F.col("name"), F.col("email")).alias("v"))
    return v.select("uid", parsers.parse_signature(F.col("v")).alias("p"), T.email_at_end(F.col("v")).alias("at_end")).select("uid", "p.name", "p.email", "at_end")


def utf8_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, of which three in four get one more byte that UTF-8 lacks: at the start, in the middle or at the end."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("v"), (F.col("doc_id") % 4).alias("k"))
    at = (F.octet_length("v") * F.col("k") / 2).cast("int") + 1
    d = d.withColumn("v", F.when(F.col("k") < 3, F.overlay("v", F.unhex(F.lit("FF")), at, F.lit(0))).otherwise(F.col("v")))
    return d.select("doc_id", F.is_valid_utf8(F.col("v").cast("string")).alias("valid"))


def alias_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All aliases, in the three forms of lines by turns."""
    v, form = alias_view(spark, sf_dir), F.col("uid") % 3
    line = F.when(form == 0, T.signature(F.col("name"), F.col("email"))).when(form == 1, F.concat("name", F.lit(";"), "email")).otherwise(F.concat("name", F.lit(" "), "email"))
    return parsers.parse_aliases(v.select(F.col("uid").alias("pos"), line.alias("value")))


def gt_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.matrix_pairs(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("row")))


def gt_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber pos", "concat('p', l_partkey) c0", "concat('s', l_suppkey) c1", "l_tax c2", "cast(l_returnflag = 'R' as int) c3")
    return parsers.pairwise(d)[1].groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("id1").alias("s1"), F.sum("id2").alias("s2"))


def gt_dre(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("dre_id"), F.concat(F.lit("w"), "user_id").alias("woc_id"))
    return parsers.dre_pairs(d)


def assignment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id pos", "concat(source, case when doc_id % 11 = 0 then '' else ';' end, lang, case when doc_id % 13 = 0 then ';x' else '' end) value")
    return parsers.parse_assignments(d)


def tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.unpivot(evaluate.per_group(group_view(spark, sf_dir)), ["merge_percentage", *evaluate.RATIOS])


def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.filtered_groups(group_view(spark, sf_dir), 14)[1]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = describe.sum_years(years(spark, sf_dir))
    return describe.series_summary(y, y.where("year % 2 = 0"))


def username_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("cluster_id"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).otherwise("").alias("username"))
    return resolve.username_mode(d).groupBy("cluster_id", "cluster_username").agg(F.count(F.lit(1)).alias("n"))


def org(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = owner_view(spark, sf_dir).select("owner", "author").distinct()
    types = o.select(F.upper("owner").alias("username"), F.when(F.length("owner") % 2 == 0, "Organization").otherwise("User").alias("type")).distinct()
    return curate.org_annotate(o, types)


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("project"), F.col("user_id").alias("author")).agg(F.count(F.lit(1)).alias("n"))
    return describe.core_contributors(d).select("project", "author", "n", "core")


def privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are left when aliases of privacy addresses are kept out of the indexes."""
    d = noreply_view(spark, sf_dir).select("author").distinct().select(F.xxhash64("author").alias("uid"), parsers.parse_signature(F.col("author")).alias("p")).select("uid", "p.name", "p.email")
    config = Config(exclude_privacy_emails_from_merging=True)
    return key_rows(Scratch(spark).table(aliases(d, config), "aliases"), config).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    p2a, own, nor = p2a_view, owner_view, noreply_view
    on = lambda view, f: lambda spark, d: f(view(spark, d))
    q: dict[str, Query] = {
        "resolve_identities": resolve_identities,
        "resolve_groups": resolve_groups,
        "alias_projection": lambda s, d: aliases(alias_view(s, d), Config()).select("uid", "name", "email", "prefix", "domain", "domain_main"),
        "normalize_forms": normalize_forms,
        "leet_map": _docs(lambda x: x.select("doc_id", T.leet(F.col("text")).alias("v"))),
        "universal_map": _docs(lambda x: x.select("doc_id", T.universal(F.lower("text")).alias("v"))),
        "title_strip": on(lambda s, d: table(s, d, "part"), lambda x: x.select("p_partkey", T.drop_titles(F.concat(F.lit("dr "), F.lower("p_name"), F.lit(" jr."))).alias("v"))),
        "year_strip": on(lambda s, d: table(s, d, "part"), lambda x: x.select("p_partkey", T.squeeze(T.strip_zones_and_years(T.strip_timestamp(F.concat(F.lit("13:37:28 gmt 1999 "), F.lower("p_name"), F.lit(" 2020"))))).alias("v"))),
        "german_context": on(alias_view, lambda x: x.select("uid", T.german_context(F.col("name"), T.email_domain(F.col("email"))).alias("german"))),
        "ill_encoded": _docs(lambda x: x.select("doc_id", T.ill_encoded(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).alias("ill"))),
        "blacklist_hits": on(alias_view, lambda x: x.select("uid", T.blacklisted(T.email_prefix(F.col("email")), ["admin", "info", "ther", "and.", "the"]).alias("hit"))),
        "weird_flags": weird_flags,
        "block_sizes": block_sizes,
        "privacy_exclusion": privacy,
        "components": name_email_components,
        "pair_decision": decision,
        "rule_label_counts": rule_label_counts,
        "cluster_validity": cluster_validity,
        "representative": representative,
        "username_mode": username_mode,
        "utf8_filter": utf8_filter,
        "line_qa": on(lines_view, lambda x: curate.problem_lines(curate.line_qa(x))),
        "line_qa_histogram": on(lines_view, lambda x: curate.error_histogram(curate.line_qa(x))),
        "single_author_repos": on(p2a, curate.single_author_repos),
        "owner_pairs": on(p2a, curate.owner_pairs),
        "duplicated_owners": on(p2a, lambda x: curate.duplicated_owners(curate.owner_pairs(x))),
        "quality_filter": on(own, lambda x: curate.quality_filter(x, ("BUILDING_1", "MACHINERY_2"))),
        "org_annotate": org,
        "author_multi_owner": on(own, lambda x: curate.split_authors(x.select("owner", "author").distinct())[0]),
        "author_single_owner": on(own, lambda x: curate.split_authors(x.select("owner", "author").distinct())[1]),
        "owners_per_author_hist": on(own, curate.owners_histogram),
        "sample_preview": on(own, curate.preview),
        "parse_signature": parse_signature,
        "alias_file": alias_file,
        "gt_matrix_pairs": gt_matrix,
        "gt_pairwise_ids": gt_pairwise,
        "gt_dre_pairs": gt_dre,
        "assignment_parse": assignment_parse,
        "pair_confusion": lambda s, d: evaluate.confusion(judged(s, d)),
        "pair_metrics": metrics,
        "metric_rows": lambda s, d: sinks.metric_rows(metrics(s, d)),
        "fp_pairs": wrong("fp"),
        "fn_pairs": wrong("fn"),
        "group_stats": group_stats,
        "per_group_metrics": on(group_view, evaluate.per_group),
        "merge_reason": on(lambda s, d: group_view(s, d).withColumn("cluster", F.col("cluster").cast("string")), evaluate.merge_reasons),
        "eval_summary": on(group_view, lambda x: evaluate.summary(evaluate.per_group(x))),
        "ci_normal": lambda s, d: evaluate.t_intervals(tall(s, d)),
        "ci_bootstrap": lambda s, d: evaluate.bootstrap_intervals(tall(s, d)),
        "cluster_size_dist": on(group_view, evaluate.cluster_sizes),
        "noreply_users": on(nor, lambda x: describe.noreply_users(x).select("author", "username", "plain").distinct()),
        "numeric_ids": on(nor, lambda x: describe.numeric_ids(describe.noreply_users(x))),
        "username_variants": on(nor, lambda x: describe.username_variants(describe.noreply_users(x))),
        "noreply_summary": on(nor, lambda x: describe.noreply_summary(describe.noreply_users(x))),
        "distinct_projects": on(nor, describe.distinct_projects),
        "commits_per_year": on(years, describe.sum_years),
        "series_summary": series,
        "lookup_join": lambda s, d: describe.lookup(table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("commit").cast("string")), table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit"), "l_linenumber", "l_quantity"), "commit"),
        "core_contributors": core,
    }
    q |= {f"rule_{o.lower()}": rule_query(o) for o in resolve.Config().rules}
    return dict(sorted(q.items()))


ALIAS_COLS = f"""a AS (SELECT uid, name, email, location, login, split_part(email, '@', 1) AS prefix, split_part(email, '@', -1) AS domain FROM ({ALIAS_SQL})),
a2 AS (SELECT *, CASE WHEN len(string_split(domain, '.')) > 1 THEN string_split(domain, '.')[-2] END AS domain_main FROM a)"""
TITLE_LIST = ", ".join(f"'{t}'" for t in T.TITLES)


def _replace_sql(c: str, table_: dict[str, str]) -> str:
    for k, v in table_.items():
        c = f"replace({c}, '{k}', '{v}')"
    return c


def _strip_sql(c: str) -> str:
    for p in [*T.TIMEZONES, *T.YEARS]:
        c = f"regexp_replace(regexp_replace({c}, '^{p}\\s+', ''), '\\s+{p}$', '')"
    return c


def oracle_sql() -> dict[str, str]:
    r = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"
    prf = f"{r('tp', 'tp + fp')} AS precision, {r('tp', 'tp + fn')} AS recall"
    metric = f"""WITH {TRUTH_SQL}, {COUNT_SQL}, x AS (SELECT *, {prf} FROM m)
      SELECT *, {r("2 * precision * recall", "precision + recall")} AS f1, {r("tp + tn", "tp + fp + tn + fn")} AS accuracy, (recall + {r("tn", "tn + fp")}) / 2 AS balanced_accuracy, {r("fn", "tp + fn")} AS splitting, {r("fp", "tp + fn")} AS lumping FROM x"""
    groups = f"""g AS ({GROUP_SQL}), s AS (SELECT grp, cluster, count(*) AS k FROM g GROUP BY 1, 2),
      h AS (SELECT grp, CAST(sum(k) AS BIGINT) AS n, count(*) AS clusters, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS tp FROM s GROUP BY 1),
      e AS (SELECT *, n * (n - 1) // 2 AS every, n * (n - 1) // 2 - tp AS fn, CAST(tp > 0 AS INT)::DOUBLE AS p, {r("tp", "n * (n - 1) // 2")} AS rc FROM h),
      m AS (SELECT grp, n, clusters, tp, fn, CASE WHEN n = 1 THEN 100.0 ELSE rc * 100 END AS merge_percentage, CASE WHEN n = 1 THEN 1.0 ELSE p END AS precision, CASE WHEN n = 1 THEN 1.0 ELSE rc END AS recall,
        CASE WHEN n = 1 THEN 1.0 ELSE {r("2 * p * rc", "p + rc")} END AS f1, CASE WHEN n = 1 THEN 1.0 ELSE rc END AS accuracy, CASE WHEN n = 1 THEN 1.0 ELSE rc / 2 END AS balanced_accuracy, CASE WHEN n = 1 THEN 0.0 ELSE {r("fn", "every")} END AS splitting, CAST(0 AS DOUBLE) AS lumping FROM e)"""
    cols = ("merge_percentage", *evaluate.RATIOS)
    long = " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM m" for c in cols)
    owner = f"o AS ({OWNER_SQL}), d AS (SELECT DISTINCT owner, author FROM o)"
    users = f"""u0 AS (SELECT author, project, regexp_extract(author, '<([^>]+)>\\s*$', 1) AS email FROM ({NOREPLY_SQL})),
      u AS (SELECT *, split_part(email, '@', 1) AS username, nullif(regexp_extract(split_part(email, '@', 1), '^(\\d+)\\+', 1), '') AS numeric_id, regexp_replace(split_part(email, '@', 1), '^\\d+\\+', '') AS plain FROM u0)"""
    y = "y AS (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS count FROM orders GROUP BY 1)"
    same_key = lambda label, key, bound=True: f"""WITH {ALIAS_COLS}, k AS (SELECT uid, {key} AS key FROM a2 WHERE {key} <> ''), n AS (SELECT key, count(*) AS n FROM k GROUP BY 1)
      SELECT x.uid AS a, y.uid AS b, '{label}' AS rule FROM k x JOIN k y ON x.key = y.key AND x.uid < y.uid JOIN n ON n.key = x.key WHERE n > 1{" AND n < 40" if bound else ""}"""  # noqa: E731
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in Config().blacklist(True))
    wrong_sql = lambda o: f"""WITH {TRUTH_SQL}, {ALIAS_COLS} SELECT id1, x.name AS name1, x.email AS email1, id2, y.name AS name2, y.email AS email2 FROM j JOIN a x ON x.uid = id1 + 1 JOIN a y ON y.uid = id2 + 1 WHERE outcome = '{o}'"""
    # what Latin-1 makes of UTF-8 bytes: marks of two of its characters are one character of the text
    ill = "".join(chr(0xC0 + ord(m[1]) - 0x80) for m in T.MOJIBAKE if m[0] == "Ã" and ord(m[1]) < 0x100)
    return {
        "ill_encoded": f"SELECT doc_id, coalesce(regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{80}}-\\x{{BF}}{ill}]'), FALSE) AS ill FROM documents",
        "alias_file": f"SELECT row_number() OVER (ORDER BY min(uid)) AS uid, name, email FROM ({ALIAS_SQL}) WHERE name <> '' OR uid % 3 = 1 GROUP BY name, email",
        "sample_preview": f"""WITH {owner}, r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY owner) AS i, count(*) OVER (PARTITION BY author) AS n FROM d),
          t AS (SELECT author, any_value(n) AS n, string_agg(owner, ', ' ORDER BY owner) FILTER (i <= 3) AS owners FROM r WHERE n > 1 GROUP BY 1 ORDER BY 1 LIMIT 10)
          SELECT author, owners || CASE WHEN n > 3 THEN ' +' || (n - 3) || ' more' ELSE '' END AS usernames FROM t""",
        "group_stats": f"""WITH g AS (SELECT grp, count(*) AS all_n, min_by(org_flag, pos) AS flag, CAST(count_if(org_flag = 0) AS BIGINT) AS n FROM ({GROUP_SQL}) GROUP BY 1),
          h AS (SELECT CASE WHEN flag <> 0 THEN all_n END AS removed, CASE WHEN n > 0 AND n <= 14 THEN n END AS kept, n FROM g)
          SELECT count(*) AS initial, CAST(count_if(n > 0) AS BIGINT) AS after_org, count(kept) AS after_max, {", ".join(f"{f}({c}) AS {k}_{c}" for c in ("removed", "kept") for k, f in (("avg", "avg"), ("median", "median"), ("std", "stddev_pop"), ("max", "max")))} FROM h""",
        "privacy_exclusion": resolution_sql.privacy(NOREPLY_SQL),
        "utf8_filter": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN doc_id % 4 = 3 END AS valid FROM documents",
        "gt_pairwise_ids": """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS pos, 'p' || l_partkey AS c0, 's' || l_suppkey AS c1, CAST(l_returnflag = 'R' AS INT) AS label FROM lineitem),
          f AS (SELECT alias, row_number() OVER (ORDER BY min(place), alias) - 1 AS id FROM (SELECT c0 AS alias, pos * 2 AS place FROM l UNION ALL SELECT c1, pos * 2 + 1 FROM l) GROUP BY 1)
          SELECT label, count(*) AS n, CAST(sum(x.id) AS BIGINT) AS s1, CAST(sum(y.id) AS BIGINT) AS s2 FROM l JOIN f x ON x.alias = c0 JOIN f y ON y.alias = c1 GROUP BY 1""",
        "alias_projection": f"WITH {ALIAS_COLS} SELECT uid, trim(name) AS name, lower(email) AS email, nullif(prefix, '') AS prefix, domain, domain_main FROM a2",
        "leet_map": "SELECT doc_id, translate(text, '01345789$|<€£', 'oieastbgsicel') AS v FROM documents",
        "universal_map": f"SELECT doc_id, translate({_replace_sql('lower(text)', T.ONE_TO_MANY)}, '{T.ONE_TO_ONE[0]}', '{T.ONE_TO_ONE[1]}') AS v FROM documents",
        "title_strip": f"SELECT p_partkey, array_to_string(list_filter(string_split('dr ' || lower(p_name) || ' jr.', ' '), lambda w: w NOT IN ({TITLE_LIST})), ' ') AS v FROM part",
        "year_strip": "SELECT p_partkey, trim(regexp_replace(" + _strip_sql(r"regexp_replace(regexp_replace('13:37:28 gmt 1999 ' || lower(p_name) || ' 2020', '^\s*\d+:\d+:\d+\s+', ''), '\s+\d+:\d+:\d+\s*$', '')") + r", '\s+', ' ', 'g')) AS v FROM part",
        "german_context": f"WITH {ALIAS_COLS} SELECT uid, name <> '' AND (regexp_matches(domain, '\\.(de|at|ch|lu|li|be|it|se|dk)$') OR contains(lower(name), 'ß')) AS german FROM a",
        "blacklist_hits": f"WITH {ALIAS_COLS} SELECT uid, prefix <> '' AND (prefix IN ('admin', 'info', 'ther', 'and.', 'the') OR contains(prefix, 'admin') OR contains(prefix, 'info') OR contains(prefix, 'ther') OR contains(prefix, 'and.')) AS hit FROM a",
        "block_sizes": f"""WITH {ALIAS_COLS}, k AS (SELECT 'email' AS kind, lower(email) AS key FROM a2 UNION ALL SELECT 'domain', domain FROM a2 UNION ALL SELECT 'domain_main', domain_main FROM a2 UNION ALL SELECT 'login', login FROM a2 UNION ALL SELECT 'location', location FROM a2)
          SELECT kind, key, count(*) AS n FROM k GROUP BY 1, 2""",
        **resolution_sql.oracle(),
        "components": f"""WITH RECURSIVE a AS (SELECT uid, lower(name) AS n, email FROM ({ALIAS_SQL})), k AS (SELECT uid, 'n' || n AS key FROM a WHERE n <> '' UNION SELECT uid, 'e' || email FROM a),
          reach AS (SELECT uid AS x, uid AS y FROM a UNION SELECT r.x, k2.uid FROM reach r JOIN k k1 ON k1.uid = r.y JOIN k k2 ON k2.key = k1.key) SELECT x AS uid, min(y) AS cid FROM reach GROUP BY 1""",
        "username_mode": """WITH d AS (SELECT user_id % 50 AS cluster_id, CASE WHEN event_id % 5 > 0 THEN event_type ELSE '' END AS u FROM events), c AS (SELECT cluster_id, u, count(*) AS k FROM d WHERE u <> '' GROUP BY 1, 2),
          b AS (SELECT cluster_id, u FROM c QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY k DESC, u) = 1) SELECT d.cluster_id, b.u AS cluster_username, count(*) AS n FROM d LEFT JOIN b USING (cluster_id) GROUP BY 1, 2""",
        "line_qa": f"SELECT pos AS line_number, array_to_string(errors, ', ') AS error_types, substring(value, 1, 500) AS line_content FROM ({ERRORS_SQL}) WHERE len(errors) > 0",
        "line_qa_histogram": f"WITH e AS (SELECT split_part(unnest(errors), '(', 1) AS error_type FROM ({ERRORS_SQL})) SELECT error_type, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM e) AS pct FROM e GROUP BY 1",
        "single_author_repos": f"SELECT repo FROM ({P2A_SQL}) GROUP BY 1 HAVING count(*) = 1",
        "owner_pairs": f"WITH p AS ({P2A_SQL}) SELECT DISTINCT split_part(repo, '_', 1) AS owner, author FROM p WHERE repo IN (SELECT repo FROM p GROUP BY 1 HAVING count(*) = 1)",
        "duplicated_owners": f"WITH p AS ({P2A_SQL}), d AS (SELECT DISTINCT split_part(repo, '_', 1) AS owner, author FROM p WHERE repo IN (SELECT repo FROM p GROUP BY 1 HAVING count(*) = 1)) SELECT owner, author FROM d QUALIFY count(*) OVER (PARTITION BY owner) > 1",
        "quality_filter": f"WITH {owner} SELECT owner, author FROM d WHERE owner NOT IN ('BUILDING_1', 'MACHINERY_2') QUALIFY count(*) OVER (PARTITION BY owner) > 1",
        "org_annotate": f"WITH {owner} SELECT owner, author, CASE WHEN length(owner) % 2 = 0 THEN 1 ELSE 0 END AS org_flag FROM d",
        "author_multi_owner": f"WITH {owner} SELECT owner, author FROM d QUALIFY count(*) OVER (PARTITION BY author) > 1",
        "author_single_owner": f"WITH {owner} SELECT owner, author FROM d QUALIFY count(*) OVER (PARTITION BY author) = 1",
        "owners_per_author_hist": f"WITH {owner}, c AS (SELECT author, count(*) AS owners FROM d GROUP BY 1) SELECT owners, count(*) AS authors FROM c WHERE owners > 1 GROUP BY 1",
        "parse_signature": f"WITH {ALIAS_COLS} SELECT uid, name, email, email AS at_end FROM a",
        "gt_matrix_pairs": "SELECT vec_id AS id1, CAST(j - 1 AS BIGINT) AS id2, CAST(embedding[j] > 0 AS INT) AS label FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS j FROM embeddings) WHERE j - 1 > vec_id",
        "gt_dre_pairs": """WITH e AS (SELECT 'w' || user_id AS w, min(event_id) AS pos, min_by(event_type, event_id) AS dre FROM events GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS id FROM e)
          SELECT x.id AS id1, y.id AS id2, CAST(x.dre = y.dre AS INT) AS label FROM i x JOIN i y ON x.id < y.id""",
        "assignment_parse": "WITH l AS (SELECT doc_id, string_split(source || (CASE WHEN doc_id % 11 = 0 THEN '' ELSE ';' END) || lang || (CASE WHEN doc_id % 13 = 0 THEN ';x' ELSE '' END), ';') AS p FROM documents) SELECT p[1] AS searched, max_by(p[2], doc_id) AS assigned FROM l WHERE len(p) = 2 GROUP BY 1",
        "pair_confusion": f"WITH {TRUTH_SQL}, {COUNT_SQL} SELECT * FROM m",
        "pair_metrics": metric,
        "metric_rows": f"WITH z AS ({metric}) " + " UNION ALL ".join(f"SELECT '{c}' AS Metric, printf('%.4f', {c}) AS Value FROM z" for c in evaluate.RATIOS),
        "fp_pairs": wrong_sql("fp"),
        "fn_pairs": wrong_sql("fn"),
        "per_group_metrics": f"WITH {groups} SELECT * FROM m",
        "eval_summary": f"WITH {groups} SELECT count(*) AS groups, count_if(clusters = 1) AS merged, count_if(n > 1) AS multi, count_if(n > 1 AND clusters = 1) AS multi_merged, " + ", ".join(f"avg({c}) AS avg_{c}" for c in cols) + " FROM m",
        "cluster_size_dist": f"WITH g AS ({GROUP_SQL}), c AS (SELECT cluster, count(*) AS k FROM g GROUP BY 1) SELECT count_if(k > 1) AS merged_clusters, max(k) AS largest, count(*) AS clusters FROM c",
        "merge_reason": f"""WITH g AS (SELECT grp, CAST(cluster AS VARCHAR) AS cluster, alias FROM ({GROUP_SQL})), c AS (SELECT grp, cluster, string_agg(alias, ', ' ORDER BY alias) AS members FROM g GROUP BY 1, 2),
          d AS (SELECT grp, count(*) AS k, string_agg('Cluster ' || cluster || ': ' || members, '; ' ORDER BY cluster) AS parts FROM c GROUP BY 1) SELECT grp, k = 1 AS all_merged, CASE WHEN k > 1 THEN k || ' separate clusters found. ' || parts ELSE '' END AS reason FROM d""",
        "noreply_users": f"WITH {users} SELECT DISTINCT author, username, plain FROM u",
        "numeric_ids": f"WITH {users} SELECT DISTINCT numeric_id FROM u WHERE numeric_id IS NOT NULL",
        "username_variants": f"""WITH {users}, v AS (SELECT DISTINCT plain, username, numeric_id IS NOT NULL AS h FROM u) SELECT plain, string_agg(username, '; ' ORDER BY username) AS variants, count(*) AS n, bool_or(h) AS has_id, bool_or(NOT h) AS has_plain, bool_or(h) AND bool_or(NOT h) AS merged FROM v GROUP BY 1""",
        "noreply_summary": f"""WITH {users}, z AS (SELECT count(DISTINCT author) AS authors, count(DISTINCT email) AS emails, count(DISTINCT project) AS projects, count(DISTINCT username) AS usernames, count(DISTINCT numeric_id) AS id_prefixes_found, count(DISTINCT plain) AS usernames_after_merge FROM u) """
        + " UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS value FROM z" for c in ("authors", "emails", "projects", "usernames", "id_prefixes_found", "usernames_after_merge"))
        + " UNION ALL SELECT 'reduction', usernames - usernames_after_merge FROM z",
        "distinct_projects": f"""WITH v AS ({NOREPLY_SQL}), w AS (SELECT project, contains(project, '/') AS other, contains(author, '@users.noreply.github.com') AS hidden FROM v)
          SELECT count(DISTINCT project) AS projects, count(DISTINCT project) FILTER (NOT other) AS github_projects, count(DISTINCT project) FILTER (NOT hidden) AS projects_without_noreply, count(DISTINCT project) FILTER (NOT other AND NOT hidden) AS github_projects_without_noreply FROM w""",
        "commits_per_year": f"WITH {y} SELECT year, count FROM y",
        "series_summary": f"WITH {y} SELECT 'all' AS source, CAST(sum(count) AS BIGINT) AS total, count(*) AS years, avg(count) AS mean, CAST(median(count) AS DOUBLE) AS median FROM y UNION ALL SELECT 'noreply', CAST(sum(count) AS BIGINT), count(*), avg(count), CAST(median(count) AS DOUBLE) FROM y WHERE year % 2 = 0",
        "lookup_join": "SELECT CAST(o_orderkey AS VARCHAR) AS commit, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'",
        "core_contributors": """WITH d AS (SELECT event_type AS project, user_id AS author, count(*) AS n FROM events GROUP BY 1, 2) SELECT project, author, n,
          coalesce(sum(n) OVER (PARTITION BY project ORDER BY n DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - n * count(*) OVER (PARTITION BY project, n) < 0.8 * sum(n) OVER (PARTITION BY project) AS core FROM d""",
        "ci_normal": f"""WITH {groups}, l AS ({long}), i AS (SELECT metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS median, stddev_samp(value) / sqrt(count(*)) AS sem FROM l GROUP BY 1)
          SELECT metric, n, mean, std, median, mean - sem * T_QUANTILE AS t_lower, mean + sem * T_QUANTILE AS t_upper FROM i""".replace("T_QUANTILE", repr(evaluate.t_quantile(0.975, 124))),
    }
