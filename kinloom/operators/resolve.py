"""Identity resolution: candidate pairs by rule, decision, clusters, validity, representatives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.config import LABELS, Config
from kinloom.functions import text as T
from kinloom.operators.components import connected_components
from kinloom.operators.dense import CHUNK, Dense, dense
from kinloom.operators.keys import FLAGS, SEP, aliases, key_rows
from kinloom.plans.scratch import BROADCAST_ROWS, HOT_ROWS, Scratch, left_join_hot, small

STRONG = ("FULL_NAME", "SWITCHED_NAME", "COMP_EMAIL_PREFIX", "PREFIX_NAME", "DOMAIN_NAME_MATCH", "GITHUB_USERNAME_MATCH", "COMMA_SUFFIX_MATCH", "ABBREV_FIRST_NAME", "ABBREV_LAST_NAME", "ABBREV_MIDDLE_NAME")


@dataclass(frozen=True)
class Rule:
    """An equi-join of two kinds of keys. ``cap``: 'one' bounds a block of one kind on both sides,
    'sum' the two blocks' sizes together, 'right' and 'both' each block from above, '' nothing.
    ``guard`` names a test of the key; ``order`` is how the uids must compare."""

    option: str
    left: str
    right: str
    cap: str = ""
    guard: str = ""
    order: str = "<>"


RULES = (
    Rule("EMAIL", "email", "email", "", "unlisted", "<"),
    Rule("COMP_EMAIL_PREFIX", "comp_prefix", "comp_prefix", "one", "clean_long", "<"),
    Rule("SIMPLE_EMAIL_PREFIX", "prefix", "prefix", "one", "clean_long", "<"),
    Rule("PREFIX_LOGIN", "login", "prefix", "right", "clean_long", "<"),
    Rule("PREFIX_NAME", "name", "prefix", "both", "clean_long"),
    Rule("PREFIX_NAME", "name", "comp_prefix", "both", "clean_long"),
    Rule("LOGIN_NAME", "name", "login", "left", "unlisted", "<"),
    Rule("FULL_NAME", "name", "name", "one", "long_name", "<"),
    Rule("DOMAIN", "domain", "domain", "one", "unlisted", "<"),
    Rule("DOMAIN_MAIN_PART", "domain_main", "domain_main", "one", "unlisted", "<"),
    Rule("DOMAIN_NAME_MATCH", "site_name", "site", "sum", "unlisted"),
    Rule("DOMAIN_NAME_MATCH", "prefix_site", "first_last"),
    Rule("COMMA_SUFFIX_MATCH", "comma_base", "comma_base", "one", "unlisted", "<"),
    Rule("GITHUB_USERNAME_MATCH", "github", "github_name", "sum", "unlisted"),
    Rule("ABBREV_FIRST_NAME", "abbrev_first", "full_first", "sum", "last_no_first_name"),
    Rule("ABBREV_FIRST_NAME", "mail_first", "full_first", "sum", "last_no_first_name"),
    Rule("ABBREV_LAST_NAME", "abbrev_last", "full_last", "sum", "first_no_first_name"),
    Rule("ABBREV_LAST_NAME", "mail_last", "full_last", "sum", "first_no_first_name"),
    Rule("ABBREV_MIDDLE_NAME", "abbrev_middle", "full_middle", "sum"),
    Rule("SWITCHED_NAME", "turned", "normal", "both"),
)


def _guard(guard: str, config: Config, name: str = "key") -> Column:
    """The test of keys that a rule names."""
    key = F.col(name)
    terms = config.blacklist(config.blacklist_include_first_names)
    names = [n.lower() for n in config.first_names]
    not_first = lambda part: ~T.among(F.lower(part), names)
    long = F.length(key) >= config.thr_min_length
    tests = {
        "": lambda: F.lit(True),
        "unlisted": lambda: ~T.among(key, terms),
        "clean_long": lambda: long & ~T.among(key, terms) & ~T.blacklisted(key, config.blacklist(False)),
        "long_name": lambda: long & (F.contains(key, F.lit(" ")) | ~T.among(key, terms)),
        "last_no_first_name": lambda: not_first(F.substring_index(key, SEP, -1)),
        "first_no_first_name": lambda: not_first(F.substring_index(key, SEP, 1)),
    }
    return tests[guard]()


def sized_keys(keys: DataFrame, s: Scratch, hot_rows: int = HOT_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds n, the number of aliases of each block. A block of many aliases never meets in one task."""
    by, keys = ["grp", "kind", "key"], s.table(keys, "keys")
    sizes = s.table(keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "sizes")
    return left_join_hot(keys, sizes.withColumn("_n", F.col("n")), by, "_n", keys.count(), hot_rows, broadcast_rows).drop("_n")


def _pairs(left: DataFrame, right: DataFrame, label: str, where: Column | None = None, order: str = "<>") -> DataFrame:
    r = right.select(*[F.col(c).alias(f"r_{c}") if c not in ("grp", "key") else F.col(c) for c in right.columns])
    p = left.join(r, ["grp", "key"]).where(F.col("uid") < F.col("r_uid") if order == "<" else F.col("uid") != F.col("r_uid"))
    if where is not None:
        p = p.where(where)
    return p.select("grp", F.least("uid", "r_uid").alias("a"), F.greatest("uid", "r_uid").alias("b"), F.lit(label).alias("rule"))


def rule_pairs(rule: Rule, keys: DataFrame, a: DataFrame, config: Config) -> DataFrame:
    """(grp, a, b, rule) of one rule; blocks are cut to size before they are paired."""
    low, high, label = config.thr_min, config.thr_max, LABELS.get(rule.option, rule.option)
    k = keys.where(F.col("kind").isin(rule.left, rule.right)).where(_guard(rule.guard, config)).select("grp", "kind", "key", "uid", "n")
    left, right = (k.where(F.col("kind") == x).drop("kind") for x in (rule.left, rule.right))
    inside = lambda d: d.where((F.col("n") > low) & (F.col("n") < high))
    under = lambda d: d.where(F.col("n") < high)
    where = None
    if rule.cap == "one":
        left, right = inside(left), inside(right)
    elif rule.cap == "right":
        right = under(right)
    elif rule.cap == "left":
        left = under(left)
    elif rule.cap == "both":
        left, right = under(left), under(right)
    elif rule.cap == "sum":
        left, right = under(left), under(right)
        where = (F.col("n") + F.col("r_n") > low) & (F.col("n") + F.col("r_n") < high)
    if rule.option == "EMAIL":
        # A shared address has no upper bound. A component above THR_MAX is discarded whatever its
        # links, so a larger block is a star instead of all its pairs.
        big = left.where(F.col("n") > high)
        star = big.groupBy("grp", "key").agg(F.min("uid").alias("to"))
        star = big.join(star, ["grp", "key"]).where("uid <> to").select("grp", F.col("to").alias("a"), F.col("uid").alias("b"), F.lit(label).alias("rule"))
        small_ones = left.where((F.col("n") > low) & (F.col("n") <= high))
        return _pairs(small_ones, small_ones, label, None, "<").union(star)
    if rule.option == "DOMAIN_MAIN_PART":
        norm = a.select("grp", "uid", F.nullif("prefix_norm", F.lit("")).alias("extra"))
        left, right = left.join(norm, ["grp", "uid"]), right.join(norm, ["grp", "uid"])
        where = F.col("extra") == F.col("r_extra")
    elif rule.option == "COMMA_SUFFIX_MATCH":
        low_name = a.select("grp", "uid", F.lower("name").alias("extra"))
        left, right = left.join(low_name, ["grp", "uid"]), right.join(low_name, ["grp", "uid"])
        one, two = F.contains("extra", F.lit(",")), F.contains("r_extra", F.lit(","))
        where = (one != two) | (one & two & (F.col("extra") != F.col("r_extra")))
    return _pairs(left, right, label, where, rule.order)


def _bounded(rule: Rule) -> bool:
    """Whether both sides' blocks are below THR_MAX and keys are all that the rule compares."""
    return rule.cap in ("one", "sum", "both") and rule.option not in ("DOMAIN_MAIN_PART", "COMMA_SUFFIX_MATCH")


def block_pairs(rules: list[Rule], keys: DataFrame, config: Config) -> DataFrame:
    """(grp, a, b, rule) of the bounded rules in one exchange: key rows are copied to their rules' sides, and each
    block, of fewer than THR_MAX aliases a side, gives its pairs where it is gathered."""
    low, high, n = config.thr_min, config.thr_max, F.col("n")
    # a kind's rules and sides are looked up, since a condition a rule and side would be tried for every row
    sides: dict[str, list[Column]] = {}
    for i, r in enumerate(rules):
        for side, kind in enumerate((r.left,) if r.left == r.right else (r.left, r.right)):
            sides.setdefault(kind, []).append(F.struct(F.lit(i).alias("r"), F.lit(side).alias("side"), F.lit(r.cap == "one").alias("least")))
    of_kind = F.create_map(*[x for kind, at in sides.items() for x in (F.lit(kind), F.array(*at))])
    rows = keys.where(F.col("kind").isin(*sides) & (n < high)).select("grp", "key", "uid", "n", F.inline(F.try_element_at(of_kind, F.col("kind"))))
    rows = rows.where(~F.col("least") | (n > low)).select("grp", "key", "uid", "r", "side")
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("uid"))))
    blocks = rows.groupBy("grp", "r", "key").agg(of(0).alias("x"), of(1).alias("y"), F.first("key").alias("text"))
    at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("r"))
    total = F.size("x") + F.size("y")
    blocks = blocks.withColumn("one", at([r.left == r.right for r in rules]))
    blocks = blocks.where(F.col("one") | ~at([r.cap == "sum" for r in rules]) | ((total > low) & (total < high)))
    blocks = blocks.withColumn("y", F.when(F.col("one"), F.col("x")).otherwise(F.col("y"))).where((F.size("x") > 0) & (F.size("y") > 0))
    # guards look at the key alone, so they are tested once a block that has pairs; as a filter by the key they would
    # be tested once a row
    passed = F.lit(True)
    for name in sorted({r.guard for r in rules} - {""}):
        mine = [i for i, r in enumerate(rules) if r.guard == name]
        passed = F.when(F.col("r").isin(mine), _guard(name, config, "text")).otherwise(passed)
    blocks = blocks.where(passed)
    less = at([r.order == "<" for r in rules])
    p = blocks.select("grp", less.alias("less"), at([LABELS.get(r.option, r.option) for r in rules]).alias("rule"), F.explode("x").alias("uid"), "y")
    p = p.select("grp", "less", "rule", "uid", F.explode("y").alias("other")).where((F.col("uid") < F.col("other")) | (~F.col("less") & (F.col("uid") != F.col("other"))))
    return p.select("grp", F.least("uid", "other").alias("a"), F.greatest("uid", "other").alias("b"), "rule")


def dense_blocks(keys: DataFrame, config: Config, s: Scratch, chunk: int = CHUNK) -> Dense | None:
    """The large blocks of the rule that bounds none, if there are any. A pair that this rule finds is refused only for an
    equal domain or main part, whose blocks are below THR_MAX: an alias is refused fewer than 2 * THR_MAX - 3 partners, so any
    two of a side share one that isn't refused, and a block's aliases are one component."""
    return dense(keys, "prefix_site", "first_last", "DOMAIN_NAME_MATCH", 4 * config.thr_max, s, chunk) if config.has("DOMAIN_NAME_MATCH") else None


def candidate_pairs(a: DataFrame, keys: DataFrame, config: Config, dense: Dense | None = None) -> DataFrame:
    """All (grp, a, b, rule) rows of the enabled rules, but for those of the blocks of ``dense``; ``keys`` has block
    sizes. Rules whose kinds of keys nobody has are not joined."""
    kinds = {r[0] for r in keys.select("kind").distinct().collect()}
    on = [r for r in RULES if config.has(r.option) and {r.left, r.right} <= kinds]
    rest = lambda r: keys.join(small(dense.blocks), ["grp", "key"], "left_anti") if dense and (r.left, r.right) == ("prefix_site", "first_last") else keys
    found = [rule_pairs(r, rest(r), a, config) for r in on if not _bounded(r)]
    if bounded := [r for r in on if _bounded(r)]:
        found.append(block_pairs(bounded, keys, config))
    high = config.thr_max
    if config.has("SWITCHED_NAME") and "normal" in kinds:
        normal = keys.where((F.col("kind") == "normal") & (F.col("n") < high)).select("grp", "key", "uid")
        other = F.concat_ws(" ", F.substring_index("key", " ", -1), F.substring_index("key", " ", 1))
        found.append(_pairs(normal.where(F.col("key") != other), normal.withColumn("key", other).where(F.col("key") != F.concat_ws(" ", F.substring_index("key", " ", -1), F.substring_index("key", " ", 1))), "SWITCHED_NAME"))
    if config.has("DOMAIN_NAME_MATCH") and "site_prefix_name" in kinds:
        # each full key belongs to the alias that comes last; roles of its parts are exchanged
        owner = keys.where("kind = 'site_prefix_name'").groupBy("grp", "key").agg(F.max("uid").alias("uid"))
        part = lambda i: F.get(F.split("key", SEP), F.lit(i))
        for d, p, f, l in ((3, 2, 0, 1), (2, 3, 0, 1)):
            found.append(_pairs(owner.withColumn("key", F.concat_ws(SEP, part(d), part(p), part(f), part(l))), owner, "DOMAIN_NAME_MATCH"))
    if config.has("LOCATION") and "location" in kinds:
        terms = config.blacklist(config.blacklist_include_first_names)
        names = keys.where("kind = 'name'").select("grp", F.col("key").alias("name"), "n").distinct()
        placed = keys.where("kind = 'location'").where(F.col("n") > config.thr_min).select("grp", F.col("key").alias("place"), "uid")
        placed = placed.join(a.where((F.size("words") > 1) & ~T.among(F.col("name"), terms)).select("grp", "uid", "name"), ["grp", "uid"])
        placed = placed.join(names, ["grp", "name"], "left").where(F.coalesce("n", F.lit(0)) < high)
        placed = placed.select("grp", F.concat_ws(SEP, "place", "name").alias("key"), "uid")
        found.append(_pairs(placed, placed, "LOCATION", None, "<"))
    out = keys.sparkSession.createDataFrame([], "grp string, a long, b long, rule string")
    for f in found:
        out = out.union(f)
    return out


def clues(pairs: DataFrame) -> DataFrame:
    """(grp, a, b, rules): distinct labels per pair. PREFIX_LOGIN and LOGIN_NAME don't count
    beside SIMPLE_EMAIL_PREFIX."""
    c = pairs.groupBy("grp", "a", "b").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    less = F.array_except("rules", F.array(F.lit("PREFIX_LOGIN"), F.lit("LOGIN_NAME")))
    return c.withColumn("rules", F.when(F.array_contains("rules", "SIMPLE_EMAIL_PREFIX"), less).otherwise(F.col("rules")))


def listed_clues(a: DataFrame, keys: DataFrame, config: Config, s: Scratch) -> tuple[DataFrame, Dense | None]:
    """The clues of all pairs but those that only large blocks give, and these blocks."""
    blocks = dense_blocks(keys, config, s)
    c = clues(candidate_pairs(a, keys, config, blocks))
    return (blocks.mark(c) if blocks else c), blocks


def decide(c: DataFrame) -> DataFrame:
    """Adds ``accepted``, the labels that merge the pair, empty if none do."""
    has = lambda x: F.array_contains("rules", x)
    none = F.array().cast("array<string>")
    trimmed = F.when(has("DOMAIN_NAME_MATCH") & (has("EMAIL_DOMAIN") | has("EMAIL_DOMAIN_MAIN_PART")), F.array_remove("rules", "DOMAIN_NAME_MATCH")).otherwise(F.col("rules"))
    accepted = (
        F.when(has("EMAIL"), F.array(F.lit("EMAIL")))
        .when(F.size("rules") >= 2, F.when(F.size(trimmed) >= 2, trimmed).otherwise(none))
        .when(F.get("rules", F.lit(0)).isin(list(STRONG)), F.col("rules"))
        .otherwise(none)
    )
    return c.withColumn("accepted", accepted)


def clusters(decided: DataFrame, s: Scratch, blocks: Dense | None = None) -> tuple[DataFrame, DataFrame]:
    """(uid, cid) of aliases in a component, and (cid, rule, n) label counts; the pairs of ``blocks`` count too, all of
    them accepted for the one label. uids are unique over groups here: callers number (grp, uid) where they aren't."""
    edges = s.table(decided.where(F.size("accepted") > 0).select("a", "b", "accepted"), "edges")
    joined = edges.select("a", "b").union(blocks.hubs) if blocks else edges
    members = connected_components(joined, scratch=s).select(F.col("node").alias("uid"), F.col("label").alias("cid"))
    counted = edges.join(members.withColumnRenamed("uid", "a"), "a").select("cid", F.explode("accepted").alias("rule"))
    counts = counted.groupBy("cid", "rule").agg(F.count(F.lit(1)).alias("n"))
    if blocks:
        more = blocks.counted().join(members.withColumnRenamed("uid", "x"), "x").select("cid", F.lit(blocks.label).alias("rule"), "n")
        counts = counts.union(more).groupBy("cid", "rule").agg(F.sum("n").alias("n"))
    return members, counts


def validity(a: DataFrame, members: DataFrame, counts: DataFrame, config: Config) -> DataFrame:
    """(cid, m, reason, valid, split): the first test of the cascade that a cluster meets."""
    m = members.join(a.select("uid", "email", "domain", "name_generic"), "uid")
    per = m.groupBy("cid").agg(
        F.count(F.lit(1)).alias("m"),
        F.countDistinct(F.coalesce(F.concat(F.lit("e"), "email"), F.lit("n"))).alias("emails"),
        F.countDistinct("domain").alias("domains"),
        F.coalesce(F.bool_or("name_generic"), F.lit(False)).alias("generic"),
    ).where(F.col("m") <= config.thr_max)
    labels = counts.groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("rule", "n"))).alias("c"))
    v = per.join(labels, "cid", "left")
    n = lambda rule: F.coalesce(F.try_element_at("c", F.lit(rule)), F.lit(0))
    named = (n("FULL_NAME") > 0) | (n("SWITCHED_NAME") > 0)
    almost = F.col("m") - 1
    reason = (
        F.when(n("EMAIL") >= almost, "email")
        .when((n("EMAIL_DOMAIN_MAIN_PART") >= 1) & (n("SIMPLE_EMAIL_PREFIX") >= 1), "domain_and_prefix")
        .when(n("DOMAIN_NAME_MATCH") >= 1, "domain_name")
        .when(n("GITHUB_USERNAME_MATCH") >= 1, "github")
        .when(n("COMMA_SUFFIX_MATCH") >= 1, "comma")
        .when(n("ABBREV_FIRST_NAME") + n("ABBREV_LAST_NAME") + n("ABBREV_MIDDLE_NAME") >= 1, "abbreviation")
        .when(F.col("emails") == 1, "one_email")
        .when(named & (F.col("domains") > 1) & F.col("generic"), "bot")
        .when(named | (n("COMP_EMAIL_PREFIX") > 0) | (n("SIMPLE_EMAIL_PREFIX") > 0), "name_or_prefix")
        .when(n("LOGIN_NAME") >= almost, "login")
        .when(n("PREFIX_NAME") >= 1, "prefix_name")
        .otherwise("none")
    )
    v = v.withColumn("reason", reason)
    return v.select("cid", "m", "reason", (~F.col("reason").isin("bot", "none")).alias("valid"), ((F.col("reason") == "none") & (n("EMAIL") > 0)).alias("split"))


def representatives(a: DataFrame, members: DataFrame, verdicts: DataFrame, located: bool) -> DataFrame:
    """(uid, rep_uid) of aliases that are mapped to another one."""
    m = members.join(a.select("uid", "name", "email", "prefix"), "uid").join(verdicts.where("valid or split"), "cid")
    m = m.withColumn("ill", T.ill_encoded(F.col("name")).cast("int"))
    parts = F.split("name", " ")
    short = F.least(F.length(F.get(parts, F.lit(0))), F.length(F.get(parts, F.lit(1))))
    two = (F.size(parts) == 2) & (short > 1) & (F.col("ill") == 0)
    plus = F.when(F.col("prefix").isNotNull() & ~F.contains("prefix", F.lit("+")), 0).otherwise(1)
    tier = lambda x: F.when(two, x)
    rank = F.struct(F.when(two, 0).otherwise(1).alias("t"), plus.alias("p"), tier(-F.length("name")).alias("l"), tier(-short).alias("s"), tier(T.capitalization(F.col("name"))).alias("c"), tier(F.col("name")).alias("n"), F.when(two, 0).otherwise(F.col("ill")).alias("i"), F.col("uid").alias("u"))
    best = F.min("uid") if located else F.min_by("uid", rank)
    whole = m.where("valid")
    out = whole.join(whole.groupBy("cid").agg(best.alias("rep_uid")), "cid").select("uid", "rep_uid")
    # clusters that fall apart by address: the oldest, rather well encoded one of each
    key = F.coalesce(F.concat(F.lit("e"), "email"), F.lit("n"))
    part = m.where("split").withColumn("key", key)
    per = part.groupBy("cid", "key").agg(F.min_by("uid", F.struct("ill", "uid")).alias("rep_uid"), F.min("ill").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
    part = part.join(per, ["cid", "key"])
    if not located:
        part = part.where((F.col("ill") == 0) | (F.col("least") == 1))
    return out.union(part.select("uid", "rep_uid")).where("uid <> rep_uid")


def resolve(df: DataFrame, config: Config | None = None, group: str | None = None, scratch: Scratch | None = None, prepared: DataFrame | None = None) -> DataFrame:
    """(uid, rep_uid[, group]) of every input row: the alias that stands for it.

    ``df`` has uid (unique, ordered by age), name, email and optionally login and location. With
    ``group``, aliases only match inside a group; thresholds count per group.
    ``prepared`` is what ``aliases`` gives of ``df``, as a table, where the caller has it.
    """
    s, config = scratch or Scratch(df.sparkSession), config or Config()
    a = prepared or s.table(aliases(df, config, group), "aliases")
    keys = s.table(sized_keys(key_rows(a, config), s), "keys")
    c, blocks = listed_clues(a, keys, config, s)
    members, counts = clusters(decide(c), s, blocks)
    mapped = representatives(a, members, validity(a, members, counts, config), "location" in df.columns)
    out = a.join(mapped, "uid", "left").withColumn("rep_uid", F.coalesce("rep_uid", "uid"))
    return out.select("uid", "rep_uid", *([F.col("grp").alias(group)] if group else []))


def username_mode(df: DataFrame, cluster: str = "cluster_id", username: str = "username") -> DataFrame:
    """Adds each cluster's most frequent non-empty username; of equally frequent ones the first."""
    counted = df.where(F.col(username) != "").groupBy(cluster, username).count()
    best = counted.groupBy(cluster).agg(F.min_by(username, F.struct(-F.col("count"), F.col(username))).alias("cluster_username"))
    return df.join(best, cluster, "left")


def report(df: DataFrame, mapping: DataFrame, a: DataFrame, project: str = "", legacy: bool = False) -> DataFrame:
    """The output relation: project, original and resolved signatures, the flags, the username."""
    sig = lambda d, uid, c: d.select(F.col("uid").alias(uid), T.signature(F.coalesce("name", F.lit("")), F.coalesce("email", F.lit(""))).alias(c))
    target = "dealialized_author_id" if legacy else "dealiased_author_id"
    out = mapping.select("uid", "rep_uid").join(sig(df, "uid", "original_author_id"), "uid").join(sig(df, "rep_uid", target), "rep_uid")
    flags = a.select("uid", F.concat(F.lit("("), F.concat_ws(", ", *[F.initcap(F.col(f).cast("string")) for f in FLAGS]), F.lit(")")).alias("is_original_author_weird_id"))
    out = out.join(flags, "uid").withColumn("project", F.lit(project))
    cols = ["project", "original_author_id", target, "is_original_author_weird_id"]
    if "login" in df.columns:
        named = username_mode(out.join(df.select("uid", F.col("login").alias("username")), "uid"), "rep_uid")
        return named.select(*cols, F.coalesce("cluster_username", "username").alias("username"))
    return out.select(cols)
