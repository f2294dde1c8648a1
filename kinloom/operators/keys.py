"""Aliases with all derived columns, and their blocking keys as one long table.

A key row is (grp, kind, key, uid). ``grp`` separates independent resolutions in one run; a
composite key is its parts joined by U+0001.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.config import Config
from kinloom.functions import text as T
from kinloom.functions.normalize import forms_udf, single_udf

SEP = "\x01"
FLAGS = ["name_git", "name_email_provider", "name_first", "name_generic", "name_missing", "name_machine", "name_privacy", "email_git", "email_generic", "email_missing", "email_machine", "email_privacy"]
#: The kinds that the privacy exclusion empties.
INDEX_KINDS = ("email", "prefix", "comp_prefix", "login", "name", "domain", "domain_main", "location")


def words_of(c: Column) -> Column:
    return F.filter(F.split(T.strip(c), r"(?U)\s+"), lambda w: w != "")


def aliases(df: DataFrame, config: Config, group: str | None = None) -> DataFrame:
    """Input columns uid, name, email and, where there, login and location, cleaned and with the
    normal forms that keys need. Nulls: a null name is empty; a null login or location is empty
    where the column exists. Further columns are not carried."""
    name = F.coalesce(T.strip(F.col("name")), F.lit(""))
    optional = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    a = df.select(F.col("uid").cast("long").alias("uid"), (F.col(group).cast("string") if group else F.lit("")).alias("grp"), name.alias("name"), T.clean_email(F.col("email")).alias("email"), optional("login").alias("login"), optional("location").alias("location"))
    a = a.withColumn("prefix", T.email_prefix(F.col("email"))).withColumn("domain", T.email_domain(F.col("email")))
    a = a.withColumn("domain_main", T.domain_main(F.col("domain")))
    digit = F.col("prefix").rlike("^[0-9]")
    marks = lambda c, to, is_digit, more="": F.trim(F.when(is_digit, F.regexp_replace(c, rf"[{more}.\-_+]", to)).otherwise(F.regexp_replace(c, rf"[{more}.\-_\d+]", to)))
    low = F.lower("name")
    name_digit = low.rlike("^[0-9]")
    a = a.withColumn("prefix_norm", marks(F.lower("prefix"), " ", digit)).withColumn("prefix_tight", marks(F.lower("prefix"), "", digit))
    parts = F.when(digit, F.split("prefix", r"[ .\-_+]")).otherwise(F.split("prefix", r"[ .\-_\d+]"))
    a = a.withColumn("parts", parts).withColumn("words", words_of(F.col("name")))
    swapped = lambda sep: F.when(F.size("parts") >= 2, F.concat(F.trim(F.get("parts", F.lit(1))), F.lit(sep), F.trim(F.get("parts", F.lit(0)))))
    several = F.contains("name", F.lit(" "))
    compound = F.when(several, marks(low, "", name_digit, " ")).otherwise(marks(low, "", name_digit))
    before, after = F.substring_index("name", ",", 1), F.trim(F.regexp_replace("name", "^[^,]*,", ""))
    comma = F.contains("name", F.lit(",")) & (T.strip(before) != "") & ~F.contains(T.strip(before), F.lit(" ")) & (after != "")
    w = lambda i: F.get("words", F.lit(i))
    initial = ~F.contains("name", F.lit(",")) & (F.size("words") == 3) & (F.length(F.rtrim(w(2), F.lit("."))) == 1)
    turned = F.when(comma, F.concat_ws(" ", after, T.strip(before))).when(initial, F.concat_ws(" ", w(1), w(2), w(0)))
    github = F.when(F.contains("email", F.lit("users.noreply.github.com")) & F.contains("prefix", F.lit("+")), F.nullif(F.get(F.split("prefix", r"\+"), F.lit(1)), F.lit("")))
    a = a.withColumn("compound", compound)
    texts = F.array(F.col("name"), F.col("prefix"), F.col("login"), swapped(" "), swapped(""), F.col("compound"), F.get(F.split("domain", r"\."), F.size(F.split("domain", r"\.")) - 2), github, turned)
    a = a.withColumn("forms", forms_udf(config)(F.concat(texts, "words")))
    single = F.concat(F.array(low), F.filter(F.flatten(F.array(*[F.split(low, p) for p in (" ", "_", r"\.", r"\+")])), lambda x: x != ""))
    a = a.withColumn("normal", single_udf(config)(single))
    slots = ("name", "prefix", "login", "swapped", "swapped_tight", "compound", "domain", "github", "turned")
    form = lambda i: F.filter(F.coalesce(F.get("forms", F.lit(i)), F.array()), lambda x: x != "")
    a = a.withColumns({f"{s}_forms": form(i) for i, s in enumerate(slots)})
    a = a.withColumn("word_forms", F.transform(F.slice("forms", len(slots) + 1, 1 << 20), lambda f: F.filter(f, lambda x: x != "")))
    return _flags(a, config).drop("forms", "normal")


def _flags(a: DataFrame, config: Config) -> DataFrame:
    """Twelve flags; null for names of fewer than three characters."""
    whole = F.get("normal", F.lit(0))
    of = lambda c, terms: F.coalesce(T.among(F.col(c), terms), F.lit(False))
    named = lambda terms: F.coalesce(T.among(whole, terms), F.lit(False))
    mailed = lambda terms: of("email", terms) | of("domain", terms) | of("prefix", terms)
    generic = config.blacklist_generic_terms
    split = F.col("name").rlike(r"[ _.+]") & F.exists(F.coalesce(F.slice("normal", 2, 1 << 20), F.array()), lambda x: T.among(x, generic))
    # a prefix's pieces at "." alone or "_" alone, as the rule splits by one mark at a time
    one_mark = lambda mark: F.exists(F.coalesce(F.split("prefix", mark), F.array()), lambda x: T.among(x, generic))
    values = [
        named(config.blacklist_git_hosting),
        named(config.blacklist_email_providers),
        named(config.first_names),
        named(generic) | F.coalesce(split, F.lit(False)),
        named(config.blacklist_no_names),
        named(config.blacklist_machine_names),
        named(config.blacklist_privacy_emails),
        mailed(config.blacklist_git_hosting),
        mailed(generic) | F.coalesce(F.col("prefix").rlike(r"[._]") & (one_mark(r"\.") | one_mark("_")), F.lit(False)),
        mailed(config.blacklist_no_names),
        mailed(config.blacklist_machine_names),
        mailed(config.blacklist_privacy_emails),
    ]
    return a.withColumns({f: F.when(F.length("name") >= 3, v) for f, v in zip(FLAGS, values, strict=True)})


def _join(*cols: Column) -> Column:
    return F.concat_ws(SEP, *cols)


def _product(f, *arrays: Column) -> Column:
    """f over the product of arrays, as one flat array."""
    if len(arrays) == 1:
        return F.transform(arrays[0], lambda x: f(x))
    return F.flatten(F.transform(arrays[0], lambda x: _product(lambda *r: f(x, *r), *arrays[1:])))


def key_rows(a: DataFrame, config: Config) -> DataFrame:
    """The blocking keys of every alias."""
    col, none = F.col, F.array().cast("array<string>")
    when = lambda cond, arr: F.when(F.coalesce(cond, F.lit(False)), arr).otherwise(none)
    one = lambda c: F.array(c)
    low, least = F.lower("name"), config.thr_min_length
    named, n = col("name") != "", F.size("words")
    has_prefix = F.length("prefix") >= 4
    compound = col("prefix").rlike(r"[._+\-]")
    tight = F.transform("name_forms", lambda x: F.replace(x, F.lit(" "), F.lit("")))
    first, last = F.coalesce(F.get("word_forms", F.lit(0)), none), F.coalesce(F.get("word_forms", n - 1), none)
    middles, middle_words = F.slice("word_forms", 2, F.greatest(n - 2, F.lit(0))), F.slice("words", 2, F.greatest(n - 2, F.lit(0)))
    plain = lambda c: F.lower(F.trim(F.replace(c, F.lit("."), F.lit(""))))
    w0, w1 = plain(F.get("words", F.lit(0))), plain(F.get("words", n - 1))
    initials = F.array_join(F.transform(F.filter(F.slice("word_forms", 2, 1 << 20), lambda f: F.size(f) > 0), lambda f: F.array_min(F.transform(f, lambda x: F.substring(x, 1, 1)))), "")
    both = lambda f: _product(lambda x, y: f(x, y), first, last)
    head = lambda x: F.substring(x, 1, 1)
    two_up = F.filter("name_forms", lambda x: F.size(F.split(x, " ")) >= 2)
    first_last = F.transform(two_up, lambda x: _join(F.substring_index(x, " ", 1), F.substring_index(x, " ", -1)))
    sited = col("domain").isNotNull() & named & col("domain_main").isNotNull()
    one_word = n == 1
    cut_last = F.transform(F.filter("name_forms", lambda x: F.length(x) >= 3), lambda x: _join(F.substr(x, F.length(x)), F.substr(x, F.lit(1), F.length(x) - 1)))
    cut_first = F.transform(F.filter("name_forms", lambda x: F.length(x) >= 3), lambda x: _join(head(x), F.substr(x, F.lit(2))))
    prefix_long = F.filter("prefix_forms", lambda p: F.length(p) >= least)
    matched = lambda make, key: F.filter(_product(lambda x, y, p: F.when(p == make(x, y), key(x, y)), first, last, prefix_long), lambda x: x.isNotNull())
    # middle parts: of each, whether it is an initial, its word and its forms
    mid = F.arrays_zip(F.transform(middle_words, plain).alias("w"), middles.alias("f"))
    abbrev_mid = F.flatten(F.transform(F.filter(mid, lambda m: F.length(m["w"]) == 1), lambda m: _product(lambda x, y: _join(x, m["w"], y), first, last)))
    long = lambda arr: F.filter(arr, lambda x: F.length(x) >= 2)
    full_mid = F.flatten(F.transform(F.filter(mid, lambda m: F.length(m["w"]) != 1), lambda m: _product(lambda x, k, y: _join(x, head(k), y), long(first), m["f"], long(last))))
    base = F.when(F.contains(low, F.lit(",")), T.strip(F.substring_index(low, ",", 1))).otherwise(low)
    bl = config.blacklist(config.blacklist_include_first_names)
    fits = lambda arr: F.filter(arr, lambda x: (F.size(F.split(x, " ")) == 2) & (F.length(F.substring_index(x, " ", 1)) >= 2) & (F.length(F.substring_index(x, " ", -1)) >= 2) & ~T.among(x, bl))
    kinds: dict[str, list[Column]] = {
        "email": [when(col("email").isNotNull(), one(col("email")))],
        "prefix": [when(has_prefix, col("prefix_forms")), when(has_prefix & compound, one(col("prefix_tight"))), when(has_prefix & compound, col("swapped_tight_forms")), when(has_prefix & ~compound, one(col("prefix_norm")))],
        "comp_prefix": [when(has_prefix, col("prefix_forms")), when(has_prefix & compound, one(col("prefix_norm"))), when(has_prefix & compound, col("swapped_forms"))],
        "domain": [when(col("domain").isNotNull(), one(F.lower("domain")))],
        "domain_main": [when(col("domain_main").isNotNull(), one(col("domain_main")))],
        "login": [when(col("login").isNotNull(), F.concat(one(F.lower("login")), col("login_forms")))],
        "name": [when(named, F.concat(one(low), col("name_forms"), one(col("compound")))), when(named & F.contains("name", F.lit(" ")), col("compound_forms")), when((n >= 3) & (initials != ""), F.transform(first, lambda x: F.concat(x, initials)))],
        "location": [when(col("location") != "", one(col("location")))],
        "github": [col("github_forms")],
        "github_name": [when(named, F.filter(tight, lambda x: F.length(x) >= least))],
        "site": [when(sited, one(col("domain_main")))],
        "site_name": [when(sited, F.filter(tight, lambda x: x != ""))],
        "first_last": [when(sited, first_last)],
        "site_prefix_name": [when(sited & col("prefix").isNotNull(), _product(lambda x, p: _join(col("domain_main"), p, x), first_last, col("prefix_forms")))],
        "prefix_site": [when(col("prefix").isNotNull() & col("domain_main").isNotNull(), _product(lambda p, d: _join(p, d), col("prefix_forms"), col("domain_forms")))],
        "comma_base": [when((n >= 2) & (F.size(F.filter(F.split(base, r"(?U)\s+"), lambda x: x != "")) >= 2), one(base))],
        "abbrev_first": [when(one_word, F.concat(cut_last, cut_first)), when((n >= 2) & (F.length(w0) == 1), F.transform(last, lambda x: _join(w0, x)))],
        "full_first": [when((n >= 2) & (F.length(w0) != 1), _product(lambda x, y: _join(head(x), y), first, long(last)))],
        "abbrev_last": [when((n >= 2) & (F.length(w1) == 1), F.transform(first, lambda x: _join(x, w1)))],
        "full_last": [when((n >= 2) & (F.length(w1) != 1), _product(lambda x, y: _join(x, head(y)), long(first), last))],
        "abbrev_middle": [when(n >= 3, abbrev_mid)],
        "full_middle": [when(n >= 3, full_mid)],
        "mail_first": [when((n >= 2) & col("prefix").isNotNull(), F.concat(matched(lambda x, y: F.concat(head(x), y), lambda x, y: _join(head(x), y)), matched(lambda x, y: F.concat(y, head(x)), lambda x, y: _join(head(x), y))))],
        "mail_last": [when((n >= 2) & col("prefix").isNotNull(), matched(lambda x, y: F.concat(x, head(y)), lambda x, y: _join(x, head(y))))],
        "normal": [fits(F.coalesce("name_forms", none))],
        "turned": [fits(F.coalesce("turned_forms", none))],
    }
    def tagged(kind: str, arr: Column) -> Column:
        return F.transform(F.coalesce(arr, none), lambda k: F.concat(F.lit(kind + SEP), k))

    # as one text each, since texts are made distinct by hash and pairs by comparing all with all
    rows = F.array_distinct(F.concat(*[tagged(kind, arr) for kind, arrs in kinds.items() for arr in arrs]))
    out = a.select("grp", "uid", F.explode(rows).alias("row")).where("row is not null")
    kind = F.substring_index("row", SEP, 1)
    out = out.select("grp", "uid", kind.alias("kind"), F.substr("row", F.length(kind) + 2).alias("key"))
    if config.exclude_privacy_emails_from_merging:
        hidden = a.where("name_privacy or email_privacy").select("grp", "uid", F.explode(F.array(*map(F.lit, INDEX_KINDS))).alias("kind"))
        out = out.join(hidden, ["grp", "uid", "kind"], "left_anti")
    return out
