"""Scalar functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character maps.
LEET = ("01345789$|<€£", "oieastbgsicel")
GERMAN = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
ONE_TO_ONE = ("ñçáàâãéèêëíìîïóòôõúùûÿýäöüąćčďęěłľĺňńřŕśšťůźżžğışőűāēīūģķļņабвгдезийклмнопрстуфхыэαβγδεζηικλμνξοπρσςτυφωðġħ", "ncaaaaeeeeiiiioooouuuyyaouaccdeelllnnrrsstuzzzgisouaeiugklnabvgdeziyklmnoprstufhyeabgdeziiklmnxoprsstyfodgh")
ONE_TO_MANY = {"ß": "ss", "œ": "oe", "æ": "ae", "å": "aa", "ø": "oe", "đ": "dj", "ё": "yo", "ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "θ": "th", "χ": "ch", "ψ": "ps", "þ": "th", "ĳ": "ij"}
TITLES = "dr dr. prof prof. phd phd. mr mr. mrs mrs. ms ms. jr jr. sr sr. sir ii iii iv v vi vii viii ix x".split()
TIMEZONES = "gmt bst cet cest utc pst pdt est edt mst mdt cst cdt ist jst aest aedt".split()
YEARS = [r"\b19\d{2}\b", r"\b20\d{2}\b"]
PUNCTUATION = r"""[.,:;!?'"()\[\]{}/@#$%^&*+=|\\<>~`\-_]"""
GERMAN_DOMAINS = ".de .at .ch .lu .li .be .it .se .dk".split()
MOJIBAKE = ["Â", "â€", "Ã¡", "Ã©", "Ã­", "Ã³", "Ãº", "Ã¢", "Ãª", "Ã®", "Ã´", "Ã»", "Ã£", "Ã±", "Ã§", "Ã¤", "Ã¶", "Ã¼", "ÃŸ"]
FAKE_ENDINGS = ("@server.fake", "@server.com", "@example.com", "@email.com")
QUOTES = "\"'`´‘’“”„"


def strip(c: Column) -> Column:
    """Trims all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_email(c: Column) -> Column:
    """Null if empty, ``none`` or of a placeholder domain."""
    e = F.lower(strip(c))
    bad = (e == "") | (e == "none")
    for x in FAKE_ENDINGS:
        bad = bad | e.endswith(x)
    return F.when(~bad, e)


def email_prefix(e: Column) -> Column:
    return F.when(F.contains(e, F.lit("@")), F.nullif(F.substring_index(e, "@", 1), F.lit("")))


def email_domain(e: Column) -> Column:
    return F.when(F.contains(e, F.lit("@")), F.nullif(F.substring_index(e, "@", -1), F.lit("")))


def domain_main(d: Column) -> Column:
    """The second-last label."""
    labels = F.split(d, r"\.")
    return F.when(F.size(labels) > 1, F.lower(F.element_at(labels, -2)))


def leet(c: Column) -> Column:
    return F.translate(c, *LEET)


def universal(c: Column, german: bool = False) -> Column:
    """Latin letters for diacritics, Cyrillic and Greek; umlauts by German custom if asked."""
    if german:
        for k, v in GERMAN.items():
            c = F.replace(c, F.lit(k), F.lit(v))
    for k, v in ONE_TO_MANY.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.translate(c, *ONE_TO_ONE)


def strip_timestamp(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s*\d+:\d+:\d+\s+", ""), r"\s+\d+:\d+:\d+\s*$", "")


def strip_zones_and_years(c: Column, zones: bool = True, years: bool = True) -> Column:
    for p in [*(TIMEZONES if zones else ()), *(YEARS if years else ())]:
        c = F.regexp_replace(F.regexp_replace(c, rf"^{p}\s+", ""), rf"\s+{p}$", "")
    return c


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def drop_titles(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, " "), lambda w: ~w.isin(TITLES)), " ")


def german_context(text: Column, domain: Column) -> Column:
    hit = F.lit(False)
    for d in GERMAN_DOMAINS:
        hit = hit | F.coalesce(F.lower(domain).endswith(d), F.lit(False))
    return F.coalesce(text != "", F.lit(False)) & (hit | F.contains(F.lower(text), F.lit("ß")))


def strip_punctuation(c: Column) -> Column:
    return strip(F.regexp_replace(c, PUNCTUATION, ""))


def ill_encoded(c: Column) -> Column:
    hit = F.contains(c, F.lit("�")) | c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    for m in MOJIBAKE:
        hit = hit | F.contains(c, F.lit(m))
    return F.coalesce(hit, F.lit(False))


def _quoted(terms) -> str:
    return ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms)


def among(c: Column, terms) -> Column:
    """Whether ``c`` is one of many terms, as a hash lookup. The JVM parses the list at once; ``isin`` would send each
    term by itself, which for long lists takes the driver longer than the plan."""
    return F.call_function("exists", F.array(c), F.expr(f"x -> x IN ({_quoted(terms)})")) if terms else F.lit(False)


def blacklisted(c: Column, terms: list[str]) -> Column:
    """Equal to a term, or containing one of at least four characters."""
    low, long = F.lower(c), [t for t in terms if len(t) >= 4]
    hit = among(low, terms)
    if long:
        hit = hit | F.call_function("exists", F.array(low), F.expr(f"x -> exists(array({_quoted(long)}), t -> contains(x, t))"))
    return F.coalesce((c != "") & hit, F.lit(False))


def capitalization(c: Column) -> Column:
    title = F.array_join(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")
    return F.when(c == title, 0).when((c == F.lower(c)) & (c != F.upper(c)), 2).when((c == F.upper(c)) & (c != F.lower(c)), 3).otherwise(1)


def drop_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{C}&&[^\n\t\r]]", "")


def clean_quoted(c: Column) -> Column:
    """Control characters, then each quote mark at the ends, then white space."""
    c = drop_controls(c)
    for q in QUOTES:
        c = F.btrim(c, F.lit(q))
    return strip(c)


def username_of_email(c: Column) -> Column:
    return F.nullif(F.substring_index(c, "@", 1), F.lit(""))


def numeric_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d+)\+", 1), F.lit(""))


def without_id(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+\+."), F.regexp_replace(c, r"^\d+\+", "")).otherwise(c)


def email_at_end(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"<([^>]+)>\s*$", 1), F.lit(""))


def repo_owner(c: Column) -> Column:
    return F.substring_index(c, "_", 1)


def canonical_username(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), "^@", ""))


def signature(name: Column, email: Column) -> Column:
    return F.concat(name, F.lit(" <"), email, F.lit(">"))


def line_errors(value: Column) -> Column:
    """Array of what is wrong with a ``repo;author`` line, empty if nothing is."""
    semis = F.regexp_count(value, F.lit(";"))
    repo, author = F.substring_index(value, ";", 1), F.regexp_replace(value, "^[^;]*;", "")
    two = semis > 0
    found = F.array(
        F.when(value.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), F.lit("control_chars")),
        F.when(semis == 0, F.lit("no_semicolon")),
        F.when(semis > 10, F.concat(F.lit("too_many_semicolons("), semis.cast("string"), F.lit(")"))),
        F.when(F.regexp_count(value, F.lit('"')) % 2 == 1, F.lit("unbalanced_quotes")),
        F.when(F.length(value) > 10000, F.concat(F.lit("line_too_long("), F.length(value).cast("string"), F.lit(")"))),
        F.when(two & (F.length(repo) > 1000), F.concat(F.lit("repo_too_long("), F.length(repo).cast("string"), F.lit(")"))),
        F.when(two & (F.length(author) > 5000), F.concat(F.lit("author_too_long("), F.length(author).cast("string"), F.lit(")"))),
    )
    return F.filter(found, lambda x: x.isNotNull())


def error_head(c: Column) -> Column:
    return F.substring_index(c, "(", 1)


def quote_csv(c: Column) -> Column:
    """A CSV field: quote marks doubled, and the whole in marks if it has one or a comma."""
    has = F.contains(c, F.lit('"')) | F.contains(c, F.lit(","))
    return F.when(has, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _relation_line(value: Column, field) -> Column:
    """``repo;author`` without control characters and with both fields trimmed and changed; null without the mark."""
    v = F.regexp_replace(value, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    repo, author = F.substring_index(v, ";", 1), F.regexp_replace(v, "^[^;]*;", "")
    return F.when(F.contains(v, F.lit(";")), F.concat(field(strip(repo)), F.lit(";"), field(strip(author))))


def quoted_line(value: Column) -> Column:
    """The first pass over a ``repo;author`` line: fields as CSV."""
    return _relation_line(value, quote_csv)


def plain_line(value: Column) -> Column:
    """The second pass: fields without quote marks."""
    return _relation_line(value, lambda c: F.replace(c, F.lit('"')))


def is_abbreviation(short: Column, full: Column) -> Column:
    """Whether ``short`` is one character, dots aside, with which ``full`` begins, in any case."""
    low = lambda c: F.lower(strip(F.replace(c, F.lit("."))))
    return (F.length(low(short)) == 1) & F.startswith(low(full), low(short))
