"""SQL of identity resolution, from its definition and apart from the operators: a view of people with names and addresses
of all kinds, keys, rules, decision, clusters, validity and representatives."""

from __future__ import annotations

from kinloom.config import Config
from kinloom.functions import text as T

#: Aliases of one document's person, four a document, in the words of both engines: p is the document's number, k from 0 to 3,
#: a, b and c the text's first words, f, l and m the same in lower case.
NAME = """case p % 9
  when 0 then case k when 0 then a || ' ' || b when 1 then b || ', ' || a when 2 then substring(a, 1, 1) || '. ' || b else a || ' ' || substring(b, 1, 1) || '.' end
  when 1 then case k when 0 then a || ' ' || substring(c, 1, 1) || '. ' || b when 1 then a || ' ' || c || ' ' || b else a || ' ' || b end
  when 2 then case k when 0 then f || l when 2 then a else a || ' ' || b end
  when 3 then case k when 2 then 'Quorra Zeta' when 3 then a || ' ' || b else a || ' ' || b end
  when 4 then case k when 1 then a || ' ' || b || ', PhD' when 2 then c when 3 then b || ' ' || a || ' ' || substring(c, 1, 1) else a || ' ' || b end
  when 5 then case k when 0 then 'ab' when 1 then f || l when 2 then substring(a, 1, 1) || b else substring(b, 1, 1) || a end
  when 6 then case k when 0 then a when 1 then b || ' ' || c else a || ' ' || b end
  when 7 then case k when 0 then 'admin' when 1 then 'Root ' || a when 2 then 'No Name' else '' end
  else case k when 0 then a || ' ' || b when 1 then b || ' ' || a when 2 then '13:37:28 ' || a || '  ' || b else 'Dr. ' || a || ' ' || b || ' GMT' end end"""
HOST = "'h' || (p % 700) || '.' || s || '.' || g"
EMAIL = f"""case p % 9
  when 0 then case k when 0 then f || '.' || l || '@' || {HOST} when 1 then f || k || '@k.' || {HOST} when 2 then l || p || '@web.org' else l || p || '@mail.org' end
  when 1 then case k when 0 then f || p || '@x.org' when 1 then m || p || '@y.org' when 2 then substring(f, 1, 1) || l || '@' || {HOST} else f || substring(l, 1, 1) || '@z' || p || '.net' end
  when 2 then case k when 0 then p || '+' || f || l || '@users.noreply.github.com' when 3 then f || '.' || l || '@gmail.com' else f || k || p || '@w.org' end
  when 3 then case k when 0 then 'mail' || p || '@' || f || l || '.org' when 1 then f || '@' || l || '.com' when 2 then f || '@' || l || '.net' else 'zeta@quorra.org' end
  when 4 then case k when 0 then f || l || p || '@v.org' when 2 then f || l || p || '@v.org' else m || k || p || '@u.org' end
  when 5 then case k when 0 then 'nn' || p || '@t.org' when 1 then 'mm' || p || '@t' || p || '.org' when 2 then f || l || '@s.org' else 'none' end
  when 6 then case k when 0 then f || '@one' || p || '.org' when 1 then f || '@one' || p || '.org' when 2 then f || '.' || l || '@' || {HOST} else f || '_' || l || '@www.' || {HOST} end
  when 7 then case k when 0 then 'admin@' || {HOST} when 1 then f || '@example.com' when 2 then 'team.' || f || '@r.org' else ' ' || upper(f) || '.X@Q.org' end
  else case k when 0 then f || l || '@a.org' when 1 then l || '-' || f || '@b.org' when 2 then '7' || f || '@c.org' else f || p || '@github.com' end end"""
LOGIN = "case when p % 9 = 5 and k = 0 then f || l when k = 3 then '' else f || (p % 50) end"
PLACE = "case when k < 3 then s || (p % 90) else '' end"
PEOPLE = f"""SELECT p * 4 + k + 1 AS uid, {NAME} AS name, {EMAIL} AS email, {LOGIN} AS login, {PLACE} AS location
  FROM (SELECT *, lower(a) AS f, lower(b) AS l, lower(c) AS m FROM WORDS)"""
WORDS_SQL = r"""(SELECT doc_id AS p, k, source AS s, lang AS g, coalesce(w[1], '') AS a, coalesce(w[2], '') AS b, coalesce(w[3], '') AS c
  FROM (SELECT *, regexp_extract_all(text, '\p{L}+') AS w FROM documents), (SELECT unnest([0, 1, 2, 3]) AS k))"""

SEP = "chr(1)"


def _listed(terms) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def _replaced(c: str, table: dict[str, str]) -> str:
    for k, v in table.items():
        c = f"replace({c}, '{k}', '{v}')"
    return c


def _unstamped(c: str) -> str:
    c = rf"regexp_replace(regexp_replace({c}, '^\s*\d+:\d+:\d+\s+', ''), '\s+\d+:\d+:\d+\s*$', '')"
    for p in [*T.TIMEZONES, *T.YEARS]:
        c = rf"regexp_replace(regexp_replace({c}, '^{p}\s+', ''), '\s+{p}$', '')"
    return c


def norm(texts: str, single: bool = False) -> str:
    """CTEs up to ``forms`` (text, form): the normal forms of the texts of a relation with a column text; with
    ``single`` the one form that flags are about, read as leetspeak and German only where an ß stands."""
    leet = f"SELECT text, translate(lower(text), '{T.LEET[0]}', '{T.LEET[1]}') AS x FROM n1"
    two = leet if single else f"SELECT text, lower(text) AS x FROM n1 UNION {leet}"
    five = f"SELECT text, CASE WHEN contains(lower(text), 'ß') THEN {_replaced('x', T.GERMAN)} ELSE x END AS x FROM n4" if single else f"SELECT text, x FROM n4 UNION SELECT text, {_replaced('x', T.GERMAN)} FROM n4"
    words = r"list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')"
    marks = T.PUNCTUATION.replace("'", "''")
    return rf"""n1 AS (SELECT DISTINCT text FROM ({texts}) WHERE text IS NOT NULL),
  n2 AS ({two}),
  n3 AS (SELECT text, {_unstamped("x")} AS x FROM n2),
  n4 AS (SELECT DISTINCT text, array_to_string(list_filter({words}, lambda w: w NOT IN ({_listed(T.TITLES)})), ' ') AS x FROM n3),
  n5 AS ({five}),
  n6 AS (SELECT DISTINCT text, strip_accents(translate({_replaced("x", T.ONE_TO_MANY)}, '{T.ONE_TO_ONE[0]}', '{T.ONE_TO_ONE[1]}')) AS x FROM n5),
  n7 AS (SELECT text, regexp_replace(x, '{marks}', '', 'g') AS x FROM n6),
  n8 AS (SELECT text, {words} AS ws FROM n7),
  forms AS (SELECT DISTINCT text, array_to_string(CASE WHEN len(ws) = 3 AND length(ws[2]) = 1 THEN [ws[1], ws[3]] ELSE ws END, ' ') AS form FROM n8)"""


def keys(more: bool, config: Config, people: str = PEOPLE.replace("WORDS", WORDS_SQL)) -> str:
    """CTEs up to ``k`` (kind, key, uid, n): the blocking keys of PEOPLE. Without ``more`` there are no logins and places."""
    marks = lambda c, to, digit, extra="": rf"trim(CASE WHEN {digit} THEN regexp_replace({c}, '[{extra}.\-_+]', '{to}', 'g') ELSE regexp_replace({c}, '[{extra}.\-_\d+]', '{to}', 'g') END)"
    digit, name_digit = "regexp_matches(prefix, '^[0-9]')", "regexp_matches(lower(name), '^[0-9]')"
    placeholder = " OR ".join(f"ends_with(e, '{x}')" for x in T.FAKE_ENDINGS)
    optional = "login, location" if more else "CAST(NULL AS VARCHAR) AS login, CAST(NULL AS VARCHAR) AS location"
    before, after = "split_part(name, ',', 1)", "trim(regexp_replace(name, '^[^,]*,', ''))"
    slots = {
        "name": "name", "prefix": "prefix", "login": "login",
        "swapped": "CASE WHEN len(parts) >= 2 THEN trim(parts[2]) || ' ' || trim(parts[1]) END",
        "swapped_tight": "CASE WHEN len(parts) >= 2 THEN trim(parts[2]) || trim(parts[1]) END",
        "compound": "compound", "domain": "CASE WHEN len(labels) > 1 THEN labels[-2] END",
        "github": "CASE WHEN contains(email, 'users.noreply.github.com') AND contains(prefix, '+') THEN nullif(string_split(prefix, '+')[2], '') END",
        "turned": f"""CASE WHEN contains(name, ',') AND trim({before}) <> '' AND NOT contains(trim({before}), ' ') AND {after} <> '' THEN {after} || ' ' || trim({before})
          WHEN NOT contains(name, ',') AND len(words) = 3 AND length(rtrim(words[3], '.')) = 1 THEN words[2] || ' ' || words[3] || ' ' || words[1] END""",
    }
    slot = " UNION ALL ".join(f"SELECT uid, '{s}' AS slot, {e} AS text FROM al" for s, e in slots.items())
    low = lambda c: f"lower(trim(replace({c}, '.', '')))"
    bl = _listed(config.blacklist(True))
    fits = f"len(string_split(form, ' ')) = 2 AND length(split_part(form, ' ', 1)) >= 2 AND length(split_part(form, ' ', 2)) >= 2 AND form NOT IN ({bl})"
    has, mixed = "length(prefix) >= 4", r"regexp_matches(prefix, '[._+\-]')"
    sited = "domain IS NOT NULL AND name <> '' AND domain_main IS NOT NULL"
    first, last = "JOIN wf x ON x.uid = al.uid AND x.i = 1", "JOIN wf y ON y.uid = al.uid AND y.i = n"
    base = "CASE WHEN contains(lower(name), ',') THEN trim(split_part(lower(name), ',', 1)) ELSE lower(name) END"
    one = lambda kind, key, where="TRUE": f"SELECT '{kind}' AS kind, {key} AS key, uid FROM al WHERE {where}"
    of = lambda kind, s, where="TRUE", key="form": f"SELECT '{kind}', {key}, al.uid FROM al JOIN sf ON sf.uid = al.uid AND slot = '{s}' WHERE {where}"
    rows = [
        one("email", "email"), of("prefix", "prefix", has), one("prefix", "prefix_tight", f"{has} AND {mixed}"), of("prefix", "swapped_tight", f"{has} AND {mixed}"), one("prefix", "prefix_norm", f"{has} AND NOT {mixed}"),
        of("comp_prefix", "prefix", has), one("comp_prefix", "prefix_norm", f"{has} AND {mixed}"), of("comp_prefix", "swapped", f"{has} AND {mixed}"),
        one("domain", "domain"), one("domain_main", "domain_main"), one("login", "lower(login)"), of("login", "login"), one("location", "location", "location <> ''"),
        one("name", "lower(name)", "name <> ''"), of("name", "name", "name <> ''"), one("name", "compound", "name <> ''"), of("name", "compound", "contains(name, ' ')"),
        f"SELECT 'name', x.form || initials, al.uid FROM al {first} JOIN (SELECT uid, string_agg(h, '' ORDER BY i) AS initials FROM (SELECT uid, i, min(substring(form, 1, 1)) AS h FROM wf WHERE i > 1 GROUP BY 1, 2) GROUP BY 1) z ON z.uid = al.uid WHERE n >= 3",
        of("github", "github"), of("github_name", "name", f"name <> '' AND length(replace(form, ' ', '')) >= {config.thr_min_length}", "replace(form, ' ', '')"),
        one("site", "domain_main", sited), of("site_name", "name", sited, "replace(form, ' ', '')"),
        of("first_last", "name", f"{sited} AND contains(form, ' ')", f"split_part(form, ' ', 1) || {SEP} || split_part(form, ' ', -1)"),
        f"SELECT 'site_prefix_name', domain_main || {SEP} || p.form || {SEP} || split_part(q.form, ' ', 1) || {SEP} || split_part(q.form, ' ', -1), al.uid FROM al JOIN sf p ON p.uid = al.uid AND p.slot = 'prefix' JOIN sf q ON q.uid = al.uid AND q.slot = 'name' WHERE {sited} AND contains(q.form, ' ')",
        f"SELECT 'prefix_site', p.form || {SEP} || q.form, al.uid FROM al JOIN sf p ON p.uid = al.uid AND p.slot = 'prefix' JOIN sf q ON q.uid = al.uid AND q.slot = 'domain'",
        one("comma_base", base, f"n >= 2 AND contains(trim({base}), ' ')"),
        of("abbrev_first", "name", "n = 1 AND length(form) >= 3", f"substring(form, length(form)) || {SEP} || substring(form, 1, length(form) - 1)"),
        of("abbrev_first", "name", "n = 1 AND length(form) >= 3", f"substring(form, 1, 1) || {SEP} || substring(form, 2)"),
        f"SELECT 'abbrev_first', w0 || {SEP} || y.form, al.uid FROM al {last} WHERE n >= 2 AND length(w0) = 1",
        f"SELECT 'full_first', substring(x.form, 1, 1) || {SEP} || y.form, al.uid FROM al {first} {last} WHERE n >= 2 AND length(w0) <> 1 AND length(y.form) >= 2",
        f"SELECT 'abbrev_last', x.form || {SEP} || w1, al.uid FROM al {first} WHERE n >= 2 AND length(w1) = 1",
        f"SELECT 'full_last', x.form || {SEP} || substring(y.form, 1, 1), al.uid FROM al {first} {last} WHERE n >= 2 AND length(w1) <> 1 AND length(x.form) >= 2",
        f"SELECT 'abbrev_middle', x.form || {SEP} || z.w || {SEP} || y.form, al.uid FROM al {first} {last} JOIN mid z ON z.uid = al.uid WHERE length(z.w) = 1",
        f"SELECT 'full_middle', x.form || {SEP} || substring(v.form, 1, 1) || {SEP} || y.form, al.uid FROM al {first} {last} JOIN mid z ON z.uid = al.uid JOIN wf v ON v.uid = al.uid AND v.i = z.i WHERE length(z.w) <> 1 AND length(x.form) >= 2 AND length(y.form) >= 2",
        f"SELECT 'mail_first', substring(x.form, 1, 1) || {SEP} || y.form, al.uid FROM al {first} {last} JOIN sf p ON p.uid = al.uid AND p.slot = 'prefix' WHERE n >= 2 AND length(p.form) >= {config.thr_min_length} AND (p.form = substring(x.form, 1, 1) || y.form OR p.form = y.form || substring(x.form, 1, 1))",
        f"SELECT 'mail_last', x.form || {SEP} || substring(y.form, 1, 1), al.uid FROM al {first} {last} JOIN sf p ON p.uid = al.uid AND p.slot = 'prefix' WHERE n >= 2 AND length(p.form) >= {config.thr_min_length} AND p.form = x.form || substring(y.form, 1, 1)",
        of("normal", "name", fits), of("turned", "turned", fits),
    ]
    return rf"""people AS ({people}),
  a0 AS (SELECT uid, trim(name) AS name, lower(trim(email)) AS e, {optional} FROM people),
  a1 AS (SELECT uid, name, login, location, CASE WHEN NOT (e = '' OR e = 'none' OR {placeholder}) THEN e END AS email FROM a0),
  a2 AS (SELECT *, nullif(split_part(email, '@', 1), '') AS prefix, nullif(split_part(email, '@', -1), '') AS domain, string_split(split_part(email, '@', -1), '.') AS labels, list_filter(string_split_regex(name, '\s+'), lambda w: w <> '') AS words FROM a1),
  a3 AS (SELECT *, len(words) AS n, CASE WHEN len(labels) > 1 THEN lower(labels[-2]) END AS domain_main, {marks("lower(prefix)", " ", digit)} AS prefix_norm, {marks("lower(prefix)", "", digit)} AS prefix_tight,
    CASE WHEN {digit} THEN string_split_regex(prefix, '[ .\-_+]') ELSE string_split_regex(prefix, '[ .\-_\d+]') END AS parts,
    CASE WHEN contains(name, ' ') THEN {marks("lower(name)", "", name_digit, " ")} ELSE {marks("lower(name)", "", name_digit)} END AS compound FROM a2),
  al AS (SELECT *, coalesce({low("words[1]")}, '') AS w0, coalesce({low("words[-1]")}, '') AS w1 FROM a3),
  slots AS ({slot}), ws AS (SELECT uid, i, words[i] AS text FROM (SELECT uid, words, unnest(generate_series(1, n)) AS i FROM al)),
  {norm("SELECT text FROM slots UNION ALL SELECT text FROM ws")},
  sf AS (SELECT uid, slot, form FROM slots JOIN forms USING (text) WHERE form <> ''), wf AS (SELECT uid, i, form FROM ws JOIN forms USING (text) WHERE form <> ''),
  mid AS (SELECT uid, i, {low("text")} AS w FROM ws JOIN (SELECT uid, n FROM al) USING (uid) WHERE i > 1 AND i < n),
  k0 AS ({" UNION ".join(rows)}),
  k AS MATERIALIZED (SELECT kind, key, uid, count(*) OVER (PARTITION BY kind, key) AS n FROM k0 WHERE key IS NOT NULL)"""


def rules(more: bool, config: Config, only: str = "") -> dict[str, list[str]]:
    """Of each option the SELECTs of its pairs (a, b, rule) over ``k``."""
    low, high = config.thr_min, config.thr_max
    listed = _listed(config.blacklist(True))
    long = "|".join(t.replace(".", r"\.").replace("(", r"\(").replace(")", r"\)").replace("+", r"\+").replace("'", "''") for t in config.blacklist(False) if len(t) >= 4)
    new, clean = f"x.key NOT IN ({listed})", f"length(x.key) >= {config.thr_min_length} AND x.key NOT IN ({listed}) AND NOT (x.key <> '' AND (lower(x.key) IN ({listed}) OR regexp_matches(lower(x.key), '{long}')))"
    block, total = f"x.n > {low} AND x.n < {high}", f"x.n < {high} AND y.n < {high} AND x.n + y.n > {low} AND x.n + y.n < {high}"

    def met(label: str, left: str, right: str, where: str, order: str = "<>", more: str = "", on: str = "x.key = y.key") -> str:
        return f"SELECT least(x.uid, y.uid) AS a, greatest(x.uid, y.uid) AS b, '{label}' AS rule FROM k x JOIN k y ON {on} AND x.uid {order} y.uid {more} WHERE x.kind = '{left}' AND y.kind = '{right}' AND {where}"

    both = f"x.n < {high} AND y.n < {high}"
    named = lambda c: f"JOIN al p ON p.uid = x.uid JOIN al q ON q.uid = y.uid AND {c}"
    comma = "(contains(p.name, ',') <> contains(q.name, ',') OR (contains(p.name, ',') AND contains(q.name, ',') AND lower(p.name) <> lower(q.name)))"
    turned = "split_part({0}, ' ', -1) || ' ' || split_part({0}, ' ', 1)"
    owner = "(SELECT key, max(uid) AS uid FROM k WHERE kind = 'site_prefix_name' GROUP BY 1)"
    parts = lambda *at: f" || {SEP} || ".join(f"split_part(x.key, {SEP}, {i})" for i in at)
    exchanged = [f"SELECT least(x.uid, y.uid), greatest(x.uid, y.uid), 'DOMAIN_NAME_MATCH' FROM {owner} x JOIN {owner} y ON y.key = {parts(*at)} AND x.uid <> y.uid" for at in ((4, 3, 1, 2), (3, 4, 1, 2))]
    placed = f"""(SELECT al.uid, location, name FROM al JOIN k l ON l.uid = al.uid AND l.kind = 'location' AND l.n > {low} LEFT JOIN (SELECT DISTINCT key, n AS size FROM k WHERE kind = 'name') s ON s.key = al.name
      WHERE al.n > 1 AND al.name NOT IN ({listed}) AND coalesce(size, 0) < {high})"""
    out = {
        # an address that more than THR_MAX aliases share links all of them with the first one
        "EMAIL": [met("EMAIL", "email", "email", f"x.n > {low} AND x.n <= {high} AND {new}", "<"), f"SELECT y.uid, x.uid, 'EMAIL' FROM k x JOIN (SELECT key, min(uid) AS uid FROM k WHERE kind = 'email' GROUP BY 1) y ON x.key = y.key AND x.uid <> y.uid WHERE x.kind = 'email' AND x.n > {high} AND {new}"],
        "COMP_EMAIL_PREFIX": [met("COMP_EMAIL_PREFIX", "comp_prefix", "comp_prefix", f"{block} AND {clean}", "<")],
        "SIMPLE_EMAIL_PREFIX": [met("SIMPLE_EMAIL_PREFIX", "prefix", "prefix", f"{block} AND {clean}", "<")],
        "PREFIX_LOGIN": [met("PREFIX_LOGIN", "login", "prefix", f"y.n < {high} AND {clean}", "<")],
        "PREFIX_NAME": [met("PREFIX_NAME", "name", kind, f"{both} AND {clean}") for kind in ("prefix", "comp_prefix")],
        "LOGIN_NAME": [met("LOGIN_NAME", "name", "login", f"x.n < {high} AND {new}", "<")],
        "FULL_NAME": [met("FULL_NAME", "name", "name", f"{block} AND length(x.key) >= {config.thr_min_length} AND (contains(x.key, ' ') OR {new})", "<")],
        "DOMAIN": [met("EMAIL_DOMAIN", "domain", "domain", f"{block} AND {new}", "<")],
        "DOMAIN_MAIN_PART": [met("EMAIL_DOMAIN_MAIN_PART", "domain_main", "domain_main", f"{block} AND {new}", "<", named("p.prefix_norm = q.prefix_norm AND p.prefix_norm <> ''"))],
        "DOMAIN_NAME_MATCH": [met("DOMAIN_NAME_MATCH", "site_name", "site", f"{total} AND {new}"), met("DOMAIN_NAME_MATCH", "prefix_site", "first_last", "TRUE"), *exchanged],
        "COMMA_SUFFIX_MATCH": [met("COMMA_SUFFIX_MATCH", "comma_base", "comma_base", f"{block} AND {new}", "<", named(comma))],
        "GITHUB_USERNAME_MATCH": [met("GITHUB_USERNAME_MATCH", "github", "github_name", f"{total} AND {new}")],
        "ABBREV_FIRST_NAME": [met("ABBREV_FIRST_NAME", kind, "full_first", total) for kind in ("abbrev_first", "mail_first")],
        "ABBREV_LAST_NAME": [met("ABBREV_LAST_NAME", kind, "full_last", total) for kind in ("abbrev_last", "mail_last")],
        "ABBREV_MIDDLE_NAME": [met("ABBREV_MIDDLE_NAME", "abbrev_middle", "full_middle", total)],
        "SWITCHED_NAME": [met("SWITCHED_NAME", "turned", "normal", both), met("SWITCHED_NAME", "normal", "normal", f"{both} AND x.key <> {turned.format('x.key')}", "<>", on=f"y.key = {turned.format('x.key')}")],
        "LOCATION": [f"SELECT x.uid AS a, y.uid AS b, 'LOCATION' AS rule FROM {placed} x JOIN {placed} y ON x.location = y.location AND x.name = y.name AND x.uid < y.uid"],
    }
    if not more:
        out = {o: q for o, q in out.items() if o not in ("LOCATION", "PREFIX_LOGIN", "LOGIN_NAME")}
    return {o: q for o, q in out.items() if not only or o == only}


def rule(option: str, config: Config) -> str:
    return f"WITH {keys(True, config)} SELECT DISTINCT * FROM ({' UNION ALL '.join(rules(True, config, option)[option])})"


STRONG = "FULL_NAME SWITCHED_NAME COMP_EMAIL_PREFIX PREFIX_NAME DOMAIN_NAME_MATCH GITHUB_USERNAME_MATCH COMMA_SUFFIX_MATCH ABBREV_FIRST_NAME ABBREV_LAST_NAME ABBREV_MIDDLE_NAME".split()


def decided(config: Config) -> str:
    """CTEs up to ``dec`` (a, b, rules, accepted)."""
    every = " UNION ".join(q for qs in rules(False, config).values() for q in qs)
    return f"""{keys(False, config)}, c0 AS ({every}),
  c1 AS (SELECT a, b, list_sort(list(DISTINCT rule)) AS r FROM c0 GROUP BY 1, 2),
  c2 AS (SELECT a, b, CASE WHEN list_contains(r, 'SIMPLE_EMAIL_PREFIX') THEN list_filter(r, lambda x: x NOT IN ('PREFIX_LOGIN', 'LOGIN_NAME')) ELSE r END AS rules FROM c1),
  c3 AS (SELECT *, CASE WHEN list_contains(rules, 'EMAIL_DOMAIN') OR list_contains(rules, 'EMAIL_DOMAIN_MAIN_PART') THEN list_filter(rules, lambda x: x <> 'DOMAIN_NAME_MATCH') ELSE rules END AS trimmed FROM c2),
  dec AS MATERIALIZED (SELECT a, b, rules, CASE WHEN list_contains(rules, 'EMAIL') THEN ['EMAIL'] WHEN len(rules) >= 2 THEN CASE WHEN len(trimmed) >= 2 THEN trimmed ELSE [] END WHEN rules[1] IN ({_listed(STRONG)}) THEN rules ELSE [] END AS accepted FROM c3)"""


def judged(config: Config) -> str:
    """CTEs up to ``v`` (cid, m, reason, valid, split), with ``mem`` (uid, cid) and ``lab`` (cid, rule, n)."""
    n = lambda rule: f"coalesce((SELECT n FROM lab WHERE lab.cid = per.cid AND lab.rule = '{rule}'), 0)"
    c = {r.lower(): n(r) for r in ("EMAIL", "EMAIL_DOMAIN_MAIN_PART", "SIMPLE_EMAIL_PREFIX", "DOMAIN_NAME_MATCH", "GITHUB_USERNAME_MATCH", "COMMA_SUFFIX_MATCH", "FULL_NAME", "SWITCHED_NAME", "COMP_EMAIL_PREFIX", "LOGIN_NAME", "PREFIX_NAME")}
    counts = ", ".join(f"{v} AS {k}_n" for k, v in c.items())
    abbreviated = f"{n('ABBREV_FIRST_NAME')} + {n('ABBREV_LAST_NAME')} + {n('ABBREV_MIDDLE_NAME')} AS abbrev_n"
    generic = _listed(config.blacklist_generic_terms)
    return rf"""RECURSIVE {decided(config)},
  e AS MATERIALIZED (SELECT a, b FROM dec WHERE len(accepted) > 0), e2 AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach AS (SELECT a AS x, a AS y FROM e2 UNION SELECT reach.x, e2.b FROM reach JOIN e2 ON e2.a = reach.y),
  mem AS MATERIALIZED (SELECT x AS uid, min(y) AS cid FROM reach GROUP BY 1),
  lab AS MATERIALIZED (SELECT cid, rule, count(*) AS n FROM (SELECT cid, unnest(accepted) AS rule FROM dec JOIN mem ON mem.uid = dec.a WHERE len(accepted) > 0) GROUP BY 1, 2),
  gx AS (SELECT uid, lower(name) AS text FROM al UNION ALL SELECT uid, unnest(list_concat(string_split(lower(name), ' '), string_split(lower(name), '_'), string_split(lower(name), '.'), string_split(lower(name), '+'))) FROM al WHERE regexp_matches(name, '[ _.+]')),
  gen AS (SELECT DISTINCT uid FROM gx JOIN al USING (uid) WHERE length(name) >= 3 AND gx.text IN ({generic})),
  per AS (SELECT cid, count(*) AS m, count(DISTINCT coalesce('e' || email, 'n')) AS emails, count(DISTINCT domain) AS domains, coalesce(bool_or(gen.uid IS NOT NULL), FALSE) AS generic
    FROM mem JOIN al USING (uid) LEFT JOIN gen ON gen.uid = mem.uid GROUP BY 1 HAVING count(*) <= {config.thr_max}),
  w AS MATERIALIZED (SELECT per.*, {counts}, {abbreviated} FROM per),
  w2 AS (SELECT *, CASE WHEN email_n >= m - 1 THEN 'email' WHEN email_domain_main_part_n >= 1 AND simple_email_prefix_n >= 1 THEN 'domain_and_prefix' WHEN domain_name_match_n >= 1 THEN 'domain_name' WHEN github_username_match_n >= 1 THEN 'github'
    WHEN comma_suffix_match_n >= 1 THEN 'comma' WHEN abbrev_n >= 1 THEN 'abbreviation' WHEN emails = 1 THEN 'one_email' WHEN full_name_n + switched_name_n > 0 AND domains > 1 AND generic THEN 'bot'
    WHEN full_name_n + switched_name_n > 0 OR comp_email_prefix_n > 0 OR simple_email_prefix_n > 0 THEN 'name_or_prefix' WHEN login_name_n >= m - 1 THEN 'login' WHEN prefix_name_n >= 1 THEN 'prefix_name' ELSE 'none' END AS reason FROM w),
  v AS MATERIALIZED (SELECT cid, m, reason, reason NOT IN ('bot', 'none') AS valid, reason = 'none' AND email_n > 0 AS split FROM w2)"""


def represented(config: Config) -> str:
    """CTEs up to ``rep`` (uid, rep_uid)."""
    ill = " OR ".join([r"regexp_matches(name, '[\x00-\x08\x0B\x0C\x0E-\x1F]')", *[f"contains(name, '{m}')" for m in ["�", *T.MOJIBAKE]]])
    two = "len(q) = 2 AND length(q[1]) > 1 AND length(q[2]) > 1 AND ill = 0"
    title = "array_to_string(list_transform(list_filter(string_split_regex(name, '\\s+'), lambda w: w <> ''), lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ')"
    case = f"CASE WHEN name = {title} THEN 0 WHEN name = lower(name) AND name <> upper(name) THEN 2 WHEN name = upper(name) AND name <> lower(name) THEN 3 ELSE 1 END"
    return f"""{judged(config)},
  r0 AS (SELECT mem.uid, mem.cid, name, email, prefix, valid, split, CAST({ill} AS INT) AS ill, string_split(name, ' ') AS q FROM mem JOIN al USING (uid) JOIN v ON v.cid = mem.cid WHERE valid OR split),
  r1 AS (SELECT *, {two} AS two, prefix IS NULL OR contains(prefix, '+') AS plus FROM r0),
  r2 AS (SELECT cid, uid AS rep_uid FROM r1 WHERE valid QUALIFY row_number() OVER (PARTITION BY cid ORDER BY NOT two, plus, CASE WHEN two THEN -length(name) END, CASE WHEN two THEN -least(length(q[1]), length(q[2])) END,
    CASE WHEN two THEN {case} END, CASE WHEN two THEN name END, CASE WHEN two THEN 0 ELSE ill END, uid) = 1),
  s1 AS (SELECT *, coalesce('e' || email, 'n') AS g, count(*) OVER w AS size, min(ill) OVER w AS least_ill, first_value(uid) OVER (PARTITION BY cid, coalesce('e' || email, 'n') ORDER BY ill, uid) AS rep_uid FROM r1 WHERE split WINDOW w AS (PARTITION BY cid, coalesce('e' || email, 'n'))),
  rep AS (SELECT uid, rep_uid FROM r1 JOIN r2 USING (cid) WHERE valid AND uid <> rep_uid UNION ALL SELECT uid, rep_uid FROM s1 WHERE size > 1 AND (ill = 0 OR least_ill = 1) AND uid <> rep_uid)"""


def flags(aliases: str, config: Config) -> str:
    """The twelve flags of a relation (uid, name, email)."""
    has = lambda c, terms: f"coalesce({c} IN ({_listed(terms)}), FALSE)"
    mailed = lambda terms: " OR ".join(has(c, terms) for c in ("email", "domain", "prefix"))
    c, generic = config, _listed(config.blacklist_generic_terms)
    pieces = " OR ".join(f"len(list_filter(string_split(prefix, '{m}'), lambda x: x IN ({generic}))) > 0" for m in "._")
    splits = ", ".join(f"string_split(lower(name), '{m}')" for m in " _.+")
    values = {
        "name_git": has("w", c.blacklist_git_hosting), "name_email_provider": has("w", c.blacklist_email_providers), "name_first": "FALSE",
        "name_generic": f"{has('w', c.blacklist_generic_terms)} OR g.uid IS NOT NULL", "name_missing": has("w", c.blacklist_no_names), "name_machine": has("w", c.blacklist_machine_names), "name_privacy": has("w", c.blacklist_privacy_emails),
        "email_git": mailed(c.blacklist_git_hosting), "email_generic": f"{mailed(c.blacklist_generic_terms)} OR coalesce(regexp_matches(prefix, '[._]') AND ({pieces}), FALSE)",
        "email_missing": mailed(c.blacklist_no_names), "email_machine": mailed(c.blacklist_machine_names), "email_privacy": mailed(c.blacklist_privacy_emails),
    }
    placeholder = " OR ".join(f"ends_with(e, '{x}')" for x in T.FAKE_ENDINGS)
    return f"""WITH f0 AS (SELECT uid, coalesce(trim(name), '') AS name, lower(trim(email)) AS e FROM ({aliases})), f1 AS (SELECT uid, name, CASE WHEN NOT (e = '' OR e = 'none' OR {placeholder}) THEN e END AS email FROM f0),
  f2 AS (SELECT *, nullif(split_part(email, '@', 1), '') AS prefix, nullif(split_part(email, '@', -1), '') AS domain FROM f1),
  pieces AS (SELECT uid, unnest(list_concat({splits})) AS text FROM f2 WHERE regexp_matches(name, '[ _.+]')),
  {norm("SELECT lower(name) AS text FROM f2 UNION ALL SELECT text FROM pieces", True)},
  g AS (SELECT DISTINCT uid FROM pieces JOIN forms USING (text) WHERE text <> '' AND form IN ({generic})), w AS (SELECT f2.*, form AS w FROM f2 JOIN forms ON forms.text = lower(name))
  SELECT w.uid, {", ".join(f"CASE WHEN length(name) >= 3 THEN {v} END AS {k}" for k, v in values.items())} FROM w LEFT JOIN g ON g.uid = w.uid"""


def privacy(lines: str) -> str:
    """How many keys of each kind are left of noreply signatures whose aliases stay out of the indexes."""
    people = rf"SELECT DISTINCT author AS uid, trim(split_part(author, '<', 1)) AS name, regexp_extract(author, '<([^>]*)>', 1) AS email FROM ({lines})"
    hidden = _listed(["email", "prefix", "comp_prefix", "login", "name", "domain", "domain_main", "location"])
    return f"WITH {keys(False, Config(), people)} SELECT kind, count(*) AS n FROM k JOIN al USING (uid) WHERE NOT (coalesce(domain = 'users.noreply.github.com', FALSE) AND kind IN ({hidden})) GROUP BY 1"


def oracle() -> dict[str, str]:
    config = Config()
    flat = "a, b, array_to_string(rules, ',') AS rules, array_to_string(accepted, ',') AS accepted"
    return {
        **{f"rule_{o.lower()}": rule(o, config) for o in config.rules},
        "pair_decision": f"WITH {decided(config)} SELECT {flat} FROM dec",
        "rule_label_counts": f"WITH {judged(config)} SELECT * FROM lab",
        "cluster_validity": f"WITH {judged(config)} SELECT * FROM v",
        "representative": f"WITH {represented(config)} SELECT * FROM rep",
        "weird_flags": flags(PEOPLE.replace("WORDS", WORDS_SQL), config),
        "normalize_forms": f"WITH {norm('SELECT name AS text FROM (' + PEOPLE.replace('WORDS', WORDS_SQL) + ')')} SELECT text AS name, form FROM forms",
        "resolve_identities": f"WITH {represented(config)} SELECT al.uid, coalesce(rep_uid, al.uid) AS rep_uid FROM al LEFT JOIN rep ON rep.uid = al.uid",
    }
