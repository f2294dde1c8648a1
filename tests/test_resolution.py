from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinloom.config import Config, parse_config
from kinloom.functions import text as T
from kinloom.functions.normalize import normaliser
from kinloom.operators import evaluate, resolve
from kinloom.operators.components import connected_components
from kinloom.operators.keys import aliases, key_rows
from kinloom.plans import catalogue
from kinloom.plans.scratch import Scratch
from kinloom.sources import parsers, sinks

ALIASES = [
    (1, "Jürgen Müller", "j.mueller@firm.de"), (2, "Juergen Mueller", "juergen@home.org"), (3, "Ana Quill", "ana.quill@a.org"), (4, "aquill", "ANA.QUILL@a.org"),
    (5, "Rowan Tesk", "r@x.org"), (6, "Tesk, Rowan", "t@y.org"), (7, "Q. Vandersloot", "q@z.org"), (8, "Quillon Vandersloot", "v@w.org"),
    (9, "Orla Penhallow, PhD", "o@p.org"), (10, "Orla Penhallow", "op@q.org"), (11, "zedkraft", "4711+zedkraft@users.noreply.github.com"), (12, "zedkraft", "zk@r.org"),
    (13, "Mira Solstad", "mira@solstad.io"), (14, "Mira Solstad", "m.s@corp.net"), (15, "admin", "admin@s.org"), (16, "admin", "admin@t.org"),
    (17, "h3lm n0rd", "helm.nord@u.org"), (18, "x", "helmnord@v.org"), (19, "MÃ¼ller Test", "mt@aa.org"), (20, "", "none"), (21, None, None),
]
EXPECTED = {1: 2, 4: 3, 5: 6, 7: 8, 9: 10, 11: 12, 14: 13, 18: 17}


def frame(spark, rows=ALIASES):
    return spark.createDataFrame(rows, "uid long, name string, email string")


def test_mini_fixture(spark):
    got = {r.uid: r.rep_uid for r in resolve.resolve(frame(spark)).collect()}
    assert {k: v for k, v in got.items() if k != v} == EXPECTED and len(got) == len(ALIASES)
    assert all(got[v] == v for v in got.values())


def test_groups_are_separate(spark):
    d = frame(spark).withColumn("g", (F.col("uid") > 1).cast("string"))
    got = {r.uid: r.rep_uid for r in resolve.resolve(d, group="g").collect()}
    assert got[1] == 1 and got[4] == 3


def test_rule_switched_off(spark):
    config = Config(rules=Config().rules - {"SWITCHED_NAME"})
    got = {r.uid: r.rep_uid for r in resolve.resolve(frame(spark, ALIASES[4:6]), config).collect()}
    assert got == {5: 5, 6: 6}


def test_shared_address_above_the_cap_is_discarded(spark):
    rows = [(i, f"name{i}", "shared@b.org") for i in range(60)] + [(100 + i, f"other{i}", "few@b.org") for i in range(5)]
    got = {r.uid: r.rep_uid for r in resolve.resolve(frame(spark, rows), Config(rules=frozenset(["EMAIL"]))).collect()}
    assert all(got[i] == i for i in range(60)) and all(got[100 + i] == 100 for i in range(5))


@pytest.mark.parametrize(
    "text, forms",
    [("Dr. Jörg Åse-Øst 2019", {"jorg aaseoest", "joerg aaseoest"}), ("13:37:28 Ann Lee", {"ann lee"}), ("Ann Lee GMT", {"ann lee"}), ("Iвана Петров", {"ivana petrov"}), ("Timur I. Bakey", {"timur bakey"}), ("ö", {"o", "oe"}), ("", {""})],
)
def test_normal_forms(text, forms):
    f = normaliser(Config())
    assert {f(text, g, False) for g in (True, False)} == forms
    assert f(None, True, True) is None


def test_config_file():
    c = parse_config("EMAIL = false # off\nTHR_MAX = 7\nBLACKLIST_NO_NAMES = a, b c\nDEBUG = true\nWHAT = 1\n")
    assert not c.has("EMAIL") and c.thr_max == 7 and c.blacklist_no_names == ("a", "b c") and c.debug


def test_flags_of_short_names_are_null(spark):
    rows = {r.uid: r for r in aliases(frame(spark), Config()).collect()}
    assert rows[18].name_generic is None and rows[15].name_generic and rows[15].email_generic and rows[11].email_privacy


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 9), (10, 12), (12, 11), (None, 1), *[(i, i + 1) for i in range(100, 140)]], "a long, b long")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 9, 10: 10, 11: 10, 12: 10, **{i: 100 for i in range(100, 141)}}
    assert connected_components(edges.limit(0)).count() == 0


def test_line_errors(spark):
    lines = ["a;b", "ab", "a" + ";" * 11, 'a;"b', "a;\x01b", "x" * 1001 + ";b", "a;" + "y" * 5001, "z" * 10001]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "v string").select(F.transform(T.line_errors(F.col("v")), T.error_head)).collect()]
    assert got == [[], ["no_semicolon"], ["too_many_semicolons"], ["unbalanced_quotes"], ["control_chars"], ["repo_too_long"], ["author_too_long"], ["no_semicolon", "line_too_long"]]


def test_packages_stand_without_the_llm_subpackage():
    root = Path(resolve.__file__).resolve().parents[1]
    assert not [f for f in root.rglob("*.py") if "llm" not in f.parts and "kinloom.llm" in f.read_text()]


def test_text_queries_read_whole_texts(spark, tmp_path):
    long = "plain words " * 100
    texts = [long, long + "é", "é" + long, long + "\x01", "", "a", "Ωλ" * 300, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: dict(catalogue.queries()[n](spark, str(tmp_path)).collect()) for n in ("ill_encoded", "utf8_filter")}
    marks = ["\ufffd", *T.MOJIBAKE, *map(chr, [*range(9), 11, 12, *range(14, 32)])]
    assert got["ill_encoded"] == {i: any(m in (t or "").encode().decode("latin-1") for m in marks) for i, t in enumerate(texts)}
    assert [got["ill_encoded"][i] for i in range(4)] == [False, True, True, True]
    assert got["utf8_filter"] == {i: None if t is None else i % 4 == 3 for i, t in enumerate(texts)}


def test_alias_file_reads_all_aliases(spark, tmp_path):
    names = ["Ann Lee", "Bo Ek", "Cy Dow", "Ann Lee", "", "", "", "Eve", "Fay", "Gil Orr"]
    rows = [(i, n and f"{n} 7", "s", "en") for i, n in enumerate(names)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, n in enumerate(names):
        alias = (n, n.lower().replace(" ", ".") + "@s.example.en")
        # without a name only "name;email" lines are an alias
        if (n or (i + 1) % 3 == 1) and alias not in want:
            want.append(alias)
    got = sorted((r.uid, r.name, r.email) for r in catalogue.queries()["alias_file"](spark, str(tmp_path)).collect())
    assert got == [(i + 1, *a) for i, a in enumerate(want)] and len(got) == 7


def test_bootstrap_query_draws_all_resamples(spark, monkeypatch):
    real, seen = evaluate.bootstrap_intervals, []

    def spy(long, resamples=10_000, *a):
        seen.append(resamples)
        return real(long, 20)

    monkeypatch.setattr(evaluate, "bootstrap_intervals", spy)
    assert catalogue.queries()["ci_bootstrap"](spark, "/root/testdata/sf0.001").count() > 0 and seen == [10_000]


@pytest.mark.parametrize("bounds", [{}, {"hot_rows": 2, "broadcast_rows": 0}])
def test_email_blocks_above_the_cap_are_stars(spark, bounds):
    rows = [(1 + i, f"n{i}", "big@a.org") for i in range(41)] + [(101 + i, f"n{i}", "few@a.org") for i in range(40)]
    s, config = Scratch(spark), Config(rules=frozenset(["EMAIL"]))
    a = s.table(aliases(frame(spark, rows), config))
    keys = resolve.sized_keys(key_rows(a, config), s, **bounds)
    assert {r.key: r.n for r in keys.where("kind = 'email'").collect()} == {"big@a.org": 41, "few@a.org": 40}
    got = {(r.a, r.b) for r in resolve.candidate_pairs(a, keys, config).collect()}
    assert got == {(1, 1 + i) for i in range(1, 41)} | {(101 + i, 101 + j) for j in range(40) for i in range(j)}


def test_all_pairs_in_blocks(spark):
    ids = spark.createDataFrame([(i, f"s{i % 3}") for i in range(11)], "id long, s string")
    want = sorted((i, j, int(i % 3 == j % 3)) for j in range(11) for i in range(j))
    assert [sorted(map(tuple, parsers._all_pairs(ids, "s", b).collect())) for b in (1, 4, 2048)] == [want] * 3


def test_report_and_file(spark, tmp_path):
    df = frame(spark).withColumn("login", F.lit(None).cast("string"))
    s, config = Scratch(spark), Config()
    a = s.table(aliases(df, config))
    out = resolve.report(df, resolve.resolve(df, config), a, "proj")
    rows = {r.original_author_id: r for r in out.collect()}
    assert rows["aquill <ANA.QUILL@a.org>"].dealiased_author_id == "Ana Quill <ana.quill@a.org>" and rows["admin <admin@s.org>"].project == "proj"
    assert rows["admin <admin@s.org>"].is_original_author_weird_id == "(False, False, False, True, False, False, False, False, True, False, False, False)"
    path = str(tmp_path / "out")
    for _ in range(2):
        sinks.write_resolution(out.drop("username"), path, append=True, drop_flags=True)
    back = spark.read.csv(path, sep=";", header=True)
    assert back.columns == ["project", "original_author_id", "dealiased_author_id"] and back.count() == 2 * len(ALIASES)


def test_forms_are_those_of_all_customs(spark):
    """Texts whose customs make no difference are worked out once; the result is that of all four."""
    from kinloom.functions.normalize import forms_udf, normaliser

    texts = ["", "Ann", "Jörg Weiß", "l33t", "GMT ann 1999", "13:37:28 ẍ $", "cet", "é É ß €", "Dr. III Bo", "İ 2021 utc "]
    normal = normaliser(Config())
    got = spark.createDataFrame([(texts,)], "t array<string>").select(forms_udf(Config())("t").alias("f")).first().f
    assert got == [sorted({normal(t, g, k) for g in (True, False) for k in (True, False)}) for t in texts]


def test_upper_case_of_people_is_that_of_sql(spark, tmp_path):
    """Two words that are one in an upper case of several characters: IESS."""
    import duckdb

    rows = [(7 + 9 * i, f"{w} an bo", "s", "de") for i, w in enumerate(["Ieß", "iess", "ieß", "Über", "über"])]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(path := f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = {(a, b) for a, b, _ in con.execute(catalogue.oracle_sql()["rule_email"]).fetchall()}
    assert {(r.a, r.b) for r in catalogue.queries()["rule_email"](spark, str(tmp_path)).collect()} == want
    assert {(32, 104), (140, 176)} <= want and (32, 68) not in want


def test_large_blocks_of_domain_names_meet_by_class(spark):
    """What the classes of large blocks give is what the pairs one by one give: pairs, rules, decision, components and counts."""
    rows = [(i, "ann lee", f"p{i}@d{i % 9}.org") for i in range(40)]  # first_last: ann lee
    rows += [(100 + i, ("bo ek", "ann lee", "zed")[i % 3], f"ann@lee.{'com' if i < 25 else f'x{i}.lee.net'}") for i in range(40)]  # prefix_site
    rows += [(200 + i, "bo ek", f"q{i}@bo{i}.com") for i in range(20)] + [(300 + i, "ann lee", f"bo@ek.n{i}") for i in range(20)]
    rows += [(400 + i, "ann lee", f"r{i}@lee.x{30 + i}.lee.net") for i in range(5)]  # refused, as of one domain
    s, config = Scratch(spark), Config(thr_max=4)
    a = s.table(aliases(frame(spark, rows), config))
    keys = s.table(resolve.sized_keys(key_rows(a, config), s))
    whole = resolve.decide(resolve.clues(resolve.candidate_pairs(a, keys, config)))
    blocks = resolve.dense_blocks(keys, config, s, 7)
    assert {r.key for r in blocks.blocks.collect()} == {"ann\x01lee", "bo\x01ek"} and blocks.members.where("chunk > 0").count()
    listed = resolve.decide(blocks.mark(resolve.clues(resolve.candidate_pairs(a, keys, config, blocks))))
    want = {(r.a, r.b): (r.rules, r.accepted) for r in whole.collect()}
    got = [((r.a, r.b), (r.rules, r.accepted)) for r in listed.collect()] + [((r.a, r.b), ([blocks.label],) * 2) for r in blocks.pairs().collect()]
    assert dict(got) == want and len(got) == len(want) and blocks.taken.count() > 0 and any(not x[1] for x in want.values())
    for k in (0, 1):
        one, two = resolve.clusters(whole, s), resolve.clusters(listed, s, blocks)
        assert sorted(map(tuple, one[k].collect())) == sorted(map(tuple, two[k].collect()))


def test_all_pairs_are_dealt_over_tasks(spark):
    """The number of tasks follows the pairs, not the bytes of the ids; without a value a label is null."""
    ids = spark.createDataFrame([(i, f"s{i % 3}" if i != 5 else None) for i in range(120)], "id long, s string")
    got = parsers._all_pairs(ids, "s", 8, task_pairs=100)
    assert got.rdd.getNumPartitions() == 120 * 119 // 2 // 100 + 1
    want = sorted((i, j, -1 if 5 in (i, j) else int(i % 3 == j % 3)) for j in range(120) for i in range(j))
    assert sorted((r.id1, r.id2, -1 if r.label is None else r.label) for r in got.collect()) == want


def test_wiese_pairs_are_dealt_over_tasks(spark, monkeypatch):
    """Addresses of cluster lines meet in tasks by the number of pairs."""
    real = parsers._all_pairs
    monkeypatch.setattr(parsers, "_all_pairs", lambda ids, same: real(ids, same, 8, task_pairs=100))
    lines = spark.createDataFrame([(i, f"k{i % 4}#=##=#a{i}@x.org#;#b{i}@x.org") for i in range(30)], "pos long, value string")
    got = parsers.wiese_pairs(parsers.wiese(lines))
    assert got.rdd.getNumPartitions() == 60 * 59 // 2 // 100 + 1
    assert sorted(map(tuple, got.collect())) == sorted((i, j, int(i // 2 % 4 == j // 2 % 4)) for j in range(60) for i in range(j))


def test_all_pairs_make_no_rows_but_pairs(spark):
    """Pairs follow from their numbers: nothing is exploded, joined or shuffled to give them, and gaps of tasks lose none."""
    ids = spark.createDataFrame([(i, f"s{i % 7}") for i in range(500)], "id long, s string")
    got = parsers._all_pairs(ids, "s", 64, task_pairs=999)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Generate", "Join", "Exchange") if x in plan]
    rows = got.collect()
    assert len(rows) == len({(r.id1, r.id2) for r in rows}) == 500 * 499 // 2
    assert all(0 <= r.id1 < r.id2 < 500 and r.label == int(r.id1 % 7 == r.id2 % 7) for r in rows)
    assert parsers._all_pairs(ids.limit(0), "s").count() == parsers._all_pairs(ids.limit(1), "s").count() == 0


def test_forms_of_sliced_lists_with_nulls():
    """Lists are rebuilt by their lengths, wherever a batch begins; null lists, null texts and empty lists stay."""
    import pyarrow as pa

    from kinloom.functions.normalize import _of_each

    lists = [["x"], None, ["a", None, "b", "a"], [], ["c"]]
    got = _of_each(pa.array(lists, pa.list_(pa.string())).slice(1), lambda t: [t, t + t], pa.list_(pa.string()))
    assert got.to_pylist() == [None, [["a", "aa"], None, ["b", "bb"], ["a", "aa"]], [], [["c", "cc"]]]
    assert _of_each(pa.array([], pa.list_(pa.string())), str, pa.string()).to_pylist() == []


def test_people_are_of_the_first_three_words(spark, tmp_path):
    """Wherever these are, and without a list of all words."""
    import re

    from kinloom.plans.catalogue import people_view

    texts = ["1 -- ab-cd\n\n" + "7 " * 5000 + "éf gh ij", "a", "", None, "12 34", "one two", "  Ünï, b c d " * 400]
    docs = spark.createDataFrame([(i * 9, t, "web", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    people = people_view(spark, str(tmp_path))
    assert "{0,3}" in people._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.uid - 1) // 36: r.name for r in people.where("(uid - 1) % 4 = 0").collect()}
    word = lambda t: [*re.findall(r"[^\W\d_]+", t or ""), "", ""]
    assert got == {i: " ".join(word(t)[:2]) for i, t in enumerate(texts)}
