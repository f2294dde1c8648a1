"""Operators of the training-data subpackage against brute force, on small fixtures with nulls,
empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm import bpe, dedup, jaccard, katz, langid, mixing, quality, tokencount, urls, warc
from kinloom.plans.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, n long"
rng = random.Random(11)
VOCAB = [f"w{i}" for i in range(80)] + ["the", "of", "der", "la"]


def some(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


BASE = [some(rng.randrange(3, 120)) for _ in range(60)]
TEXTS = [None, "", " \n", "a", "A b", *BASE, *BASE[:8], *[b.replace(" ", "\n", 1) for b in BASE[:5]], *[b + " tail" for b in BASE[20:35]], some(6000), "é ß <|endoftext|> 日本\t\tx", "x" * 20000]
ROWS = [(i if i % 17 else None, t, ("en", "de", None)[i % 3], ("s1", "s2", "s3", None)[i % 4], None, "extra", 7) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[9], ROWS[9]]


@pytest.fixture(scope="module")
def docs(spark):
    return Scratch(spark).table(spark.createDataFrame(ROWS, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def none(spark):
    return Scratch(spark).table(spark.createDataFrame([], SCHEMA))


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def test_empty_tables(none, spark):
    for op in (mixing.op1, langid.op2, bpe.op4, dedup.op6, katz.op7, jaccard.op8, tokencount.count, quality.op10):
        assert op(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.op5(pages).count() == 0


def test_mix(docs):
    digest = lambda: mixing.op1(docs).withColumn("shards", F.col("shards").cast("string")).toPandas()
    got = digest()
    assert len(got) == len(ROWS)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    per = got.merge(docs.select("doc_id", "source").distinct().toPandas(), on="doc_id").dropna(subset=["doc_id"])
    assert (got.taken <= 3 * got["size"]).all()
    assert abs(got.taken.sum() - sum(sizes.values())) <= 4
    assert got.drop_duplicates("source_size").target.sum() == pytest.approx(sum(sizes.values()))
    again = digest()
    key = list(got.columns)
    assert got.sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True)) and len(per)


def test_mix_shards_are_exact(docs):
    copies = mixing.mix(docs, shard_words=1500, block_docs=2)
    drawn = copies.where("epoch is not null")
    assert drawn.where("shard is null").count() == 0
    assert drawn.select("uid", "epoch").distinct().count() == drawn.count()
    out = mixing.mixed_rows(docs, copies)
    assert sum(len(words(r.text)) for r in out.collect()) == drawn.agg(F.sum("words")).first()[0]


@pytest.mark.parametrize("limit", [10**9, 2])
def test_splitting_tree_is_consistent(limit):
    """Every shard finds the same tree by itself; quotas and starts are exact per pool, for one group of pools and for several."""
    totals, pools = np.array([110, 40, 0], np.int64), [np.array([7, 0, 100, 3]), np.array([1, 39]), np.array([], np.int64)]
    for g, quota in enumerate(pools):
        every = list(mixing._leaves(5, (0, 5), totals, g, quota, 3, limit))
        assert [i for i, _, _ in every] == list(range(5))
        at = np.zeros_like(quota)
        for i, got, start in every:
            (one,) = mixing._leaves(5, (i, i + 1), totals, g, quota, 3, limit)
            assert (one[1] == got).all() and (one[2] == start).all() and (start == at).all()
            at = at + got
        assert (at == quota).all()
    sizes = [sum(int(next(mixing._leaves(5, (i, i + 1), totals, g, q, 3, limit))[1].sum()) for g, q in enumerate(pools)) for i in range(5)]
    assert sizes == [30] * 5


def test_large_draws_follow_the_distribution():
    """The inverted distribution function, made to serve small urns, against probabilities by binomials; and a huge urn's mean and spread."""
    for good, bad, n in ((5, 9, 6), (40, 3, 20), (1, 1, 1), (30, 70, 50)):
        rng_ = np.random.default_rng(1)
        got = Counter(mixing._hypergeometric(rng_, good, bad, n, 0) for _ in range(20000))
        for x in range(n + 1):
            p = math.comb(good, x) * math.comb(bad, n - x) / math.comb(good + bad, n)
            assert abs(got[x] / 20000 - p) < 5 * math.sqrt(p * (1 - p) / 20000) + 1e-4
    good, bad, n = 3_000_000_000, 2_000_000_000, 2_500_000_000
    draws = np.array([mixing._hypergeometric(np.random.default_rng(i), good, bad, n, 10**9) for i in range(60)], float)
    sd = math.sqrt(n * 0.6 * 0.4 * 0.5)
    assert abs(draws.mean() - 0.6 * n) < 5 * sd / math.sqrt(60) and 0.7 * sd < draws.std() < 1.3 * sd


def test_mix_of_many_sources_has_quotas_per_source(spark):
    """More sources than a group holds: each source still has its own exact number of blocks, and disjoint ones."""
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randrange(1, 30)), f"s{i % 23}", 1) for i in range(600)]
    frame = Scratch(spark).table(spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(3))
    for group_pools in (4, 4096):
        copies = mixing.mix(frame, shard_words=500, block_docs=4, group_pools=group_pools).where("epoch is not null").toPandas()
        assert copies["shard"].nunique() > 8 and copies["shard"].notna().all()
        per_block = copies.groupby(["source", "shard"]).size().reset_index(name="n")
        blocks = per_block.assign(b=-(-per_block.n // 4)).groupby("source").b.sum()
        whole = -(-copies.groupby("source").size() // 4)
        assert ((blocks >= whole) & (blocks <= whole + 1)).all()
    out = mixing.mixed_rows(frame, mixing.mix(frame, shard_words=500))
    assert out.columns == [*frame.columns, "_shard", "position"] and out.where("shard <> 1").count() == 0


def test_mix_targets_by_brute_force(spark):
    """Targets, caps and what is taken per source, from the contract's words."""
    sizes = {"a": 100, "b": 4000, "c": 30, "d": 2000, "e": 0, None: 700}
    rows = [(i, " ".join(["x"] * 10), s) for s, n in sizes.items() for i in range(n // 10)] + [(0, "", "e")]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    total, names = sum(sizes.values()), sorted(s for s in sizes if s) + [None]
    weight = dict(zip(names, [5, 2, 1] * 2, strict=False))
    target, open_ = {}, set(names)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not full:
            break
        target |= {s: 3 * sizes[s] for s in full}
        open_ -= set(full)
    target |= share
    got = mixing.op1(Scratch(spark).table(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))).toPandas()
    of = {i: s for i, _, s in rows}
    got["source"] = got.doc_id.map(lambda i: of[i] or "")
    for s in names:
        mine = got[got.source == (s or "")]
        assert mine.target.tolist() == pytest.approx([target[s]] * len(mine)) and set(mine.source_size) == {sizes[s]}
        assert abs(mine.taken.sum() - target[s]) <= 1


def test_langid(spark):
    parts = {"en": "th er ing and of", "de": "sch ein ung der ch", "fr": "eau que ment les oi", "es": "ción ado los rr ll"}
    rows = [(i, " ".join("".join(rng.choices(p.split(), k=3)) for _ in range(30)), lang) for lang, p in parts.items() for i in range(len(lang) + ord(lang[0]) % 7, 4000, 53)]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)] + [(None, None, "en"), (-1, "12 !", "en"), (-2, "É", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(i, lang) for i, _, lang in rows if i is not None and i >= 0 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and sum(got[i].lang_pred == lang for i, lang in held) >= 0.98 * len(held)
    assert got[-1].lang_pred == "und" and got[None].lang_pred == "und" and got[-2].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_langid_sample_counts_repeated_texts_once(spark):
    texts = [(f"{lang} {some(12)} {i}", lang) for lang in ("en", "de") for i in range(300)]
    frame = spark.createDataFrame(texts, "text string, lang string").where("lang = 'en'")
    least = frame.orderBy(F.shiftrightunsigned(F.xxhash64("text", "lang"), 11)).first().text  # is in the sample for sure
    rows = [(i, t, lang) for i, (t, lang) in enumerate(texts + [(least, "en")] * 500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit(False))
    got = langid.training_rows(frame, 80, Scratch(spark)).collect()
    assert len(got) == len(set(got)) and Counter(r.lang for r in got) == {"en": 40, "de": 40}


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a.b/c?x", big), (2, None, None), (3, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n" * 30), (4, "http://a/\r\nb", big), (5, "v", "short"), (6, "v", "short"), (7, "z", big), (None, "z", big), (7, "z", big)]
    pages = Scratch(spark).table(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.op3(pages).collect()
    want = []
    for p, _, h in rows:
        h = (h or "").encode()
        again = len(h) >= 1000 and h == big.encode() and p != 7
        want.append((p, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", 7 if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    path = Scratch(spark).path("w")
    warc.write_archive(pages, path)
    t = warc.transactions(warc.read_records(spark, path)).collect()
    assert len(t) == len(rows) and all(r.request and r.metadata for r in t)
    assert {bytes(r.response.payload).decode() for r in t if r.response.type == "response"} == {h or "" for _, _, h in rows}


def test_warc_of_other_writers(spark, tmp_path):
    """Links in any direction and over several steps, several concurrent-to fields, lengths that are no number, and files without records."""
    def record(kind, name, body, *to, length=None):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *[f"WARC-Concurrent-To: <{x}>" for x in to], "Content-Type: application/http", f"Content-Length: {len(body) if length is None else length}"]
        return "WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n" + body + "\r\n\r\n"

    http = lambda x: f"HTTP/1.1 200 OK\r\n\r\n{x}"
    text = record("response", "r1", http("one")) + record("request", "q1", "GET /1", "r1") + record("metadata", "m1", "k: 1", "q1")
    text += record("response", "r2", http("two"), "q2", "m2") + record("request", "q2", "GET /2") + record("metadata", "m2", "k: 2")
    text += record("request", "q3", "GET /3", "m3", length="soon") + record("response", "r3", http("three")) + record("metadata", "m3", "k: 3", "x3") + record("warcinfo", "x3", "", "y3") + record("metadata", "y3", "k: 0", "r3")
    text += record("request", "alone", "GET /", "nobody", length="-5") + record("resource", "r4", http("four"), length="")
    (tmp_path / "a.warc").write_bytes(text.encode())
    (tmp_path / "b.warc").write_bytes(b"no records\r\n\r\nWARC/1.1 cut off")
    got = {r.capture_id: r for r in warc.transactions(warc.read_records(spark, str(tmp_path))).collect()}
    assert set(got) == {"<r1>", "<r2>", "<r3>", "<r4>"}
    name = lambda x: x and x.record_id
    assert [(name(got[f"<r{i}>"].request), name(got[f"<r{i}>"].metadata)) for i in range(1, 5)] == [("<q1>", "<m1>"), ("<q2>", "<m2>"), ("<q3>", "<y3>"), (None, None)]
    assert [bytes(got[f"<r{i}>"].response.payload) for i in range(1, 5)] == [b"one", b"two", b"three", b"four"]
    pages = Scratch(spark).table(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.op3(pages).count() == 0


def test_bpe_and_counts_match_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    marks = ["a", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "é", "1", "$", "<|endoftext|>", "aaaa", "\U0001f600", "the", "İ", "_"]
    rows = [(i, "".join(rng.choices(marks, k=rng.randrange(25)))) for i in range(1500)]
    frame = docs.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10_000).dropDuplicates(["doc_id"]).union(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"))
    coded, counts = bpe.encode(frame), {r.doc_id: r for r in tokencount.count(frame, chunk=7).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(coded).collect()}
    for r in coded.join(frame, "doc_id").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert r.token_ids == ids and r.n_tokens == len(ids) == counts[r.doc_id].n_tokens
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and back[r.doc_id] == text
        assert counts[r.doc_id].n_bytes == len((r.text or "").encode()) and counts[r.doc_id].over_limit == (len(ids) > 512)


def test_state_maps_compose_associatively(spark):
    """Any bracketing of any chunks is the same function of the entry state, and counts as the library does."""
    tokenizers = pytest.importorskip("tokenizers")
    tok, m, r = tokenizers.Tokenizer.from_file(bpe.tokenizer_path()), tokencount.Machine(bpe.Bpe(bpe.tokenizer_path())), random.Random(5)
    marks = ["a", "'s", "'ll", "'", "r", "v", "e", "l", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "é", "1", "$", "aaaa", "\U0001f600", "the", "İ", "_", "\xa0", "日本"]
    entries = [m.run(m.start, t)[0] for t in ("", "th", " ", "a \n", "'", "don'", "x'r", "12", "日", "..'")]
    at = lambda x, q: (lambda h: h[1] + (x[1] or 0))(m.run(q, x[0]))
    for _ in range(600):
        parts = ["".join(r.choices(marks, k=r.randrange(8))) for _ in range(4)]
        a, b, c, d = (tokencount.map_of(m, p) for p in parts)
        t = lambda x, y: tokencount.then(m, x, y)
        ways = [t(t(t(a, b), c), d), t(a, t(b, t(c, d))), t(t(a, b), t(c, d)), tokencount.compose(m, [a, b, c, d])]
        for q in entries:
            assert {at(w, q) for w in ways} == {m.run(q, "".join(parts))[1]}
        assert tokencount.total(m, ways[0]) == len(tok.encode("".join(parts), add_special_tokens=False).ids)
        cut = [a, b, tokencount.SPECIAL, c, d]
        want = sum(len(tok.encode("".join(p), add_special_tokens=False).ids) for p in (parts[:2], parts[2:])) + 1
        assert tokencount.total(m, tokencount.compose(m, cut)) == want == tokencount.total(m, t(t(a, t(b, tokencount.SPECIAL)), t(c, d)))


def test_token_counts_of_nulls_and_forgotten_states(spark, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(tokencount, "KEEP_SINGLE", 5)
    monkeypatch.setattr(tokencount, "KEEP_COMPOSED", 3)
    tok, m = tokenizers.Tokenizer.from_file(bpe.tokenizer_path()), tokencount.Machine(bpe.Bpe(bpe.tokenizer_path()))
    for t in BASE[:20]:
        m.forget()
        assert m.run(m.start, t)[1] == len(tok.encode(t, add_special_tokens=False).ids)
    rows = [(None, "a b " * 900, 1), (None, None, 1), (1, "", 2), (1, "x" * 3000, 2), (1, "<|endoftext|>" * 300, 2)]
    got = tokencount.count(spark.createDataFrame(rows, "doc_id long, text string, uid int"), chunk=1000).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)


def test_url_rules_and_propagation(spark):
    rows = [(1, "http://X.Example.com/en/7?q"), (2, "https://a.com/en/9"), (3, "http://com/en/"), (4, "http://acom/en/"), (5, None), (6, "nothing"), (7, "ftp://b.net/de/8#x"), (8, "http://example.net/de/81")]
    rows = [(i, u, None) for i, u in rows] + [(20 + i, f"http://h{i}.info/", '<a href="http://bad.com/en/x">') for i in range(3)] + [(40, "http://bad.com/en/x", "")] + [(50 + i, f"http://clean{i}.info/", "") for i in range(60)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(1, 9)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("com/en/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/de/", "block"), ("example.net/de/8", "allow")]
    assert got[1].host == "x.example.com" and got[1].path == "/en/7" and got[5].host == "" and got[6].path == ""
    assert all(got[20 + i].verdict == "block" for i in range(3)) and all(got[50 + i].verdict == "allow" for i in range(60))


@pytest.mark.parametrize("bounds", [{}, {"hot_rows": 2, "broadcast_rows": 0}])
def test_url_propagation_by_brute_force(spark, bounds):
    """Fixed points of both ranks on a random graph with cycles and a hub, solved as linear systems."""
    r = random.Random(12)
    hosts = [f"h{i}.info" for i in range(24)] + ["bad.com", "worse.com", "example.com"]
    links = [(a, b) for a in hosts for b in r.sample(hosts, r.randrange(4)) if a != b] + [(a, "hub.info") for a in hosts[:20]] + [("hub.info", b) for b in hosts[5:]]
    hosts.append("hub.info")
    path = lambda h: "/en/7" if h == "example.com" else "/en/x" if h.endswith(".com") else "/"
    rows = [(i, f"http://{h}{path(h)}", "".join(f'<a href="http://{b}/p">' for a, b in links if a == h)) for i, h in enumerate(hosts)]
    rows += [(100, "http://bad.com/ok", ""), (101, None, None), (None, "http://h0.info/", None)]
    at = {h: i for i, h in enumerate(hosts)}
    step = np.zeros((len(hosts), len(hosts)))
    for a, b in set(links):
        step[at[a], at[b]] = 1 / len({y for x, y in links if x == a})
    seed = lambda *hs: np.array([float({"bad.com": 0.5}.get(h, 1)) if h in hs else 0.0 for h in hosts])
    trust = np.linalg.solve(np.eye(len(hosts)) - 0.85 * step.T, seed("example.com"))
    blocked = seed("bad.com", "worse.com")
    distrust = np.linalg.solve(np.eye(len(hosts)) - 0.85 * step, blocked) - blocked
    for x in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), **bounds).collect():
        if x.host:
            assert x.host_trust == pytest.approx(trust[at[x.host]], abs=3e-4) and x.host_distrust == pytest.approx(distrust[at[x.host]], abs=3e-4)
            far = distrust[at[x.host]] > 0.25 and distrust[at[x.host]] > 2 * trust[at[x.host]]
            assert x.verdict == {"com/en/": "block", "example.com/en/7": "allow"}.get(x.rule, "block" if far else "allow")
        else:
            assert x.verdict == "allow" and x.host_trust == 0


@pytest.mark.parametrize("n", [1, 4, 50, 1000])
def test_url_distrust_does_not_fall_with_linkers(spark, n):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(i, f"http://h{i}.info/", link("bad.com")) for i in range(n)] + [(2000, "http://bad.com/en/x", ""), (2001, "http://far.info/", link("h0.info"))]
    rows += [(2002, "http://mixed.info/", link("bad.com", *[f"clean{i}.info" for i in range(9)])), (2003, "http://good.example.com/en/7", link("friend.info")), (2004, "http://friend.info/", link("bad.com"))]
    rows += [(3000 + i, f"http://clean{i}.info/", "") for i in range(9)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].verdict == "block" and got[i].host_distrust == pytest.approx(0.85) for i in range(n))
    assert got[2001].verdict == "block" and got[2001].host_distrust == pytest.approx(0.85**2)
    assert got[2002].verdict == "allow" and got[2002].host_distrust == pytest.approx(0.085)
    assert got[2004].verdict == "allow" and got[2004].host_trust == pytest.approx(0.85)
    assert all(got[3000 + i].verdict == "allow" for i in range(9))


def norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for r in ROWS:
        groups[norm(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    got = dedup.op6(docs).collect()
    want = Counter((r[0], min(groups[norm(r[1])])[3], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(k.encode()).hexdigest() for k in groups)
    assert dedup.dedup(docs).columns == docs.columns and dedup.dedup(docs).count() == len(groups)
    hot = dedup.groups(docs, hot_rows=2, broadcast_rows=0).drop("uid").collect()
    assert Counter(map(tuple, hot)) == Counter(map(tuple, got))


def test_columns_of_helper_names_stay(spark):
    names = ["_uid", "_words", "shard", "position", "uid", "n", "key", "words", "__uid"]
    rows = [(i, some(60), "en", "s", *[f"{c}{i}" for c in names]) for i in range(30)]
    rows += [(30 + i, *r[1:4], *[f"{c}{30 + i}" for c in names]) for i, r in enumerate(rows[:6])]
    frame = Scratch(spark).table(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names)))
    whole = lambda d: all(r[c] == f"{c}{r.doc_id}" for r in d.collect() for c in names)
    kept = dedup.dedup(frame)
    assert kept.columns == frame.columns and kept.count() == 30 and whole(kept)
    kept = quality.keep(frame)
    assert kept.columns == frame.columns and whole(kept)
    kept = jaccard.dedup(frame)
    assert kept.columns == frame.columns and kept.count() == 30 and whole(kept)
    mixed = mixing.in_shards(mixing.mixed_rows(frame, mixing.mix(frame)))
    assert mixed.columns[: len(frame.columns)] == frame.columns and whole(mixed)
    for op in (mixing.op1, langid.op2, bpe.op4, dedup.op6, katz.op7, jaccard.op8, tokencount.count, quality.op10):
        assert op(frame).count() == 36


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(dedup.F, "md5", lambda c: F.md5(F.substring(c, 1, 1)))
    rows = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "a b"), (4, "x")], "doc_id long, text string")
    real = F.sha2
    monkeypatch.setattr(dedup.F, "md5", lambda c: real(F.substring(c, 1, 1), 256))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in dedup.op6(Scratch(spark).table(rows)).collect()} == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}


def test_katz(docs):
    tok = lambda t: [*(t or "").encode().lower().split(), "END"]
    uni, pair = Counter(), Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for r in ROWS:
        last = "START"
        for w in tok(r[1]) if not held(r[0]) else ():
            uni[w] += 1
            pair[last, w] += 1
            last = w
    spread = lambda c: np.array([0] + [sum(min(v, 7) == r for v in c.values()) for r in range(1, 8)])
    n, v = sum(uni.values()), len(uni)
    model, d = katz.Unigrams(spread(uni), n), katz.discounts(spread(pair))
    p = lambda w: float(model(np.array([uni[w]]))[0])
    less = lambda c: d[c] * c if c <= katz.KATZ else c - katz.LOSS
    total, after = Counter(), defaultdict(list)
    for (h, w), c in pair.items():
        total[h] += c
        after[h].append(w)
    alpha = {h: (1 - sum(less(pair[h, w]) for w in ws) / total[h]) / (1 - sum(map(p, ws))) for h, ws in after.items()}
    h = max(total, key=total.get)
    assert sum(less(pair[h, w]) / total[h] if pair[h, w] else alpha[h] * p(w) for w in uni) + alpha[h] * model.rest == pytest.approx(1)
    want = []
    for r in ROWS:
        last, s, b, known = "START", 0.0, 0.0, 0
        for w in tok(r[1]):
            c = pair[last, w]
            s += math.log10(less(c) / total[last] if c else alpha.get(last, 1.0) * p(w))
            b += math.log10((uni[w] + 1) / (n + v + 1))
            known += uni[w] > 0
            last = w
        want.append((str(r[0]), held(r[0]), len(tok(r[1])), known, n, round(b, 6), round(s, 6)))
    got = katz.score(katz.fit(docs, block_bytes=3000, range_tokens=300)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)


@pytest.mark.parametrize("bound", [5, 60])
def test_katz_hot_histories(docs, bound):
    """Histories spread over ranges have the backoff weights of all their counts, also where each range has fewer than the bound."""
    tok = lambda t: [*(t or "").encode().lower().split(), "END"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    uni, pair = Counter(), Counter()
    for r in ROWS:
        t = tok(r[1]) if not held(r[0]) else []
        uni.update(t)
        pair.update(zip(["START", *t], t, strict=False))
    n_of = lambda c: np.array([0] + [sum(min(v, 7) == r for v in c.values()) for r in range(1, 8)])
    n = sum(uni.values())
    model, d = katz.Unigrams(n_of(uni), n), katz.discounts(n_of(pair))
    low = {w: float(model(np.array([c]))[0]) for w, c in uni.items()}
    less = lambda c: d[c] * c if c <= katz.KATZ else c - katz.LOSS
    after = defaultdict(dict)
    for (h, w), c in pair.items():
        after[h][w] = c
    total = {h: sum(x.values()) for h, x in after.items()}
    alpha = {h: (1 - sum(map(less, x.values())) / total[h]) / (1 - sum(low[w] for w in x)) for h, x in after.items()}

    def p(h, w):
        c = after.get(h, {}).get(w, 0)
        return less(c) / total[h] if c else alpha.get(h, 1.0) * low.get(w, model.rest)

    hot = [h for h in after if uni[h] > bound]
    assert len(hot) > 20 and all(sum(p(h, w) for w in uni) + p(h, None) == pytest.approx(1) for h in hot)
    fitted = katz.fit(docs, block_bytes=3000, range_tokens=300, hot=bound)
    assert fitted["ranges"] > 3
    want = sorted((str(r[0]), round(sum(math.log10(p(h, w)) for t in [tok(r[1])] for h, w in zip(["START", *t], t, strict=False)), 6)) for r in ROWS)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in katz.score(fitted).collect()) == want
    assert len(fitted["spread"]) == len(hot) + 1


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard(spark, monkeypatch, k, percent):
    def edit(w, n):
        w = list(w)
        for _ in range(rng.randrange(n + 1)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        return " ".join(w)

    texts = [None, "", "a", "A", "a b"] + [edit(base, max(1, size // 15)) for size in (4, 8, 12, 20, 40, 90, 200) for base in [some(size).split()] for _ in range(25)]
    passage = some(50)
    texts += [some(rng.randrange(2, 20)) + " " + passage for _ in range(40)]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    frame = Scratch(spark).table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(frame, k, percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}
    monkeypatch.setattr(jaccard, "SHARE", 1)
    hot = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(frame, k, percent, hot_rows=6).collect()}
    assert got == hot
    assert {r.doc_id for r in jaccard.dedup(frame, k, percent).collect()} == {i for i in range(len(texts)) if find(i) == i}


def test_quality_base(docs):
    want = []
    for r in ROWS:
        t = r[1] or ""
        w, at, lines = words(t), defaultdict(list), [x for x in t.split("\n") if words(x)]
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
        want.append((str(r[0]), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    got = quality.op10(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in got)


@pytest.mark.parametrize("wide", [quality.WIDE, 1])
def test_quality_verdicts_by_brute_force(spark, wide):
    """Histograms, references, distances and verdicts, from the docstring's words in plain Python."""
    r = random.Random(4)
    pools = {lang: [*quality.COMMON[lang].split(), *["".join(r.choices(letters, k=r.randrange(2, 9))) for _ in range(50)]] for lang, letters in (("en", "abcdefgh"), ("de", "ijklmnß"), ("fr", "opqrsé"))}
    make = lambda v, n: " ".join(r.choice(v).capitalize() if r.random() < 0.1 else r.choice(v) + r.choice(["", "", ".", ",", "#", "7", "~"]) for _ in range(n))
    rows = [(i, make(pools[lang], r.randrange(20, 400)), lang if i % 9 else None) for i, lang in enumerate(["en", "de", "fr"] * 30)]
    rows += [(200, "# | " * 300, "en"), (201, "ABC " * 100 + make(pools["en"], 200), "de"), (202, make(pools["fr"], 300), "de"), (203, make(pools["en"], 300), "xx"), (204, "", "en"), (205, None, "xx"), (206, "7 8 " * 400, None)]
    listed, classes = quality.common_words(), [set(quality.LOWER), *[set(x) for c, x in quality.CLASSES.items() if c != "blank"]]

    def hists(t):
        t, w = t or "", words(t)
        chars = [c for c in t if c not in quality.BLANKS]
        first = [sum(c in k for c in chars) for k in classes]
        found = [sum(x in (y, y.capitalize()) for x in w) for y in listed]
        return [*first, len(chars) - sum(first)], [*found, len(w) - sum(found)]

    def apart(p, q):
        p, q = ([x / sum(v) for x in v] for v in (p, q))
        part = lambda x, m: x * math.log2(x / m) if x else 0.0
        return math.sqrt(max(0.0, sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(p, q, strict=True)) / 2))

    sums = defaultdict(lambda: [np.zeros(len(classes) + 1), np.zeros(len(listed) + 1)])
    for _, t, lang in rows:
        if lang:
            for total, h in zip(sums[lang], hists(t), strict=True):
                total += h
    frame = Scratch(spark).table(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    got, rejected = {x.doc_id: x for x in quality.judge(frame, wide=wide).collect()}, 0
    for i, t, lang in rows:
        chars, common = hists(t)
        refs = [sums[lang]] if lang else list(sums.values())
        far = [min(apart(h, ref[k]) for ref in refs if ref[k].sum()) if sum(h) >= least else None for k, (h, least) in enumerate(((chars, 200), (common, 150)))]
        for told, want in zip((got[i].char_distance, got[i].word_distance), far, strict=True):
            assert (told is None) == (want is None) and (want is None or told == pytest.approx(want, abs=1e-9))
        bad = (far[0] or 0) > 0.335 or (far[1] or 0) > 0.26
        assert got[i].kept == (not got[i].base_failed and not bad)
        rejected += bad
    assert len(got) == len(rows) and rejected > 2


def test_quality_verdicts_follow_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op10(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.3


@pytest.mark.parametrize("wide", [quality.WIDE, 1])
def test_quality_keeps_clean_documents_of_rare_languages(spark, wide):
    """Two Russian documents among 2,500 are judged by their own reference, broadcast or joined by language."""
    r = random.Random(3)
    english = [x for x in quality.COMMON["en"].split()] + [f"{a}{b}ing" for a in "bcdfgl" for b in ("end", "old", "ark")]
    russian = "и в не на я быть он с что а по это она этот к но они мы весь который из у ты".split()
    make = lambda v: " ".join(f"{r.choice(v)}{r.randrange(10, 99) if r.random() < 0.02 else ''}" for _ in range(200))
    rows = [(i, make(english), "en") for i in range(2500)] + [(3000, make(russian), "ru"), (3001, make(russian), "ru"), (3002, make(russian), None), (3003, make(english), None), (3004, "@" * 900 + " a b" * 100, None)]
    frame = Scratch(spark).table(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    got = {x.doc_id: x for x in quality.judge(frame, wide=wide).collect()}
    assert len(got) == len(rows) and all(got[i].kept for i in range(2500))
    assert [got[i].kept for i in range(3000, 3005)] == [True, True, True, True, False]
    assert all(got[i].char_distance < 0.1 and got[i].word_distance < 0.1 for i in (3000, 3001, 3002))


def test_distance(spark):
    one = spark.range(1).select(quality.distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"), quality.distance(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("same")).first()
    assert one.far == pytest.approx(1) and one.same == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    d, s = "/root/testdata/sf0.001", Scratch(spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols, seen = docs.columns, [docs]
    for name, stage in cp.STAGES[:-1]:
        seen.append(s.table(stage(spark, seen[-1], d), name))
        assert seen[-1].columns == cols
    q, e, n, m = seen[1:]
    assert q.count() == quality.op10(docs).where("kept").count()
    assert e.count() == len({norm(r.text) for r in q.collect()})
    assert n.count() == jaccard.components(e, 5, 80).select("component_id").distinct().count()
    assert {r.doc_id for r in m.select("doc_id").collect()} <= {r.doc_id for r in n.select("doc_id").collect()}
    assert cp.STAGES[-1][1](spark, m, d).count() == m.count()
