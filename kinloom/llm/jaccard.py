"""N-gram Jaccard join by vertical partitioning, and the components of its links.

The global order of shingles is that of their 64-bit hashes. It is cut into fragments, as many as
a document's size level asks for; a document's shingles in one fragment are a segment.

* Texts with equal shingle sets are one class from the start; only classes go on.
* Candidates. Two sets of Jaccard similarity t or more differ in at most d = s (1 - t) / t
  shingles, s being either's size, so of a document's n non-empty segments at least n - d are
  equal in its partner. Every segment is a key. Of these a document may skip the n - d - 1 that
  most documents share: the rarest common segment is then still kept by both. So frequent lines
  and passages, which only fill some segments, don't bring documents together. Documents so short
  that n <= d (few) also give the classic prefix of their rarest-hash shingles as keys, which
  finds pairs of two such documents.
* Overlaps of a pair are counted in each of a few coarse fragments by itself and summed.
* Not all pairs of a group are looked at. First each document meets the one of its keys' least
  members with which it shares most keys. Then, as long as a key holds documents of different
  components, some of them, from the smallest components, meet all others of the key and leave it.
  When no key is open, every pair of different components has been refuted. In a key of more than
  ``CENTRES`` documents they meet as parity sketches, blocks of members against blocks of centres:
  bit i says whether an odd number of shingles hash to i, so two sets differ in at least as many
  shingles as their sketches differ in bits. Only pairs that this can't refute become rows, and
  as long as that finds links, only each document's nearest centre of another component does.

Shingles of 64-bit hashes: two of a corpus' pair of documents collide with a chance below 1e-12.
A document's size levels grow by half; a document near a level's edge has keys in both levels.

Nulls: null and blank texts have an empty set, link with nothing and are their own component. A
null doc_id is carried, and names a component only if it has no other. Rows with equal sets link,
so repeated rows do. An empty table stays empty; other columns are not carried. ``docs`` must be a
file scan or materialised table, which numbers its rows alike in both passes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinloom.llm.text import encoded, mix, release_caches, shingles, slices, words
from kinloom.operators.components import connected_components
from kinloom.plans.scratch import HOT_ROWS, Scratch, left_join_hot, small, without

CENTRES = 16
#: Centres and members of one block of a larger key.
BLOCK_CENTRES, BLOCK_MEMBERS = 512, 4096
#: Coarse fragments in which a pair's overlap is counted.
PARTS = 4
GROWTH = 1.5
#: Of so many rows one is looked at to foresee which keys are hot.
SHARE = 64


class Levels:
    """Size levels, the number of fragments of each, and the bounds that follow from a
    similarity of ``percent`` / 100."""

    def __init__(self, percent: int):
        if not 67 <= percent <= 100:
            raise ValueError("percent must be from 67 to 100: a partner's level is next door at most")
        self.percent = percent
        share = 1.12 * (100 - percent) / percent  # of a document's size, the segments it needs
        mean = 1.0  # shingles in a segment of the largest documents of a level
        while share and mean < 12 and (1 - math.exp(-mean - 0.1)) / (mean + 0.1) > share:
            mean += 0.1
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * GROWTH)))
        self.fragments = [max(1, round(e / mean)) for e in self.edges[1:]]

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def differ(self, size: int) -> int:
        return size * (100 - self.percent) // self.percent

    def keys(self, tokens: np.ndarray) -> tuple[list[np.ndarray], list[int], np.ndarray]:
        """(keys of the own and the next level, how many each may skip, prefix keys)."""
        size, nothing = len(tokens), np.zeros(0, np.int64)
        d = self.differ(size)
        if not d:
            return [nothing, nothing], [0, 0], nothing
        out, skip, short = [], [], False
        spread = mix(tokens + np.uint64(0xABCD))
        for level in range(self.of(size), self.of(100 * size // self.percent) + 1):
            n = np.uint64(self.fragments[level])
            at = ((tokens >> np.uint64(32)) * n) >> np.uint64(32)
            first = np.flatnonzero(np.diff(at, prepend=at[:1] + np.uint64(1)))
            key = mix(np.add.reduceat(spread, first) ^ mix(at[first] * np.uint64(64) + np.uint64(level)))
            out.append(key.view(np.int64))
            skip.append(max(0, len(first) - d - 1))
            short |= len(first) <= d
        prefix = mix(tokens[: size - -(-self.percent * size // 100) + 1] ^ np.uint64(0x7E57)).view(np.int64) if short else nothing
        return out + [nothing] * (2 - len(out)), skip + [0] * (2 - len(skip)), prefix


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def parity(tokens: np.ndarray) -> bytes:
    """The parity sketch: of two to four bits per shingle, a power of two within 2^8 and 2^16."""
    bits = 1 << min(16, max(8, (2 * len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def unrefuted(members: pd.DataFrame, centres: pd.DataFrame, percent: int, nearest: bool) -> pd.DataFrame:
    """(a, b), a > b: members and centres of other labels whose sizes and sketches allow a link,
    all of them or each member's nearest.
    The longer sketch is folded, which xors bits whose index agrees in its low places."""
    out = [np.zeros((0, 2), np.int64)]
    if not len(members) or not len(centres):
        return pd.DataFrame(out[0], columns=["a", "b"])
    sketches = [np.frombuffer(x, np.uint64) for x in members["bits"]]
    width = np.array([len(x) for x in sketches])
    folded: dict[tuple[int, int], np.ndarray] = {}
    cid, n, label = (members[c].to_numpy() for c in ("cid", "n", "label"))
    least_apart, partner = np.full(len(members), 2.0), np.full(len(members), -1)
    for one in centres.itertuples(index=False):
        mine = np.frombuffer(one.bits, np.uint64)
        fits = (label != one.label) & (100 * np.minimum(n, one.n) >= percent * np.maximum(n, one.n))
        for w in np.unique(width[fits]):
            on = np.flatnonzero(fits & (width == w))
            least = min(int(w), len(mine))
            if (w, least) not in folded:
                group = np.flatnonzero(width == w)
                stack = np.stack([sketches[i] for i in group]).reshape(len(group), -1, least)
                place = np.full(len(members), -1)
                place[group] = np.arange(len(group))
                folded[w, least] = (np.bitwise_xor.reduce(stack, 1), place)
            stack, place = folded[w, least]
            other = np.bitwise_xor.reduce(mine.reshape(-1, least), 0)
            apart = np.bitwise_count(stack[place[on]] ^ other).sum(1, dtype=np.int64)
            share = apart / (n[on] + one.n)
            ok = apart * (100 + percent) <= (n[on] + one.n) * (100 - percent)
            near = on[ok]
            if nearest:
                nearer = ok & (share < least_apart[on])
                least_apart[on[nearer]], partner[on[nearer]] = share[nearer], one.cid
                continue
            out.append(np.stack([np.maximum(cid[near], one.cid), np.minimum(cid[near], one.cid)], 1))
    if nearest:
        met = partner >= 0
        out.append(np.stack([np.maximum(cid[met], partner[met]), np.minimum(cid[met], partner[met])], 1))
    return pd.DataFrame(np.concatenate(out), columns=["a", "b"]).drop_duplicates()


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(uid, doc_id, n, h1, h2, keys0, skip0, keys1, skip1, prefix, bits) of every row."""
    names = ["uid", "doc_id", "n", "h1", "h2", "keys0", "skip0", "keys1", "skip1", "prefix", "bits"]

    def run(batches):
        import xxhash

        release_caches()
        levels = Levels(percent)
        for batch in batches:
            for a, b in slices(batch.column(2)):
                n, h1, h2, keys, skips, prefix, bits = [], [], [], ([], []), ([], []), [], []
                for tokens in shingles(*words(encoded(batch.column(2).slice(a, b - a))), k):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)
                    found, skip, short = levels.keys(tokens)
                    n.append(len(tokens))
                    h1.append(digest[0])
                    h2.append(digest[1])
                    prefix.append(short)
                    bits.append(parity(tokens))
                    for i in range(2):
                        keys[i].append(found[i])
                        skips[i].append(skip[i])
                lists = lambda x: pa.array(x, pa.list_(pa.int64()))
                longs = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), longs(n), longs(h1), longs(h2), lists(keys[0]), longs(skips[0]), lists(keys[1]), longs(skips[1]), lists(prefix), pa.array(bits, pa.binary())], names)

    types = ["array<long>" if c in ("keys0", "keys1", "prefix") else "binary" if c == "bits" else "long" for c in names]
    return _numbered(docs).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(names, types, strict=True)))


def segments(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, part, tokens): the shingles of the wanted rows by coarse fragment."""

    def run(batches):
        release_caches()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                cid, part, found = [], [], []
                ids = batch.column(0).slice(a, b - a).to_pylist()
                for i, tokens in zip(ids, shingles(*words(encoded(batch.column(1).slice(a, b - a))), k), strict=True):
                    edge = np.searchsorted(tokens, np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS))
                    for p, t in enumerate(np.split(tokens.view(np.int64), edge)):
                        if len(t):
                            cid.append(i)
                            part.append(p)
                            found.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(part, pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["cid", "part", "tokens"])

    rows = _numbered(docs).drop("doc_id").withColumnRenamed("uid", "cid").join(wanted, "cid", "left_semi")
    return rows.mapInArrow(run, "cid long, part int, tokens array<long>")


def overlaps(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """Adds ``both`` to (a, b, ...): the shingles that both sets have, counted per fragment."""
    left = pairs.join(segs.withColumnRenamed("cid", "a").withColumnRenamed("tokens", "ta"), "a")
    met = left.join(segs.withColumnRenamed("cid", "b").withColumnRenamed("tokens", "tb"), ["b", "part"])
    counted = met.select(*pairs.columns, F.size(F.array_intersect("ta", "tb")).alias("both"))
    return counted.groupBy(*pairs.columns).agg(F.sum("both").alias("both"))


def hot_keys(full: DataFrame, rows: int, hot_rows: int, s: Scratch) -> DataFrame:
    """Keys (key) that seem to have at least max(hot_rows, rows / 10,000) rows, by one row in SHARE. They are at most
    20,000 times the keys of a row. They only choose the form of a join, whose result is the same for any choice."""
    some = full.where(F.pmod(F.xxhash64("uid"), F.lit(SHARE)) == 0).select(F.explode(F.concat("keys0", "keys1", "prefix")).alias("key"))
    seen = some.groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
    return s.table(seen.where(F.col("seen") * SHARE * 2 >= max(hot_rows, rows // 10_000)).select("key"), "hot")


def with_docs(mine: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds ``docs``, the rows of its key, to (owner, key), for keys of several rows.

    Rows of hot keys are counted within their tasks and get the count by broadcast. For the others one
    exchange serves the count and the join: counting owners keeps their column in both."""
    cold = mine.join(F.broadcast(hot), "key", "left_anti").repartition("key")
    shared = cold.groupBy("key").agg(F.count("owner").alias("docs")).where("docs > 1")
    out = cold.join(shared, "key")
    if hot.isEmpty():
        return out
    warm = mine.join(F.broadcast(hot), "key", "left_semi")
    counted = warm.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    return out.unionByName(warm.join(F.broadcast(counted), "key"))


def components(docs: DataFrame, k: int = 3, percent: int = 90, hot_rows: int = HOT_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """(uid, doc_id, n_shingles, component_id) of every row of ``docs``.

    A null text or one without words has no shingles and is linked with nothing: its component is its own
    doc_id. Null doc_ids come last among a component's, so a component of null ones only has a null component_id; repeated
    rows and equal texts are one class. Very long texts are read whole, in passes. An empty table stays empty; other
    columns are ignored, whatever their names. ``hot_rows`` only chooses the form of a join."""
    s = scratch or Scratch(docs.sparkSession)
    full = s.table(sketches(docs, k, percent), "sketches")
    rows = s.table(full.drop("keys0", "keys1", "prefix"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    classes = rows.where("n > 0").groupBy("h1", "h2", "n").agg(F.count(F.lit(1)).alias("size"), first)
    classes = s.table(classes.select("h1", "h2", "n", "size", F.col("first.uid").alias("cid"), F.col("first.doc_id").alias("name")), "classes")

    # Keys of classes, those that two or more share, and of these each class' rarest. All of these
    # tables are as large as the corpus at any size, so their joins always shuffle. A key's owner
    # is cid and level in one number.
    ids = classes.select(F.col("cid").alias("uid"))
    at_level = lambda level, keys: F.transform(keys, lambda x: F.struct((F.col("uid") * 4 + level).alias("owner"), x.alias("key")))
    mine = full.join(ids, "uid", "left_semi").select(F.inline(F.concat(at_level(0, "keys0"), at_level(1, "keys1"), at_level(2, "prefix"))))
    common = s.table(with_docs(mine, hot_keys(full, rows.count(), hot_rows, s)), "common")
    s.drop(full)
    s.release()
    skips = rows.select(F.col("uid").alias("cid"), "n", "bits", F.array("skip0", "skip1", F.lit(0).cast("long")).alias("skips"))
    cid = F.shiftright("owner", 2)
    sizes = s.table(skips.join(common.select(cid.alias("cid")).distinct(), "cid"), "sizes")
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("docs"), "key"))
    kept = common.withColumn("place", place).withColumn("cid", cid).join(sizes.select("cid", "skips"), "cid")
    kept = kept.where(F.col("place") > F.get("skips", F.col("owner").bitwiseAND(3).cast("int")))
    members = s.table(kept.select("key", "cid"), "members")
    s.drop(common)
    # a key that only one document kept brings nobody together
    met = members.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1").select("key")
    members = s.table(members.join(met, "key", "left_semi"), "members")

    size_of = small(sizes.select("cid", "n"))

    def sized(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the similarity."""
        p = pairs
        for c in ("a", "b"):
            p = p.join(size_of.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}")), c)
        return p.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "na", "nb")

    segs = s.table(segments(docs, small(s.table(members.select("cid").distinct(), "wanted")), k), "segments")
    verdict = F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))

    def verified(pairs: DataFrame) -> DataFrame:
        out = overlaps(sized(pairs), segs)
        return s.table(out.select("a", "b", verdict.alias("linked")), "verified")

    def block_pairs(now_open: DataFrame, centres: DataFrame, nearest: bool) -> DataFrame:
        """Pairs of the larger keys that sketches don't refute."""
        blocks = F.ceil(F.col("docs") / BLOCK_MEMBERS)
        with_bits = sizes.select("cid", "n", "bits")
        left = now_open.where(F.col("docs") > CENTRES).withColumn("block", F.pmod(F.xxhash64("cid"), blocks))
        right = centres.where(F.col("docs") > CENTRES).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        cols = ["key", "block", "cid", "n", "label", "bits"]
        left, right = (x.join(with_bits, "cid").select(*[F.col(c).alias(c) for c in cols]).groupBy("key", "block") for x in (left, right))
        return left.cogroup(right).applyInPandas(lambda m, c: unrefuted(m, c, percent, nearest), "a long, b long")

    least = members.groupBy("key").agg(F.min("cid").alias("b"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
    met = members.join(least, "key").where("cid <> b").groupBy(F.col("cid").alias("a"), "b").agg(F.count(F.lit(1)).alias("common"))
    best = met.groupBy("a").agg(F.max_by("b", F.struct("common", -F.col("b"))).alias("b"))
    seen = verified(best)
    label = connected_components(seen.where("linked"), scratch=s)
    greedy = True
    while True:
        now = members.join(small(label.withColumnRenamed("node", "cid")), "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label"))
        now = s.table(now, "labelled")
        unsettled = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("docs")).where("low <> high").select("key", "docs")
        now_open = s.table(now.join(small(s.table(unsettled, "unsettled")), "key"), "open")
        s.drop(now)
        if now_open.isEmpty():
            break
        weight = now_open.groupBy("key", "label").agg(F.count(F.lit(1)).alias("weight"))
        ranked = now_open.join(weight, ["key", "label"]).withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("weight", "cid")))
        most = F.when(F.col("docs") > CENTRES, BLOCK_CENTRES).otherwise(CENTRES)
        centres = s.table(ranked.where(F.col("place") <= BLOCK_CENTRES).where(F.col("place") <= most).select("key", "cid", "label", "docs"), "centres")
        greedy = greedy and not now_open.where(F.col("docs") > CENTRES).isEmpty()
        pairs = block_pairs(now_open, centres, greedy)
        if not greedy:
            c = centres.where(F.col("docs") <= CENTRES).select("key", F.col("cid").alias("b"), F.col("label").alias("other"))
            few = now_open.where(F.col("docs") <= CENTRES).join(c, "key").where("label <> other")
            pairs = pairs.union(few.select(F.greatest("cid", "b").alias("a"), F.least("cid", "b").alias("b")))
        fresh = verified(pairs.distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti"))
        if not greedy:
            members = s.table(now_open.select("key", "cid").join(centres.select("key", "cid"), ["key", "cid"], "left_anti"), "members")
        seen = s.table(seen.unionByName(fresh), "verified")
        links = fresh.where("linked").select("a", "b")
        greedy = greedy and not links.isEmpty()
        label = connected_components(links.union(label.select("node", "label")), scratch=s)
        s.drop(now_open)

    joined = classes.join(small(label.withColumnRenamed("node", "cid")), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    names = s.table(joined.groupBy("label").agg(F.min("name").alias("component_id")), "names")
    named = joined.join(small(names), "label").select("h1", "h2", "n", "size", "component_id")
    out = left_join_hot(rows.select("uid", "doc_id", "n", "h1", "h2"), s.table(named, "named"), ["h1", "h2", "n"], "size", rows.count())
    return out.select("uid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row of least doc_id, with all columns."""
    s = scratch or Scratch(docs.sparkSession)
    found = s.table(components(docs, k, percent, scratch=s).where("n_shingles > 0"), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    group = F.struct(F.col("component_id").isNull().alias("none"), F.coalesce("component_id", "uid").alias("id"))
    keep = found.groupBy(group.alias("g")).agg(first).select(F.col("first.uid").alias("uid"))
    gone = s.table(found.select("uid").join(keep, "uid", "left_anti"), "dropped")
    return without(docs, gone)


def op8(docs: DataFrame) -> DataFrame:
    return components(docs).drop("uid")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS t FROM s),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n_shingles, q.n_shingles
  HAVING 100 * count(*) >= 90 * (p.n_shingles + q.n_shingles - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM n
  UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT n.doc_id, n_shingles, min(y) AS component_id FROM n JOIN reach ON reach.x = n.doc_id GROUP BY n.doc_id, n_shingles
"""
