"""Katz backoff bigram model: Good-Turing discounted counts, exactly normalised backoff weights.

P(w | h) = d(c) c / c(h) if the training text has h w c > 0 times, else alpha(h) P(w);
P(w) = d1(c) c / N for known words, and what the discounts leave goes to one unknown word.
alpha(h) = (1 - sum of seen P(w | h)) / (1 - sum of P(w) over words seen after h), so the
probabilities after any history sum to 1 over the vocabulary and the unknown word.
d(r) is Katz's discount from Good-Turing estimates for r <= 5 where these are in (0, 1], else
absolute discounting by n1 / (n1 + 2 n2). Above 5, where Good-Turing estimates take less than a
count off, bigrams lose half a count, so that every history leaves a mass to back off to.

The exchange. Texts are tokenised once into blocks of word hashes; a block asks each hash range
for its distinct words, then each history range for its distinct bigrams, and gets the counts in
the order it asked in. What is shuffled is compressed arrays of distinct n-grams per block, never
a row per token. The n-gram tables are written partitioned by kind: replies and model.

A history with more than ``hot`` occurrences is spread over ranges by its next word, and every range
gives its sums; there are at most 5,000 such histories, and only their added sums are gathered.

Texts: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+ and one end token each. A null or blank text is
its end token alone. Rows whose crc32 of doc_id falls into the held-out fold are only scored; a
null doc_id is in no fold. Repeated rows count and are scored each; with no training row every
token is unknown; an empty table stays empty; texts of any length are read whole, each within one
block; other columns are not carried, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.text import encoded, slices, words
from kinloom.plans.scratch import Scratch

END = np.uint64(0x5EED0E4D0E4D5EED)
START_ID = np.uint64((1 << 40) - 1)  # stands for the history of a text's first token
UNKNOWN_ID = np.uint64((1 << 40) - 2)
BLOCK_BYTES = 8 << 20
RANGE_TOKENS = 3_000_000
KATZ = 5
#: What a bigram seen more than KATZ times loses, in counts.
LOSS = 0.5


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; the bytes of a number's places lie together."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.dtype.itemsize)]], np.uint32)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + body)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    shape = np.frombuffer(raw, np.uint32, 2 * n, 4).reshape(-1, 2)
    at, out = 4 + 8 * n, []
    for size, item in shape.tolist():
        flat = np.frombuffer(raw, np.uint8, size * item, at).reshape(item, size).T
        out.append(np.ascontiguousarray(flat).reshape(-1).view(f"u{item}"))
        at += size * item
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Unsigned integers in the fewest bytes that hold them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def blocks(docs: DataFrame, fold: int, held: int, block_bytes: int) -> DataFrame:
    """Tokenised blocks: (block, ids, held, data) with data = (distinct hashes, their training
    counts, each token's place among them, tokens per text)."""

    def run(batches):
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        texts, ids, out, size = [], [], [], 0

        def flush():
            hashes, sizes = [], []
            for a in range(0, len(texts), 1024):
                h, at = words(texts[a : a + 1024])
                hashes.append(np.insert(h, at[1:], END))
                sizes.append(np.diff(at) + 1)
            h, sizes_ = np.concatenate(hashes), np.concatenate(sizes)
            keys, place = np.unique(h, return_inverse=True)
            learn = np.repeat(~np.array(out, bool), sizes_)
            count = np.bincount(place[learn], minlength=len(keys))
            return pack(keys, narrow(count), narrow(place), narrow(sizes_))

        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                part_ = batch.slice(a, b - a)
                new = encoded(part_.column(1))
                texts += new
                ids += part_.column(0).to_pylist()
                out += part_.column(2).to_pylist()
                size += sum(map(len, new))
                if size >= block_bytes:
                    yield _block_row(part, serial, ids, out, flush())
                    texts.clear(), ids.clear(), out.clear()
                    serial, size = serial + 1, 0
        if ids:
            yield _block_row(part, serial, ids, out, flush())

    is_held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), is_held.alias("held"))
    return rows.mapInArrow(run, "block long, ids array<long>, held array<boolean>, data binary")


def _block_row(part: int, serial: int, ids: list, out: list, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([(part << 24) + serial], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([out], pa.list_(pa.bool_())), pa.array([data], pa.binary())], ["block", "ids", "held", "data"])


def _by_range(of: np.ndarray, ranges: int):
    """(range, places of its members in order) for each range that has any."""
    order = np.argsort(of, kind="stable")
    edge = np.flatnonzero(np.diff(of[order])) + 1
    for places in np.split(order, edge) if len(order) else []:
        yield int(of[places[0]]), places


def word_replies(b: DataFrame, ranges: int) -> DataFrame:
    """(kind, block, part, data): for each block and hash range the words' (training count, id),
    and per range the totals of count-of-counts. An id is rank by count, times ranges, plus range."""

    def ask(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, count, *_ = unpack(data)
                found = [(p, pack(keys[at], narrow(count[at].astype(np.uint64)))) for p, at in _by_range((keys >> np.uint64(20)) % np.uint64(ranges), ranges)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array([p for p, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["block", "part", "data"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        asked = [unpack(x) for x in frame["data"]]
        keys, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([a[1] for a in asked]).astype(np.float64), len(keys)).astype(np.uint64)
        rank = np.empty(len(keys), np.uint64)
        rank[np.argsort(-count.astype(np.int64), kind="stable")] = np.arange(len(keys), dtype=np.uint64)
        ident = rank * np.uint64(ranges) + np.uint64(part)
        rows, at = [], 0
        for block, a in zip(frame["block"], asked, strict=True):
            on = inverse[at : at + len(a[0])]
            rows.append(("reply", block, part, pack(narrow(count[on]), narrow(ident[on]))))
            at += len(a[0])
        seen = count[count > 0]
        rows.append(("total", -1, part, pack(np.bincount(np.minimum(seen, KATZ + 2).astype(np.int64), minlength=KATZ + 3).astype(np.uint64), np.array([seen.sum()], np.uint64))))
        return pd.DataFrame(rows, columns=["kind", "block", "part", "data"])

    asked = b.select("block", "data").mapInArrow(ask, "block long, part long, data binary")
    return asked.groupBy("part").applyInPandas(answer, "kind string, block long, part long, data binary")


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..KATZ) from n[r], the number of n-grams seen r times (n[KATZ + 1] is exact too)."""
    n = n.astype(float)
    d = np.ones(KATZ + 1)
    if n[1]:
        common = (KATZ + 1) * n[KATZ + 1] / n[1]
        flat = n[1] / (n[1] + 2 * n[2])
        for r in range(1, KATZ + 1):
            good = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
            d[r] = (good - common) / (1 - common) if common < 1 else 0.0
            if not 0 < d[r] <= 1 or not n[r]:
                d[r] = (r - flat) / r if flat < 1 else 0.5
    return d


class Unigrams:
    """P(w) from counts: plain numbers that every task gets."""

    def __init__(self, n: np.ndarray, tokens: int):
        self.tokens, self.known = tokens, int(n[1:].sum())
        d = discounts(n)
        kept = sum(d[r] * r * n[r] for r in range(1, KATZ + 1)) if tokens else 0.0
        low = sum(r * n[r] for r in range(1, KATZ + 1)) if tokens else 0
        self.d, self.rest = d, (1.0 if not tokens else max((low - kept) / tokens, 0.0))
        if tokens and self.rest <= 0:  # nothing was seen rarely: half a token for the unknown
            self.rest = 0.5 / (tokens + 0.5)
            self.d = np.append(d, 1.0) * (1 - self.rest)
        else:
            self.d = np.append(d, 1.0)

    def __call__(self, count: np.ndarray) -> np.ndarray:
        """The unknown word's probability where count is 0."""
        c = count.astype(float)
        p = self.d[np.minimum(count, KATZ + 1).astype(int)] * c / max(1, self.tokens)
        return np.where(count > 0, p, self.rest)


def _state(data: bytes, replies: pd.DataFrame, ranges: int):
    """Of a block: count and id of each distinct word, tokens' places, texts' sizes."""
    keys, own, place, sizes = unpack(data)
    count, ident = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
    got = dict(zip(replies["part"], replies["data"], strict=True))
    for p, at in _by_range((keys >> np.uint64(20)) % np.uint64(ranges), ranges):
        c, i = unpack(got[p])
        count[at], ident[at] = c, i
    return count, ident, place, sizes.astype(np.int64)


def _bigrams(count: np.ndarray, ident: np.ndarray, place: np.ndarray, sizes: np.ndarray):
    """Distinct (history id, history count, word id, word count) of a block and each token's place among them. Words that training lacks are one unknown word."""
    w_count, w = count[place], np.where(count[place] > 0, ident[place], UNKNOWN_ID)
    first = np.cumsum(sizes) - sizes
    h, h_count = np.empty_like(w), np.empty_like(w_count)
    h[1:], h_count[1:] = w[:-1], w_count[:-1]
    h[first], h_count[first] = START_ID, 0
    order = np.lexsort((w, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
    at = order[new]
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    return h[at], h_count[at], w[at], w_count[at], index


def _range_of(h: np.ndarray, h_count: np.ndarray, w: np.ndarray, ranges: int, hot: int) -> np.ndarray:
    spread = np.where((h_count > hot) | (h == START_ID), w * np.uint64(2654435761) >> np.uint64(7), np.uint64(0))
    return (h + spread) % np.uint64(ranges)


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1))) if len(h) else np.zeros(0, np.int64)
    return h[start], np.diff(np.append(start, len(h)))


def _summed(answers: DataFrame) -> tuple[np.ndarray, int]:
    """The ranges' totals added up: n-grams by count, and tokens."""

    def run(frames):
        for frame in frames:
            for data in frame["data"]:
                n, tokens = unpack(bytes(data))
                yield pd.DataFrame([[*map(int, n), int(tokens[0])]], columns=names)

    names = [*[f"n{i}" for i in range(KATZ + 3)], "tokens"]
    rows = answers.where("kind = 'total'").select("data").mapInPandas(run, ", ".join(f"{c} long" for c in names))
    *n, tokens = (x or 0 for x in rows.agg(*[F.sum(c) for c in names]).first())
    return np.array(n, np.int64), tokens


def fit(docs: DataFrame, fold: int = 7, held: int = 2, block_bytes: int = BLOCK_BYTES, range_tokens: int = RANGE_TOKENS, scratch: Scratch | None = None, hot: int | None = None) -> dict:
    """Blocks, word replies and bigram replies of ``docs``, with the model's global numbers."""
    s = scratch or Scratch(docs.sparkSession)
    spark = docs.sparkSession
    b = s.table(blocks(docs, fold, held, block_bytes), "blocks")
    # the exchange's width follows the bytes of the blocks' texts, here by their number
    n_blocks = b.select("block").count()
    ranges = max(4, -(-n_blocks * block_bytes // (6 * range_tokens)))
    word = s.table(word_replies(b, ranges), "words")
    n, tokens = _summed(word)
    uni = Unigrams(n, tokens)
    hot = max(200_000, tokens // 5000) if hot is None else hot
    replies = word.where("kind = 'reply'").select("block", "part", "data")

    def ask(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        count, ident, place, sizes = _state(left["data"].iloc[0], right, ranges)
        h, h_count, w, w_count, index = _bigrams(count, ident, place, sizes)
        learn = np.repeat(~np.array(left["held"].iloc[0], bool), sizes)
        own = np.bincount(index[learn], minlength=len(h))
        rows = []
        for p, at in _by_range(_range_of(h, h_count, w, ranges, hot), ranges):
            heads, lengths = _runs(h[at])
            step = np.diff(w[at], prepend=np.uint64(0))
            first = np.cumsum(lengths) - lengths
            step[first] = w[at][first]
            apart = ((h_count[at][first] > hot) | (heads == START_ID)).astype(np.uint8)  # histories that _range_of spreads
            rows.append((int(key[0]), p, pack(narrow(heads), narrow(lengths), narrow(step), narrow(own[at]), narrow(w_count[at]), apart)))
        return pd.DataFrame(rows, columns=["block", "part", "data"])

    def read(data: bytes):
        heads, lengths, step, own, w_count, apart = unpack(data)
        lengths = lengths.astype(np.int64)
        w = np.cumsum(step.astype(np.uint64))  # restart each run at its own first word
        start = np.cumsum(lengths) - lengths
        w -= np.repeat(w[start] - step[start].astype(np.uint64), lengths)
        heads = heads.astype(np.uint64)
        return np.repeat(heads, lengths), w, own, w_count, heads[apart > 0]

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        asked = [read(x) for x in frame["data"]]
        h, w, own, w_count = (np.concatenate([a[i] for a in asked]).astype(np.uint64) for i in range(4))
        order = np.lexsort((w, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        at = order[new]
        count = np.bincount(index, own.astype(float), len(at)).astype(np.uint64)
        h, w, w_count = h[at], w[at], w_count[at]
        # sums of each history: seen bigrams by count, mass above the discounted counts, P(w) of seen words
        heads, lengths = _runs(h)
        of = np.repeat(np.arange(len(heads)), lengths)
        seen = count > 0
        sums = [np.bincount(of[seen & (count == r)], minlength=len(heads)).astype(float) for r in range(1, KATZ + 1)]
        sums.append(np.bincount(of, np.where(count > KATZ, count, 0).astype(float), len(heads)))
        sums.append(np.bincount(of, count > KATZ, len(heads)).astype(float))
        sums.append(np.bincount(of, np.where(seen, uni(w_count), 0.0), len(heads)))
        sums = np.stack(sums, 1)
        apart = np.isin(heads, np.concatenate([a[4] for a in asked]))
        rows, start = [], 0
        for block, a in zip(frame["block"], asked, strict=True):
            on = index[start : start + len(a[0])]
            start += len(a[0])
            c = count[on]
            # histories that this block must back off from, with their sums
            back = np.unique(of[on[c == 0]])
            rows.append(("reply", block, part, pack(narrow(c), narrow(heads[back])) + b"", sums[back].tobytes()))
        n = np.bincount(np.minimum(count[seen], KATZ + 2).astype(np.int64), minlength=KATZ + 3).astype(np.uint64)
        rows.append(("total", -1, part, pack(n, np.array([count.sum()], np.uint64)), b""))
        for i in np.flatnonzero(apart):
            rows.append(("history", int(heads[i]), part, b"", sums[i].tobytes()))
        return pd.DataFrame(rows, columns=["kind", "block", "part", "data", "sums"])

    asked = b.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(ask, "block long, part long, data binary")
    path = s.path("bigrams")
    answered = asked.groupBy("part").applyInPandas(answer, "kind string, block long, part long, data binary, sums binary")
    answered.write.partitionBy("kind").parquet(path)
    pair = spark.read.schema("block long, part long, data binary, sums binary, kind string").parquet(path)
    n2, _ = _summed(pair)

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum([np.frombuffer(x, float) for x in frame["sums"]], axis=0)
        return pd.DataFrame({"block": frame["block"].iloc[:1], "sums": [whole.tobytes()]})

    # histories spread over ranges, each range's sums added: at most 5,000, since each has a 5,000th of the tokens
    apart = pair.where("kind = 'history'").select("block", "sums").groupBy("block").applyInPandas(add, "block long, sums binary")
    spread = {r[0]: np.frombuffer(bytes(r[1]), float) for r in apart.toLocalIterator()}
    return {"blocks": b, "words": replies, "pairs": pair, "unigrams": uni, "d": discounts(n2), "spread": spread, "ranges": ranges, "hot": hot, "tokens": tokens, "path": path}


def score(model: dict) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text."""
    uni, d, spread, ranges, hot, tokens = (model[k] for k in ("unigrams", "d", "spread", "ranges", "hot", "tokens"))
    weights = d[1 : KATZ + 1] * np.arange(1, KATZ + 1)

    def alpha(sums: np.ndarray, h_count: np.ndarray) -> np.ndarray:
        seen = (sums[:, :KATZ] @ weights + sums[:, KATZ] - LOSS * sums[:, KATZ + 1]) / np.maximum(h_count, 1)
        return np.where(h_count > 0, np.maximum(1 - seen, 1e-12) / np.maximum(1 - sums[:, KATZ + 2], 1e-12), 1.0)

    def evaluate(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        word = right[right["kind"] == "word"]
        pair = right[right["kind"] == "pair"]
        if not len(left):
            return pd.DataFrame(columns=names)
        count, ident, place, sizes = _state(left["data"].iloc[0], word, ranges)
        h, h_count, w, w_count, index = _bigrams(count, ident, place, sizes)
        prob = np.zeros(len(h))
        got = {p: (x, y) for p, x, y in zip(pair["part"], pair["data"], pair["sums"], strict=True)}
        lower = uni(w_count)
        for p, at in _by_range(_range_of(h, h_count, w, ranges, hot), ranges):
            c, back = unpack(got[p][0])
            sums = np.frombuffer(got[p][1], float).reshape(-1, KATZ + 3)
            if len(back):
                back = back.astype(np.uint64)
                for i in [i for i, x in enumerate(back.tolist()) if x in spread]:
                    sums = sums.copy() if not sums.flags.writeable else sums
                    sums[i] = spread[int(back[i])]
            c = c.astype(np.int64)
            # a history's count: how often training goes on after it
            n_h = np.where(h[at] == START_ID, starts, h_count[at]).astype(float)
            seen = np.where(c > KATZ, c - LOSS, d[np.minimum(c, KATZ)] * c) / np.maximum(n_h, 1)
            miss = c == 0
            if miss.any():
                k = np.searchsorted(back, h[at][miss])
                seen[miss] = alpha(sums[k], n_h[miss]) * lower[at][miss]
            prob[at] = seen
        log = np.log10(np.maximum(prob, 1e-300))[index]
        c = count[place].astype(np.int64)
        base = np.log10((c + 1) / (tokens + (uni.known + 1)))
        first = np.cumsum(sizes) - sizes
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if x is None or x != x else int(x) for x in left["ids"].iloc[0]], "Int64"),
                "held_out": np.array(left["held"].iloc[0], bool),
                "n_tokens": sizes,
                "n_known": np.add.reduceat((c > 0).astype(np.int64), first),
                "train_tokens": tokens,
                "base_score": np.add.reduceat(base, first),
                "score": np.add.reduceat(log, first),
            }
        )

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    start_sums = spread.get(int(START_ID))
    starts = float(start_sums[:KATZ] @ np.arange(1, KATZ + 1) + start_sums[KATZ]) if start_sums is not None else 0.0
    replies = model["words"].withColumn("kind", F.lit("word")).withColumn("sums", F.lit(None).cast("binary"))
    replies = replies.unionByName(model["pairs"].where("kind = 'reply'").withColumn("kind", F.lit("pair")))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return model["blocks"].groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(evaluate, schema)


def op7(docs: DataFrame) -> DataFrame:
    return score(fit(docs))
