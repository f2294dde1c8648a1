"""Hierarchical language identification: a linear family classifier, then one-versus-one linear
support vector machines between the languages of a family.

Features are hashed character 1- to 3-grams of the lower-cased text, with every run of non-letters
as one blank, in relative frequencies under a square root and scaled to length one. A text is read
whole, in passes of bounded size, and its n-grams are summed by dimension.

Training takes at most ``sample`` labelled rows (a documented bound), the same number of each
language as far as they go, chosen by a hash of the row's text. Only text and lang of rows outside
the held-out fold are read. Prediction reads the text alone.

Results: a null text or one without a letter gives ``und`` with score 0. If no row can be learned
from, every text gives ``und``; with one language all lettered texts get it, with score 1. Ties
go to the language that comes first by code point. Repeated rows repeat; empty tables stay empty;
a null doc_id is in no held-out fold; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinloom.llm.text import mix, slices
from kinloom.plans.scratch import Scratch

DIMENSIONS = 1 << 13
#: Code points of one numpy pass.
PASS = 1 << 20
#: Families of common languages; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ast ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
_letters: list[np.ndarray] = []


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), f"={code}")


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _passes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(dimension of each n-gram, number of its text) of consecutive stretches of the texts."""
    letter = _is_letter()
    code = np.frombuffer("\n".join([*texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if sum(map(len, texts)) + len(texts) != len(code):  # lower() can change a text's length
        texts = [t.lower() for t in texts]
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    for a in range(0, len(code), PASS):
        lead = 2 if a else 0
        part = code[a - lead : a + PASS].astype(np.uint64)
        doc = np.searchsorted(ends, np.arange(a - lead, a - lead + len(part)), side="right")
        part[~letter[part]] = 32
        keep = np.ones(len(part), bool)
        keep[1:] = (part[1:] != 32) | (part[:-1] != 32) | (doc[1:] != doc[:-1])
        fresh = np.arange(len(part)) >= lead
        part, doc, fresh = part[keep], doc[keep], fresh[keep]
        one = part * np.uint64(0x9E3779B97F4A7C15)
        two = mix(one[:-1] * np.uint64(3) + part[1:])
        three = mix(two[:-1] * np.uint64(5) + part[2:])
        mask = np.uint64(DIMENSIONS - 1)
        yield (mix(one[fresh]) & mask).astype(np.int64), doc[fresh]
        ok = fresh[1:] & (doc[1:] == doc[:-1])
        yield (two[ok] & mask).astype(np.int64), doc[1:][ok]
        ok = fresh[2:] & (doc[2:] == doc[:-2])
        yield (three[ok] & mask).astype(np.int64), doc[2:][ok]


def vectors(texts: list[str]) -> np.ndarray:
    """One row of features per text."""
    out = np.zeros(len(texts) * DIMENSIONS)
    for dim, doc in _passes(texts):
        if len(dim):
            out += np.bincount(doc * DIMENSIONS + dim, minlength=len(out)) if len(texts) <= 64 else 0
            if len(texts) > 64:
                np.add.at(out, doc * DIMENSIONS + dim, 1)
    out = np.sqrt(out.reshape(len(texts), DIMENSIONS))
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.maximum(norm, 1e-12)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = 60, c: float = 100.0) -> tuple[np.ndarray, float, float]:
    """Linear squared-hinge machine for y in {-1, 1} by accelerated gradient steps; returns
    weights, bias and the slope that turns margins into probabilities."""
    n = len(y)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * c
    w, b, pw, pb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    rate = 1.0 / (1.0 + 4.0 * c)
    for k in range(steps * 5):
        m = k / (k + 3.0)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        loss = weight * np.maximum(0.0, 1.0 - y * (x @ vw + vb)) * y
        pw, pb = w, b
        w, b = vw - rate * (vw - 2 * (loss @ x)), vb + rate * 2 * float(loss.sum())
    return w, float(b), 3.0 if n else 0.0


def train(rows: list[tuple[np.ndarray, str]]) -> dict:
    """The two levels: machines between families, and within each family between languages."""
    langs = sorted({lang for _, lang in rows})
    x = np.stack([v for v, _ in rows]) if rows else np.zeros((0, DIMENSIONS), np.float32)
    lang = np.array([lang for _, lang in rows])
    family = np.array([family_of(i) for i in lang])

    def pairs(groups: np.ndarray, names: list[str]) -> list:
        out = []
        for i, p in enumerate(names):
            for q in names[i + 1 :]:
                on = (groups == p) | (groups == q)
                out.append((p, q, *fit_svm(x[on], np.where(groups[on] == p, 1, -1).astype(np.float32))))
        return out

    families = sorted({family_of(i) for i in langs})
    members = {f: [i for i in langs if family_of(i) == f] for f in families}
    return {"langs": langs, "families": families, "members": members, "top": pairs(family, families), "in": {f: pairs(lang, m) for f, m in members.items()}}


def _vote(machines: list, names: list[str], margin: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Winner by number of won comparisons, then by summed probability; its mean probability."""
    if len(names) == 1:
        n = margin.shape[0]
        return np.zeros(n, int), np.ones(n)
    won, sure = (np.zeros((margin.shape[0], len(names))) for _ in range(2))
    for i, (p, q, *_, slope) in enumerate(machines):
        prob = 1 / (1 + np.exp(-np.clip(slope * margin[:, first + i], -30, 30)))
        a, b = names.index(p), names.index(q)
        won[:, a] += prob >= 0.5
        won[:, b] += prob < 0.5
        sure[:, a] += prob
        sure[:, b] += 1 - prob
    sure /= len(names) - 1
    best = np.argmax(won + sure / 2, axis=1)
    return best, sure[np.arange(len(best)), best]


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    letter_free = [not t or not any(map(str.isalpha, t)) for t in texts]
    if not model["langs"]:
        return ["und"] * len(texts), [0.0] * len(texts)
    machines = [*model["top"], *[m for f in model["families"] for m in model["in"][f]]]
    table = np.stack([m[2] for m in machines], 1) if machines else np.zeros((DIMENSIONS, 0), np.float32)
    bias = np.array([m[3] for m in machines])
    margin = np.empty((len(texts), len(machines)))
    for a in range(0, len(texts), 64):  # features of a few texts at a time
        margin[a : a + 64] = vectors([t or "" for t in texts[a : a + 64]]) @ table + bias
    top, sure = _vote(model["top"], model["families"], margin, 0)
    langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
    first = len(model["top"])
    for i, f in enumerate(model["families"]):
        on = np.flatnonzero(top == i)
        best, inner = _vote(model["in"][f], model["members"][f], margin[on], first)
        for j, b, v in zip(on, best, inner * sure[on], strict=True):
            langs[j], scores[j] = model["members"][f][b], v
        first += len(model["in"][f])
    langs[letter_free], scores[letter_free] = "und", 0.0
    return langs.tolist(), scores.tolist()


def training_rows(docs: DataFrame, sample: int, s: Scratch) -> DataFrame:
    """At most ``sample`` rows (text, lang): of each language those with the least hashes.

    A text that a language repeats counts once. The hash threshold of a language follows from its row count, so no task ranks more than
    about twice the rows it keeps.
    """
    known = docs.where("not held_out and lang is not null and text is not null")
    known = known.select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    sizes = s.table(known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")), "languages")
    langs = sizes.count()
    each = max(1, sample // max(1, langs))
    edge = F.when(F.col("n") <= 3 * each, F.lit(2.0)).otherwise(2.0 * each / F.col("n") + 3.0 / F.sqrt(F.col("n") * each))
    chosen = sizes.orderBy(F.desc("n"), "lang").limit(sample).select("lang", edge.alias("edge"))
    unit = (F.shiftrightunsigned("h", 11)) / float(1 << 53)
    near = known.join(F.broadcast(chosen), "lang").where(unit < F.col("edge")).dropDuplicates(["h", "text", "lang"])
    ranked = near.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    return ranked.where(F.col("at") <= each).select("text", "lang")


def identify(docs: DataFrame, sample: int = 800, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    s = scratch or Scratch(docs.sparkSession)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    d = docs.select("doc_id", fold.alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def features(batches):
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 20):
                for c in range(a, b, 64):
                    part = batch.slice(c, min(b, c + 64) - c)
                    v = vectors(part.column(0).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float16).tobytes() for x in v], pa.binary()), part.column(1)], ["v", "lang"])

    got = training_rows(d, sample, s).mapInArrow(features, "v binary, lang string").collect()
    rows = sorted(((np.frombuffer(r["v"], np.float16).astype(np.float32), r["lang"]) for r in got), key=lambda r: (r[1], r[0].tobytes()))
    model = docs.sparkSession.sparkContext.broadcast(train(rows))

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 20):
                langs, scores = predict(model.value, batch.column(2).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return d.selectExpr("cast(doc_id as long) doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2(docs: DataFrame) -> DataFrame:
    return identify(docs)
