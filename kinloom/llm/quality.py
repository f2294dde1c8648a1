"""Quality rules by distribution divergence, in built-in expressions only.

Each document gives two histograms: of its characters by class and of its words by common word.
They are compared with the references of languages - the same histograms summed over all documents
of a language - by Jensen-Shannon distance (base 2, square root, 0 to 1). A document is rejected
if it is far from its language's reference, or from every reference where it has none of its own.
Histograms below a minimum length say nothing and reject nothing.

References are sums over all documents, and every language has one. Those of the 1,000 languages
with most documents are broadcast; documents of the others, each with less than a thousandth of
all documents, are joined with their reference by language.

Nulls: a null text has no words and fails the base rules; a null lang has no reference of its own;
a null doc_id is carried. Texts are read whole: a very long one is one row's work. Rows are judged one by one,
so repeated rows repeat, and ties can't arise; an empty table stays empty; other columns of the input are not
carried by ``judge`` and are kept by ``keep``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.plans.scratch import Scratch, without

#: Languages whose references are broadcast.
WIDE = 1000

BLANKS = " \t\n\x0b\x0c\r"
#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Classes of what is left once a-z is gone; what no class takes is "other".
CLASSES = {"blank": BLANKS, "symbol": SYMBOLS, "upper": LOWER.upper(), "digit": "0123456789", "stop": ".,;:!?", "mark": "'\"()-_/\\[]{}@+=~^`"}
#: Common words by language, as they stand in running text.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not this are from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}


def common_words() -> list[str]:
    return list(dict.fromkeys(w for words in COMMON.values() for w in words.split()))


def features(docs: DataFrame) -> DataFrame:
    """Base counts and the two histograms of every document, as narrow rows.

    Windows of three words are told apart by 64-bit hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    d = d.withColumn("n", F.size("words"))
    # A repeat needs a hash that stands twice, so most texts are done after one distinct.
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    both = lambda x, y: F.xxhash64(x, y)
    trios = F.zip_with(F.zip_with("hashes", F.slice("hashes", 2, 1 << 30), both), F.slice("hashes", 3, 1 << 30), both)
    d = d.withColumn("trios", F.when(F.col("n") > 2, F.slice(trios, F.lit(1), F.col("n") - 2)))
    d = d.withColumn("twice", F.size("trios") > F.size(F.array_distinct("trios")))
    ordered = F.array_sort(F.transform("trios", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    d = d.withColumn("ordered", F.when(F.col("twice"), ordered))
    same = lambda x, i: (x["t"] == F.get("ordered", i - 1)["t"]) | (x["t"] == F.get("ordered", i + 1)["t"])
    at = F.array_sort(F.transform(F.filter("ordered", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
    d = d.withColumn("at", F.when(F.col("twice"), at))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    d = d.withColumn("lines", F.when(F.contains("text", F.lit("\n")), lines))
    # places of the common words of the text, as they stand or capitalised, in the list
    listed = [x for w in common_words() for x in (w, w.capitalize())]
    place = lambda w: F.floor((F.array_position(F.array(*map(F.lit, listed)), w) + 1) / 2)
    d = d.withColumn("hits", F.transform(F.filter("words", lambda w: w.isin(listed)), place))
    counts = [F.size("hits") - F.size(F.array_remove("hits", F.lit(i + 1).cast("long"))) for i in range(len(common_words()))]
    # each class is taken out of what the ones before it have left
    d = d.withColumn("left_text", F.translate("text", LOWER, ""))
    left, hist = "left_text", [F.length("text") - F.length("left_text")]
    for name, letters in CLASSES.items():
        d = d.withColumn(f"left_{name}", F.translate(left, letters, ""))
        hist.append(F.length(left) - F.length(f"left_{name}"))
        left = f"left_{name}"
    blank, symbol = (hist[1 + list(CLASSES).index(c)] for c in ("blank", "symbol"))
    hist = [h for h in hist if h is not blank] + [F.length(left)]
    return d.select(
        "uid",
        "doc_id",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        (F.length("text") - blank).cast("long").alias("word_chars"),
        symbol.cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.when(F.col("twice"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*[h.cast("double") for h in hist]).alias("chars"),
        F.array(*[c.cast("double") for c in counts]).alias("commons"),
    )


def with_rest(hist: str, total: Column) -> Column:
    """The histogram with one more bin, for what the other bins leave of ``total``."""
    listed = F.aggregate(hist, F.lit(0.0), lambda a, x: a + x)
    return F.concat(hist, F.array(F.greatest(F.lit(0.0), total - listed)))


def shares(hist: Column, total: Column) -> Column:
    return F.transform(hist, lambda x: x / total)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of the same bins."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    each = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2))


def references(feat: DataFrame) -> DataFrame:
    """One row per language: (lang, docs, ref_chars, ref_commons), shares."""
    bins = lambda c, k: [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(k)]
    k_chars, k_words = len(CLASSES) + 1, len(common_words()) + 1
    full = feat.where("lang is not null").withColumn("commons", with_rest("commons", F.col("n_words")))
    out = full.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *bins("chars", k_chars), *bins("commons", k_words))

    def parts(c: str, k: int) -> Column:
        total = sum((F.col(f"{c}{i}") for i in range(k)), F.lit(0.0))
        return F.array(*[F.try_divide(F.col(f"{c}{i}"), total) for i in range(k)])

    return out.select("lang", "docs", parts("chars", k_chars).alias("ref_chars"), parts("commons", k_words).alias("ref_commons"))


def _with_rare(d: DataFrame, refs: DataFrame, table: DataFrame, pairs: Sequence[tuple[str, str, str]], nearest: Callable[[str, str], Column], wide: int) -> DataFrame:
    """The distances of ``d`` where more languages have a reference than ``table`` holds.

    A document without a language meets all rare references, ``wide`` to a row."""
    rare = refs.join(F.broadcast(table)).where(F.try_element_at("refs", "lang").isNull()).select("lang", "ref_chars", "ref_commons")
    foreign, known = F.col("lang").isNotNull() & F.col("own").isNull(), F.col("lang").isNull() | F.col("own").isNotNull()
    far = d.where(foreign).drop("own").join(rare.select("lang", F.struct("ref_chars", "ref_commons").alias("own")), "lang")
    near = d.where(known)
    for name, p, ref in pairs:
        far, near = far.withColumn(name, nearest(p, ref)), near.withColumn(name, nearest(p, ref))
    chunks = rare.groupBy(F.expr(f"pmod(xxhash64(lang), {-(-rare.count() // wide)})").alias("chunk")).agg(F.collect_list(F.struct("ref_chars", "ref_commons")).alias("more"))
    least = lambda p, ref: F.min(F.when(F.col(p).isNotNull(), F.array_min(F.transform("more", lambda r: distance(F.col(p), r[ref])))))
    more = d.where("lang is null").select("uid", "p_chars", "p_words").crossJoin(chunks.select("more"))
    more = more.groupBy("uid").agg(*[least(p, ref).alias(f"more_{name}") for name, p, ref in pairs])
    near = near.join(more, "uid", "left")
    for name, _, _ in pairs:
        near = near.withColumn(name, F.least(name, f"more_{name}")).drop(f"more_{name}")
    return near.unionByName(far)


def judge(docs: DataFrame, max_chars: float = 0.335, max_commons: float = 0.26, min_letters: int = 200, min_words: int = 150, wide: int = WIDE, scratch: Scratch | None = None) -> DataFrame:
    """Base counts, both distances and the verdict of every document."""
    s = scratch or Scratch(docs.sparkSession)
    feat = s.table(features(docs), "features")
    refs = s.table(references(feat), "references")
    common = refs.orderBy(F.desc("docs"), "lang").limit(wide)
    as_map = F.map_from_entries(F.collect_list(F.struct("lang", F.struct("ref_chars", "ref_commons"))))
    table = s.table(common.agg(as_map.alias("refs")), "common")  # one row
    d = feat.join(F.broadcast(table))
    d = d.withColumn("own", F.try_element_at("refs", "lang"))
    # totals and shares are columns of their own, so that no lambda sums them again
    d = d.withColumn("n_chars", F.aggregate("chars", F.lit(0.0), lambda a, x: a + x)).withColumn("full", with_rest("commons", F.col("n_words")))
    d = d.withColumn("p_chars", F.when(F.col("n_chars") >= min_letters, shares(F.col("chars"), F.col("n_chars"))))
    d = d.withColumn("p_words", F.when(F.col("n_words") >= min_words, shares(F.col("full"), F.col("n_words"))))

    def nearest(p: str, ref: str) -> Column:
        any_ref = F.array_min(F.transform(F.map_values("refs"), lambda r: distance(F.col(p), r[ref])))
        return F.when(F.col(p).isNull(), None).when(F.col("own").isNotNull(), distance(F.col(p), F.col("own")[ref])).otherwise(any_ref)

    pairs = (("char_distance", "p_chars", "ref_chars"), ("word_distance", "p_words", "ref_commons"))
    if refs.count() <= wide:
        for name, p, ref in pairs:
            d = d.withColumn(name, nearest(p, ref))
    else:
        d = _with_rare(d, refs, table, pairs, nearest, wide)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = F.coalesce(F.col("char_distance") > max_chars, F.lit(False)) | F.coalesce(F.col("word_distance") > max_commons, F.lit(False))
    d = d.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)
    return d.select("uid", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def keep(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns. ``docs`` must be a file scan
    or materialised table. Rejected rows' numbers are broadcast while they are few."""
    s = scratch or Scratch(docs.sparkSession)
    gone = s.table(judge(docs, scratch=s).where("not kept").select("uid"), "rejected")
    return without(docs, gone)


def op10(docs: DataFrame) -> DataFrame:
    return judge(docs).drop("uid")
