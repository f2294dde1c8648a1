"""Exact deduplication by 128-bit content hash, checked byte by byte.

1. A narrow table of every row's 128-bit hash (MD5 of the text without white space).
2. Rows per hash and the row that stays, by partial aggregation: a hot group of copies is one row
   per task before it is shuffled.
3. Bytes: in groups of several rows the least and greatest normalised text are compared; a group
   in which they differ holds a collision. Texts meet as these two extremes only, so a group of
   any size costs one pair of texts per task.
4. Groups with a collision are grouped again by the text itself.

Nulls: a null text counts as empty; all empty or blank texts are one group. Among rows of equal
text and length a null doc_id comes last. Of repeated rows exactly one is kept. An empty table
gives an empty result; other columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.plans.scratch import BROADCAST_ROWS, HOT_ROWS, Scratch, left_join_hot, small, without

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", normalised().alias("norm"), F.coalesce(F.length("text"), F.lit(0)).alias("points"))


def groups(docs: DataFrame, hot_rows: int = HOT_ROWS, broadcast_rows: int = BROADCAST_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256). Groups of at least
    ``hot_rows`` rows, and a ten thousandth of all, are never joined by a shuffle, and no group is
    where there are at most ``broadcast_rows`` of them."""
    s = scratch or Scratch(docs.sparkSession)
    bits = F.unhex(F.md5("norm")).alias("bits")
    rows = s.table(_texts(docs).select("uid", "doc_id", bits, "points", F.sha2("norm", 256).alias("text_sha256")), "rows")
    n = rows.count()
    best = F.max(F.struct("points", (-F.col("doc_id")).alias("minus"), (-F.col("uid")).alias("row")))
    seen = s.table(rows.groupBy("bits").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "groups")
    # rows of large groups find their group by broadcast and so stay in their tasks, where copies fall together
    # before anything is shuffled; only texts of small groups may travel, and only where there are too many to broadcast
    several = s.table(seen.where("group_size > 1").select("bits", "group_size", F.lit(True).alias("several")), "several")
    wide = left_join_hot(_texts(docs).select("uid", bits, "norm"), several, ["bits"], "group_size", n, hot_rows, broadcast_rows).where("several")
    ends = wide.groupBy("bits").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    clash = s.table(ends.where("low <> high").select("bits"), "clashes")
    if not clash.isEmpty():
        # Rows of these hashes are told apart by their text: its least row names the group.
        again = wide.join(small(clash), "bits", "left_semi")
        named = s.table(again.groupBy("bits", "norm").agg(F.min("uid").alias("name")), "named")
        tag = again.join(named, ["bits", "norm"]).select("uid", F.concat("bits", F.encode(F.col("name").cast("string"), "utf-8")).alias("own"))
        rows = s.table(rows.join(tag, "uid", "left").withColumn("bits", F.coalesce("own", "bits")).drop("own"), "rows")
        seen = s.table(rows.groupBy("bits").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "groups")
    # a row of a group of its own needs no partner: only groups of several are joined
    many = seen.where("group_size > 1").select("bits", "group_size", (-F.col("best.minus")).alias("keep_id"), (-F.col("best.row")).alias("keep_row"))
    out = left_join_hot(rows, many.withColumn("_n", F.col("group_size")), ["bits"], "_n", n, hot_rows, broadcast_rows)
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
        "uid",
    )


def dedup(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    ``docs`` must be a materialised table or a file scan, which numbers its rows alike in every
    pass. The dropped rows' numbers are broadcast while they are few, else the texts shuffle.
    Columns keep their names, whatever they are called. Nulls, ties and repeated rows: as in ``groups``.
    """
    s = scratch or Scratch(docs.sparkSession)
    gone = s.table(groups(docs, scratch=s).where("not kept").select("uid"), "dropped")
    return without(docs, gone)


def op6(docs: DataFrame) -> DataFrame:
    return groups(docs).drop("uid")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS points, rowid AS r,
         translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
g AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
