"""Pairs of blocks that no rule bounds, as classes of aliases: aliases that have the same of these keys are one class, and
classes are linked instead of aliases, so that pairs are neither compared nor made distinct one by one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.plans.scratch import Scratch, small

#: Aliases of a class that meet in one row of a task, all of whose pairs Spark holds before they are passed on; pairs of a task.
CHUNK, TASK_PAIRS = 256, 4_000_000


@dataclass
class Dense:
    """``blocks`` (grp, key); ``members`` (uid, cls, chunk), a class being called as its least uid; ``links`` (grp, x, y) of classes
    whose members all pair, x <= y; ``hubs`` (a, b) join the aliases of each block; ``taken`` are pairs that are listed elsewhere too."""

    label: str
    scratch: Scratch
    blocks: DataFrame
    members: DataFrame
    links: DataFrame
    hubs: DataFrame
    taken: DataFrame | None = None

    def mark(self, clues: DataFrame) -> DataFrame:
        """Adds the label to the (grp, a, b, rules) that are among the pairs, and remembers these."""
        clues, members = self.scratch.table(clues, "clues"), small(self.members)
        at = lambda side: members.select(F.col("uid").alias(side), F.struct("cls", "chunk").alias(f"_{side}"))
        met = clues.select("a", "b").join(at("a"), "a").join(at("b"), "b")
        met = met.select("a", "b", (F.col("_a") <= F.col("_b")).alias("up"), F.least("_a", "_b").alias("lo"), F.greatest("_a", "_b").alias("hi"))
        met = met.select("a", "b", F.col("lo.cls").alias("x"), F.col("lo.chunk").alias("i"), F.col("hi.cls").alias("y"), F.col("hi.chunk").alias("j"), F.when(F.col("up"), F.col("a")).otherwise(F.col("b")).alias("u"), F.when(F.col("up"), F.col("b")).otherwise(F.col("a")).alias("v"))
        self.taken = self.scratch.table(met.join(small(self.links.select("x", "y")), ["x", "y"]).select("a", "b", "x", "i", "y", "j", "u", "v"), "taken")
        c = clues.join(small(self.taken.select("a", "b", F.lit(True).alias("_too"))), ["a", "b"], "left")
        return c.select("grp", "a", "b", F.when(F.col("_too"), F.array_sort(F.array_union("rules", F.array(F.lit(self.label))))).otherwise(F.col("rules")).alias("rules"))

    def counted(self) -> DataFrame:
        """(x, n): of each link the pairs that are listed nowhere else; x stands for the component."""
        sizes = self.members.groupBy("cls").agg(F.count(F.lit(1)).alias("k"))
        of = lambda c: sizes.select(F.col("cls").alias(c), F.col("k").alias(f"k{c}"))
        n = F.when(F.col("x") == F.col("y"), F.col("kx") * (F.col("kx") - 1) / 2).otherwise(F.col("kx") * F.col("ky")).cast("long")
        out = self.links.join(of("x"), "x").join(of("y"), "y").select("x", "y", n.alias("n"))
        if self.taken is not None:
            out = out.join(self.taken.groupBy("x", "y").agg(F.count(F.lit(1)).alias("less")), ["x", "y"], "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
        return out.select("x", "n").where("n > 0")

    def pairs(self) -> DataFrame:
        """(grp, a, b) of all pairs that are listed nowhere else, each once. Chunks of classes meet, so that tasks are of one size
        however large a block is."""
        chunks = self.scratch.table(self.members.groupBy("cls", "chunk").agg(F.collect_list("uid").alias("uids")), "chunks")
        of = lambda c, i: chunks.select(F.col("cls").alias(c), F.col("chunk").alias(i), F.col("uids").alias(f"{c}s"))
        p = self.links.join(of("x", "i"), "x").join(of("y", "j"), "y").where("x < y or i <= j")
        gone = F.lit(None).cast("map<bigint,array<bigint>>")
        if self.taken is not None:
            per = self.taken.groupBy("x", "i", "y", "j", "u").agg(F.collect_list("v").alias("vs")).groupBy("x", "i", "y", "j").agg(F.map_from_entries(F.collect_list(F.struct("u", "vs"))).alias("gone"))
            p, gone = p.join(per, ["x", "i", "y", "j"], "left"), F.col("gone")
        total = self.counted().agg(F.sum("n")).first()[0] or 0
        tasks = min(20_000, max(int(self.scratch.spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_PAIRS + 1))
        p = p.withColumn("gone", gone).withColumn("one", (F.col("x") == F.col("y")) & (F.col("i") == F.col("j"))).repartition(tasks)
        p = p.select("grp", "one", "ys", "gone", F.explode("xs").alias("u"))
        out = F.try_element_at("gone", F.col("u"))
        p = p.select("grp", "one", "u", F.explode(F.when(out.isNotNull(), F.array_except("ys", out)).otherwise(F.col("ys"))).alias("v"))
        return p.where(~F.col("one") | (F.col("u") < F.col("v"))).select("grp", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def dense(keys: DataFrame, left: str, right: str, label: str, above: int, s: Scratch, chunk: int = CHUNK) -> Dense | None:
    """The blocks in which more than ``above`` keys of the kind ``left`` meet more than ``above`` of ``right``; None if there are none.
    ``above`` must be so large that whatever pairs are refused, a block's aliases stay in one component."""
    k = keys.where(F.col("kind").isin(left, right)).where(F.col("n") > above).select("grp", "kind", "key", "uid")
    blocks = s.table(k.groupBy("grp", "key").agg(F.count_if(F.col("kind") == left).alias("l"), F.count_if(F.col("kind") == right).alias("r")).where((F.col("l") > above) & (F.col("r") > above)).select("grp", "key"), "blocks")
    if blocks.isEmpty():
        return None
    rows = s.table(k.join(small(blocks), ["grp", "key"]), "rows")
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("key"))))
    sides = s.table(rows.groupBy("grp", "uid").agg(of(left).alias("l"), of(right).alias("r")), "sides")
    classes = s.table(sides.groupBy("grp", "l", "r").agg(F.min("uid").alias("cls"), F.count(F.lit(1)).alias("k")), "classes")
    # some sides are empty, none is null
    members = sides.join(small(classes), ["grp", "l", "r"]).select("uid", "cls", F.pmod(F.xxhash64("uid"), F.ceil(F.col("k") / chunk)).alias("chunk"))
    x, y = (classes.select("grp", F.col("cls").alias(c), F.explode(side).alias("key")) for c, side in (("p", "l"), ("q", "r")))
    links = x.join(y, ["grp", "key"]).select("grp", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()
    links = links.join(classes.select(F.col("cls").alias("x"), "k"), "x").where("x < y or k > 1").select("grp", "x", "y")
    least = rows.groupBy("grp", "key").agg(F.min("uid").alias("a"))
    hubs = rows.join(small(s.table(least, "least")), ["grp", "key"]).select("a", F.col("uid").alias("b")).where("a < b").distinct()
    return Dense(label, s, blocks, s.table(members, "members"), s.table(links, "links"), hubs)
