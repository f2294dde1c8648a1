"""Tables that cut a plan's lineage, and joins that choose their form by a checked size.

Intermediate tables are Parquet files below the folder that the cluster names in
``spark.checkpoint.dir``: they survive lost executors, and unlike a checkpoint they are
compressed, pruned by column and carry their size to the optimizer.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few fields that every executor can hold; beyond it a join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of a table's files, or of the optimizer's estimate, up to which it is broadcast.
BROADCAST_BYTES = 128 << 20
#: A key with fewer rows than this needs no care in a join or a window.
HOT_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, by ``spark.checkpoint.dir``. Where none is set, a
    session whose executors are the driver itself gets a new local one; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share; {master} has none")
        folder = "file://" + tempfile.mkdtemp(prefix="kinloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Materialised tables of one operator call.

    ``drop`` deletes a table that no later step reads. What is left when the driver ends is
    deleted then, since a returned DataFrame may still read it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/kinloom-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # the JVM is gone already
            pass

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """``df``, computed once and read back."""
        df.write.parquet(path := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._kinloom_path = path
        return out

    def release(self) -> None:
        """Lets Spark delete shuffle files that no plan in use can read any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_kinloom_path", None):
                remove(self.spark, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and, by the optimizer's statistics,
    ``size`` bytes, else as it is.

    It counts ``df``, so give it a materialised table.
    """
    return F.broadcast(df) if is_small(df, rows, size) else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    told = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return told <= size and df.limit(rows + 1).count() <= rows


def free_name(df: DataFrame, name: str) -> str:
    """``name`` under underscores, so many that no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose number is in ``gone`` (uid); ``docs`` must number its rows alike in
    every pass. Columns of ``docs`` keep their names, whatever they are called."""
    uid = free_name(docs, "uid")
    numbered = docs.withColumn(uid, F.monotonically_increasing_id())
    return numbered.join(small(gone.select(F.col("uid").alias(uid))), uid, "left_anti").drop(uid)


def left_join_hot(left: DataFrame, right: DataFrame, keys: list[str], size: str, rows: int, hot_rows: int = HOT_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``left`` with ``right``, which has each key once and in ``size`` the key's
    rows in ``left``.

    A ``right`` of at most ``broadcast_rows`` rows is broadcast. Beyond that, keys of at least max(hot_rows, rows / 10,000) rows are joined by broadcast: there are at
    most 10,000 of them, whatever the input's size. No key of the shuffled rest is hot.
    ``rows`` is the row count of ``left``. Null keys match nothing.
    """
    edge, values = max(hot_rows, rows // 10_000), [c for c in right.columns if c not in keys]
    hot = right.where(F.col(size) >= edge)
    if is_small(right, broadcast_rows):
        return left.join(F.broadcast(right), keys, "left")
    if hot.isEmpty():
        return left.join(right, keys, "left")
    tag = lambda df, p: df.select(*keys, F.struct(*values).alias(p))
    out = left.join(F.broadcast(tag(hot, "_hot")), keys, "left")
    # Rows that have met their key already look for a key that isn't there, each for another.
    aside = F.when(F.col("_hot").isNotNull() | _any_null(keys), F.xxhash64(F.monotonically_increasing_id()))
    out = out.withColumn("_aside", F.coalesce(aside, F.lit(0)))
    cold = tag(right.where(F.col(size) < edge), "_cold").withColumn("_aside", F.lit(0).cast("long"))
    out = out.join(cold, [*keys, "_aside"], "left")
    got = F.coalesce("_hot", "_cold")
    return out.select(*left.columns, *[got[c].alias(c) for c in values])


def _any_null(keys: list[str]) -> Column:
    out = F.col(keys[0]).isNull()
    for k in keys[1:]:
        out = out | F.col(k).isNull()
    return out
