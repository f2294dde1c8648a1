"""Files as users have them: CSV dialects, gzip shards of any suffix, commit logs, first-name lists, and rows as JSON."""

from __future__ import annotations

import zlib
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.config import Config
from kinloom.operators.keys import aliases
from kinloom.operators.resolve import report, resolve
from kinloom.plans.scratch import Scratch
from kinloom.sources import parsers, sinks


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """A CSV file with a header, quoted fields and line ends inside quotes. Without a schema all columns are strings."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Commit rows from a ``;``-separated file."""
    return read_csv(spark, path, ";")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) of gzip files whatever their suffix, as ``name.{0..31}.s``: Spark picks a codec by suffix, so a file
    is inflated as a stream in one task. Bytes that aren't UTF-8 are read as Latin-1, blank lines go."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def inflate(batches):
        for batch in batches:
            for content in batch.column(0):
                rest, left = memoryview(content.as_buffer()), b""
                while len(rest):
                    d, at = zlib.decompressobj(31), 0
                    while not d.eof and at < len(rest):
                        *found, left = (left + d.decompress(rest[at : at + (1 << 20)])).split(b"\n")
                        at += 1 << 20
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["raw"])
                    rest = rest[len(rest) - len(d.unused_data) - max(0, len(rest) - at) :] if d.eof and (d.unused_data or at < len(rest)) else rest[:0]
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array([left], pa.binary())], ["raw"])

    return parsers.decoded(raw.mapInArrow(inflate, "raw binary")).where("value <> ''").select("value")


def log_aliases(log: DataFrame) -> DataFrame:
    """(uid, name, email): the distinct authors of (pos, value) log lines, numbered by first appearance."""
    return parsers._numbered(parsers.parse_git_log(log), ["name", "email"], "pos", "uid").select("uid", "name", "email")


def with_first_names(spark: SparkSession, config: Config, *paths: str) -> Config:
    """The options with the first names of files of one name per line. A dictionary of names is small by nature; it
    travels to the tasks with the options."""
    value = F.lower(F.trim("value"))
    names = spark.read.text(list(paths)).select(value.alias("name")).where("name <> ''").distinct()
    return replace(config, first_names=tuple(sorted(r.name for r in names.collect())))


def to_row(*columns: str) -> Column:
    """A row's fields as one JSON text; nulls stay fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def from_row(c: str, schema: str) -> Column:
    """The fields of a JSON text; null where it is none."""
    return F.from_json(c, schema)


def resolve_file(spark: SparkSession, path: str, out: str, project: str = "", config: Config | None = None, with_username: bool = False) -> DataFrame:
    """Reads an alias file, resolves it and writes the resolution; returns what was written."""
    s, config = Scratch(spark), config or Config()
    df = s.table(parsers.parse_aliases(parsers.lines(spark, path), with_username), "aliases")
    a = s.table(aliases(df, config), "prepared")
    found = s.table(report(df, resolve(df, config, scratch=s, prepared=a), a, project), "report")
    sinks.write_resolution(found, out)
    return found
