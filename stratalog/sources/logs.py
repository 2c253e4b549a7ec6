"""Raw and structured logs as DataFrames, and the way back to files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import mask_non_ascii


@dataclass(frozen=True)
class Format:
    """A compiled log format: a Java pattern, and for every field its name, its group, and the
    optional group around it, if any."""

    pattern: str
    fields: tuple[tuple[str, int, int | None], ...]


def compile_format(text: str) -> Format:
    """``<Field>`` captures lazily, other text is a pattern, runs of spaces are any white space.
    Groups inside the other text shift the numbers of the fields after them."""
    out, fields, group = "", [], 0
    around: list[int] = []  # groups that are open
    optional: set[int] = set()
    for i, piece in enumerate(re.split(r"<(\w+)>", text)):
        if i % 2:
            group += 1
            fields.append((piece, group, tuple(around)))
            out += "(.*?)"
            continue
        for mark in re.finditer(r"\\.|\((\?)?|\)([?*]?)", piece):
            if mark[0].startswith("("):
                group += not mark[1]
                around.append(0 if mark[1] else group)
            elif mark[0].startswith(")") and around:
                closed = around.pop()
                optional |= {closed} if mark[2] else set()
        out += re.sub(" +", lambda _: r"\s+", piece)
    inner = lambda groups: next((g for g in reversed(groups) if g in optional), None)
    return Format(f"^{out}$", tuple((name, g, inner(groups)) for name, g, groups in fields))


def stripped(value: Column) -> Column:
    """Without white space of any script at its ends."""
    return F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def parse_lines(lines: DataFrame, fmt: Format) -> DataFrame:
    """``line_id`` and the fields of matching lines of ``lines`` (line_id, value). Lines are
    stripped, runs of non-ASCII characters marked; a group that took no part is null."""
    v = mask_non_ascii(stripped(F.col("value")))
    d = lines.select("line_id", v.alias("v")).where((F.col("v") != "") & F.rlike("v", F.lit(fmt.pattern)))
    whole = lambda g: F.regexp_extract("v", fmt.pattern, g)
    # a group that took no part leaves the optional group around it empty
    value = lambda g, around: whole(g) if around is None else F.when(whole(around) != "", whole(g))
    return d.select("line_id", *(value(g, around).alias(name) for name, g, around in fmt.fields))


def rejected(lines: DataFrame, fmt: Format) -> DataFrame:
    """Non-blank lines that the format doesn't match."""
    v = mask_non_ascii(stripped(F.col("value")))
    return lines.where((v != "") & ~F.rlike(v, F.lit(fmt.pattern)))


def success_rate(lines: DataFrame, fmt: Format) -> DataFrame:
    v = mask_non_ascii(stripped(F.col("value")))
    return lines.where(v != "").agg(F.avg(F.rlike(v, F.lit(fmt.pattern)).cast("int")).alias("rate"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """``line_id, value``: physical lines numbered from 1, files in order of their names. A line's
    number is its place in its block of a file after all lines of the blocks before; only the
    blocks' counts are gathered, and lines stay where they are."""
    lines = spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"), "value", F.monotonically_increasing_id().alias("at")
    )
    blocks = lines.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(F.broadcast(blocks), "block").select((F.col("at") - F.col("first") + F.col("before") + 1).alias("line_id"), "value")


CSV_OUT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
STRUCTURED = T.StructType([T.StructField("LineId", T.LongType()), T.StructField("Content", T.StringType()), T.StructField("EventId", T.StringType()), T.StructField("EventTemplate", T.StringType())])
TEMPLATES = T.StructType([T.StructField("EventId", T.StringType()), T.StructField("EventTemplate", T.StringType())])
SUMMARY = "Dataset string, identified_templates long, ground_templates long, GA double, PA double, FGA double, PTA double, RTA double, FTA double"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False, line_breaks: bool = False) -> DataFrame:
    """Header CSV with doubled quotes, fields kept as they are; tolerant drops malformed rows.
    Only with ``line_breaks`` may fields hold any; files can't be split then."""
    mode = "DROPMALFORMED" if tolerant else "FAILFAST"
    return spark.read.schema(schema).option("header", True).option("multiLine", line_breaks).option("escape", '"').option("mode", mode).csv(path)


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, STRUCTURED)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """``EventId, EventTemplate`` of a catalogue; further columns, such as counts, are left out."""
    return spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path).select(*TEMPLATES.names)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_structured(numbered: DataFrame, path: str) -> None:
    """Lines with event ids as CSV: ``LineId, Content, EventId, EventTemplate``."""
    out = numbered.select(F.col("line_id").alias("LineId"), F.col("content").alias("Content"), F.col("event_id").alias("EventId"), F.col("template").alias("EventTemplate"))
    out.write.mode("overwrite").options(**CSV_OUT).csv(path)


def write_templates(catalog: DataFrame, path: str) -> None:
    """The catalogue, one file in numeric order of the ids; it is as small as its templates."""
    out = catalog.select(F.col("event_id").alias("EventId"), F.col("template").alias("EventTemplate"), F.col("occurrences").alias("Occurrences"))
    out.coalesce(1).write.mode("overwrite").options(**CSV_OUT).csv(path)


def write_trace(trace: DataFrame, path: str) -> None:
    trace.write.mode("overwrite").json(path)


def append_summary(row: DataFrame, path: str) -> None:
    row.write.mode("append").option("header", True).csv(path)
