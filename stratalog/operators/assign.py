"""Assigning templates to lines, numbering events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.templates import ends_agree, pattern
from ..functions.text import WILD, tokens
from ..plans.lineage import cut

BROADCAST_ROWS = 100_000


def first_match(contents: DataFrame, templates: DataFrame) -> DataFrame:
    """``content, template``: of the templates with a content's key ``n`` that match it, the one
    with the smallest ``seq``. Contents without a match are left out.

    The join is on the key; ends are compared before the pattern. The templates are written
    once, and broadcast only if a count shows that they are few; else Spark joins by sorting, on
    the key and on the first token where a template has a constant one, so that not all lines
    and templates of one length meet in one task.
    """
    known = cut(templates.select("n", "seq", "template", pattern(F.col("template")).alias("p")))
    if known.count() <= BROADCAST_ROWS:
        hit = contents.select("content", "n").join(F.broadcast(known), "n")
    else:
        start = F.get(tokens(F.col("template")), F.lit(0))
        known = known.withColumn("start", F.when(start.contains(WILD), F.lit(None)).otherwise(start))
        lines = contents.select("content", "n", F.get(tokens(F.col("content")), F.lit(0)).alias("start"))
        fixed = lines.join(known.where("start is not null"), ["n", "start"]).drop("start")
        hit = fixed.unionByName(lines.drop("start").join(known.where("start is null").drop("start"), "n"))
    hit = hit.where(ends_agree(F.col("content"), F.col("template")) & F.rlike("content", "p"))
    best = hit.groupBy("content").agg(F.min("seq").alias("seq"))
    return best.join(known.select("seq", "template"), "seq").select("content", "template")


def unmatched(contents: DataFrame, assigned: DataFrame) -> DataFrame:
    return contents.join(assigned.select("content"), "content", "left_anti")


def numbered_events(lines: DataFrame) -> DataFrame:
    """``lines`` (line_id, template, ...) with ``event_id`` E1, E2, ... by first appearance. Only
    distinct templates are ordered."""
    firsts = lines.groupBy("template").agg(F.min("line_id").alias("first"))
    ids = firsts.select("template", F.concat(F.lit("E"), F.row_number().over(Window.orderBy("first"))).alias("event_id"))
    return lines.join(ids, "template")


def catalog(numbered: DataFrame) -> DataFrame:
    """``event_id, template, occurrences`` in numeric order of the ids."""
    c = numbered.groupBy("event_id", "template").agg(F.count("*").alias("occurrences"))
    return c.orderBy(F.regexp_extract("event_id", r"(\d+)", 1).cast("int"))


def consensus(clustered: DataFrame) -> DataFrame:
    """``cid2, cid1, template``: tokens on which a cluster agrees, wildcards elsewhere."""
    at = clustered.select("cid1", "cid2", F.posexplode(tokens(F.col("content"))).alias("pos", "tok"))
    agreed = at.groupBy("cid1", "cid2", "pos").agg(F.min("tok").alias("lo"), F.max("tok").alias("hi"))
    part = F.struct("pos", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("<*>").alias("tok"))
    rows = agreed.groupBy("cid1", "cid2").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return rows.select("cid1", "cid2", F.array_join(F.transform("parts", lambda p: p["tok"]), " ").alias("template"))
