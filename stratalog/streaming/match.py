"""Template matching on a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.templates import pattern
from ..functions.text import tokens


def match_stream(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """``lines`` (line_id, content, ...) with the first matching template of ``templates``
    (n, seq, template), or null. The templates are a static side; as a stream can't be
    aggregated without state here, each count's templates are one ordered array, of which the
    first that matches is taken."""
    arrays = templates.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("seq", "template", pattern(F.col("template")).alias("p")))).alias("known"))
    keyed = lines.withColumn("n", F.size(tokens(F.col("content"))))
    hit = F.filter("known", lambda k: F.rlike(F.col("content"), k["p"]))
    return keyed.join(arrays, "n", "left").withColumn("template", F.get(hit, F.lit(0))["template"]).drop("known", "n")


def counts_by_window(matched: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``window, template, lines`` with a watermark; templates per tumbling window."""
    return matched.withWatermark(time_col, late).groupBy(F.window(time_col, window), "template").agg(F.count("*").alias("lines"))
