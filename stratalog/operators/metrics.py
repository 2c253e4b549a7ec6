"""Grouping, parsing and template accuracy. ``pairs`` has ``line_id, truth, pred``.

One aggregate over (truth, pred) feeds everything; windows run over its rows, not the lines.
Rows without a truth are dropped; a missing prediction is the empty template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import angle_count, wildcards


def clean(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("truth").isNotNull()).withColumn("pred", F.coalesce("pred", F.lit("")))


def _groups(pairs: DataFrame) -> DataFrame:
    c = clean(pairs).groupBy("truth", "pred").agg(F.count("*").alias("c"))
    t, p = Window.partitionBy("truth"), Window.partitionBy("pred")
    return c.select("truth", "pred", "c", F.sum("c").over(t).alias("ct"), F.sum("c").over(p).alias("cp"))


def _harmonic(a, b):
    return F.when(a + b > 0, F.try_divide(2 * a * b, a + b)).otherwise(0.0)


def grouping(pairs: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """``GA, PGA, RGA, FGA``; with ``keep`` (truth) only those truth templates count, also, as
    truths that are missed, those that no row has."""
    g = _groups(pairs)
    if keep is not None:
        keep = keep.select("truth").dropna().distinct()
        g = g.join(keep, "truth", "left_semi")
    right = (F.col("c") == F.col("ct")) & (F.col("c") == F.col("cp"))
    s = g.agg(
        F.sum(F.when(right, F.col("c")).otherwise(0)).alias("rows_right"), F.sum("c").alias("rows"),
        F.sum(right.cast("int")).alias("right"), F.countDistinct("pred").alias("preds"), F.countDistinct("truth").alias("truths"),
    )
    if keep is not None:
        s = s.drop("truths").join(F.broadcast(keep.agg(F.count("*").alias("truths"))), F.lit(True))
    s = s.select(
        F.coalesce(F.try_divide("rows_right", "rows"), F.lit(0.0)).alias("GA"),
        F.coalesce(F.try_divide("right", "preds"), F.lit(0.0)).alias("PGA"),
        F.coalesce(F.try_divide("right", "truths"), F.lit(0.0)).alias("RGA"),
    )
    return s.withColumn("FGA", _harmonic(F.col("PGA"), F.col("RGA")))


def parsing(pairs: DataFrame) -> DataFrame:
    """``PA``: share of rows whose template is the truth's."""
    return clean(pairs).agg(F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("PA"))


def templates(pairs: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """``identified_templates, ground_templates, PTA, RTA, FTA``; with ``keep`` (truth) the ground
    templates are all of it, whether a row has them or not."""
    c = clean(pairs).groupBy("truth", "pred").agg(F.count("*").alias("c"))
    p = c.groupBy("pred").agg(F.min("truth").alias("lo"), F.max("truth").alias("hi"))
    truths = c.select("truth").distinct()
    if keep is not None:
        truths = k = keep.select("truth").dropna().distinct()
        p = p.join(c.join(k, "truth", "left_semi").select("pred").distinct(), "pred", "left_semi")
    s = p.agg(F.count("*").alias("identified_templates"), F.coalesce(F.sum(((F.col("lo") == F.col("pred")) & (F.col("hi") == F.col("pred"))).cast("int")), F.lit(0)).alias("right"))
    s = s.join(F.broadcast(truths.agg(F.count("*").alias("ground_templates"))), F.lit(True))
    s = s.select(
        "identified_templates", "ground_templates",
        F.coalesce(F.try_divide("right", "identified_templates"), F.lit(0.0)).alias("PTA"),
        F.coalesce(F.try_divide("right", "ground_templates"), F.lit(0.0)).alias("RTA"),
    )
    return s.withColumn("FTA", _harmonic(F.col("PTA"), F.col("RTA")))


def summary(pairs: DataFrame, dataset: str) -> DataFrame:
    """One metrics row from one pass: everything follows from the (truth, pred) counts."""
    p = Window.partitionBy("pred")
    g = _groups(pairs).withColumn("truths_of_pred", F.count("*").over(p))
    right = (F.col("c") == F.col("ct")) & (F.col("c") == F.col("cp"))
    same = F.col("truth") == F.col("pred")
    total = lambda when, what: F.coalesce(F.sum(F.when(when, what).otherwise(0)), F.lit(0))
    s = g.agg(
        F.countDistinct("pred").alias("identified_templates"), F.countDistinct("truth").alias("ground_templates"), F.sum("c").alias("rows"),
        total(right, F.col("c")).alias("rows_right"), total(right, 1).alias("right"), total(same, F.col("c")).alias("rows_same"), total(same & (F.col("truths_of_pred") == 1), 1).alias("same"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f = lambda n: _harmonic(share(n, "identified_templates"), share(n, "ground_templates"))
    return s.select(
        F.lit(dataset).alias("Dataset"), "identified_templates", "ground_templates",
        share("rows_right", "rows").alias("GA"), share("rows_same", "rows").alias("PA"), f("right").alias("FGA"),
        share("same", "identified_templates").alias("PTA"), share("same", "ground_templates").alias("RTA"), f("same").alias("FTA"),
    )


def of_complexity(templates_df: DataFrame, level: int, strict: bool = True) -> DataFrame:
    """Truth templates with 0, 1 to 4, or 5 and more wildcards; not strict counts ``>``."""
    n = wildcards(F.col("truth")) if strict else angle_count(F.col("truth"))
    return templates_df.where({1: n == 0, 2: (n >= 1) & (n <= 4), 3: n >= 5}[level])


def of_frequency(counts: DataFrame, percent: float) -> DataFrame:
    """Of ``truth, occurrences``: the rarest percent if positive, the commonest if negative."""
    w = Window.orderBy("occurrences", "truth")
    ranked = counts.withColumn("r", F.row_number().over(w))
    n = counts.count()
    k = int(n / 100 * abs(percent))
    return ranked.where(F.col("r") <= k if percent > 0 else F.col("r") > n - k).select("truth", "occurrences")


METRICS = ["GA", "PA", "FGA", "PTA", "RTA", "FTA"]


def averages(rows: DataFrame) -> DataFrame:
    """``rows`` (Dataset, metrics, run) reduced to the first run of each dataset, with an Average row."""
    w = Window.partitionBy("Dataset").orderBy("run")
    once = rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("Dataset", *METRICS)
    mean = once.agg(*(F.round(F.avg(m), 3).alias(m) for m in METRICS)).select(F.lit("Average").alias("Dataset"), *METRICS)
    return once.unionByName(mean)


def transposed(rows: DataFrame) -> DataFrame:
    """``metric, Dataset, value`` in long form."""
    return rows.unpivot(["Dataset"], METRICS, "metric", "value").select("metric", "Dataset", "value")


def missing(spark, dataset: str) -> DataFrame:
    """The summary row of a dataset without results."""
    fields = "Dataset string, identified_templates long, ground_templates long, " + ", ".join(f"{m} double" for m in METRICS)
    return spark.createDataFrame([(dataset, *[None] * (2 + len(METRICS)))], fields)
