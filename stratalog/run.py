"""A run from files to files: read a log, parse it, write the result, score it, report.

    python -m stratalog.run --dataset Apache --input app.log --raw --output out
    python -m stratalog.run --dataset Apache --input lines.csv --truth lines.csv --output out --report reports

Without ``--raw`` the input is a CSV with LineId and Content. The truth is a CSV with LineId,
Content, EventId and EventTemplate. ``--complexity`` 1, 2 or 3 scores templates with 0, 1 to 4,
or 5 and more wildcards; ``--frequency`` the rarest (positive) or commonest (negative) percent.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.templates import corrected, corrected_for_oracle
from .operators import assign, metrics
from .plans import parse
from .plans.lineage import cut
from .sources import logs
from .sources.registry import DATASETS, Config


def options(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="stratalog", description="Find the event templates of a log.")
    p.add_argument("--dataset", choices=sorted(DATASETS), required=True)
    p.add_argument("--input", required=True)
    p.add_argument("--raw", action="store_true", help="the input is raw text in the dataset's format")
    p.add_argument("--output", required=True)
    p.add_argument("--truth", help="a structured file with known templates")
    p.add_argument("--report", help="folder to which the summary row is appended and averages are written")
    p.add_argument("--mode", choices=["batch", "sequential"], default="batch")
    p.add_argument("--mask", choices=["before", "add", "no"], default="before")
    p.add_argument("--samples", type=int, default=5)
    p.add_argument("--complexity", type=int, choices=[0, 1, 2, 3], default=0)
    p.add_argument("--frequency", type=float, default=0.0)
    p.add_argument("--corrected-truth", action="store_true", help="correct the truth by the rules for ground-truth files")
    return p.parse_args(args)


def read_lines(spark: SparkSession, config: Config, path: str, raw: bool) -> DataFrame:
    """``line_id, content`` of a raw or a structured log."""
    if raw:
        lines = logs.parse_lines(logs.read_raw(spark, path), DATASETS[config.dataset].format())
        return lines.select("line_id", F.col("Content").alias("content"))
    wanted = spark.read.option("header", True).option("escape", '"').csv(path)
    return wanted.select(F.col("LineId").cast("long").alias("line_id"), F.coalesce("Content", F.lit("")).alias("content"))


def parsed(lines: DataFrame, config: Config) -> tuple[DataFrame, DataFrame | None]:
    """Lines with templates and event ids, and the trace where the mode has one."""
    trace = None
    if config.mode == "batch":
        out, trace = parse.batch_with_trace(lines, config.masks(), config.samples)
    else:
        out = parse.sequential(lines, config.masks())
    return cut(assign.numbered_events(out)), trace


def corrected_truth(truth: DataFrame) -> DataFrame:
    """Structured rows with corrected templates; ids whose templates coincide become the lowest
    of them by text."""
    fixed = truth.select("EventId", "EventTemplate").dropna().distinct().withColumn("template", corrected_for_oracle(F.col("EventTemplate")))
    ids = fixed.groupBy("template").agg(F.min("EventId").alias("id"))
    known = fixed.join(ids, "template").select("EventId", "EventTemplate", "template", "id")
    kept = truth.join(known, ["EventId", "EventTemplate"], "left")
    return kept.select("LineId", "Content", F.coalesce("id", "EventId").alias("EventId"), F.coalesce("template", "EventTemplate").alias("EventTemplate"))


def chosen(truth: DataFrame, config: Config) -> DataFrame | None:
    """The truth templates (truth) that count, or None for all."""
    counts = truth.groupBy(F.col("EventTemplate").alias("truth")).agg(F.count("*").alias("occurrences")).where("truth is not null")
    if config.complexity:
        return metrics.of_complexity(counts, config.complexity).select("truth")
    return metrics.of_frequency(counts, config.frequency).select("truth") if config.frequency else None


def scored(found: DataFrame, truth: DataFrame, config: Config) -> DataFrame:
    """The summary row. Truth templates are corrected like proposed ones before they are compared."""
    if found.select("line_id").distinct().count() != found.count():
        raise ValueError("line ids are not unique")
    known = truth.where("EventTemplate is not null").withColumn("EventTemplate", corrected(F.col("EventTemplate")))
    pairs = cut(known.select(F.col("LineId").alias("line_id"), F.col("EventTemplate").alias("truth")).join(found.select("line_id", F.col("template").alias("pred")), "line_id"))
    keep = chosen(known, config)
    if keep is None:
        return metrics.summary(pairs, config.dataset)
    g, t = metrics.grouping(pairs, keep), metrics.templates(pairs, keep)
    own = metrics.parsing(pairs.join(keep, "truth", "left_semi"))
    row = g.join(t, F.lit(True)).join(own, F.lit(True))
    return row.select(F.lit(config.dataset).alias("Dataset"), "identified_templates", "ground_templates", *metrics.METRICS)


def report(row: DataFrame, folder: str) -> None:
    """Append the row to the summary; write averages over the datasets, first runs, and both transposed."""
    spark = row.sparkSession
    earlier = 0
    try:
        earlier = spark.read.schema(f"{logs.SUMMARY}, run long").option("header", True).csv(f"{folder}/summary").count()
    except Exception as e:  # noqa: BLE001  the first run finds no summary
        if "PATH_NOT_FOUND" not in str(e):
            raise
    logs.append_summary(row.withColumn("run", F.lit(earlier)), f"{folder}/summary")
    rows = spark.read.schema(f"{logs.SUMMARY}, run long").option("header", True).csv(f"{folder}/summary")
    mean = metrics.averages(rows)
    mean.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/average")
    metrics.transposed(mean).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/average_transposed")


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, float]:
    """The whole run; seconds by step."""
    config = Config(args.dataset, args.corrected_truth, args.complexity, args.frequency, args.mask, args.samples, args.mode)
    took, began = {}, time.monotonic()

    def done(step: str) -> None:
        nonlocal began
        took[step], began = time.monotonic() - began, time.monotonic()

    lines = read_lines(spark, config, args.input, args.raw)
    found, trace = parsed(lines, config)
    done("parse")
    logs.write_structured(found, f"{args.output}/structured")
    logs.write_templates(assign.catalog(found), f"{args.output}/templates")
    if trace is not None:
        logs.write_trace(trace.orderBy("iter"), f"{args.output}/trace")
    done("write")
    if args.truth:
        truth = logs.read_structured(spark, args.truth)
        if config.corrected_truth:
            truth = cut(corrected_truth(truth))
            renamed = truth.select(F.col("LineId").alias("line_id"), F.col("Content").alias("content"), F.col("EventId").alias("event_id"), F.col("EventTemplate").alias("template"))
            logs.write_structured(renamed, f"{args.output}/truth_structured_corrected")
            logs.write_templates(assign.catalog(renamed), f"{args.output}/truth_templates_corrected")
        row = cut(scored(found, truth, config))
        row.write.mode("overwrite").option("header", True).csv(f"{args.output}/summary")
        if args.report:
            report(row, args.report)
        done("evaluate")
    return took


def main(args: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("stratalog").getOrCreate()
    for step, seconds in run(spark, options(args)).items():
        print(f"{step}: {seconds:.1f} s")


if __name__ == "__main__":
    main()
