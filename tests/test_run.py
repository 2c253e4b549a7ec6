"""Runs from files to files, on lines made from templates."""

import csv
import random

import pytest

from stratalog import run as R
from stratalog.sources import logs

# Lines of the dataset "Apache": [time] [level] content.
KNOWN = ["worker <*> started on node <*>", "cache miss for key <*>", "job <*> finished after <*> seconds with code <*>", "shutdown complete"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top, rng, rows = tmp_path_factory.mktemp("run"), random.Random(6), []
    for i in range(1, 301):
        t = rng.choice(KNOWN)
        content = t
        while "<*>" in content:
            content = content.replace("<*>", f"a{rng.randrange(10**6)}", 1)
        rows.append((i, content, f"E{KNOWN.index(t) + 1}", t))
    (top / "raw.log").write_text("".join(f"[Mon 10:{i % 60:02d}] [info] {c}\n" for i, c, _, _ in rows) + "broken line\n")
    with (top / "truth.csv").open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["LineId", "Content", "EventId", "EventTemplate"])
        out.writerows(rows)
    return top


@pytest.mark.parametrize("mode, raw", [("batch", True), ("sequential", False)])
def test_run(spark, files, tmp_path, mode, raw):
    out, reports = str(tmp_path / "out"), str(tmp_path / "reports")
    args = ["--dataset", "Apache", "--input", str(files / ("raw.log" if raw else "truth.csv")), "--output", out, "--truth", str(files / "truth.csv"), "--report", reports, "--mode", mode]
    took = R.run(spark, R.options(args + ["--raw"] * raw))
    assert set(took) == {"parse", "write", "evaluate"}
    found = logs.read_structured(spark, f"{out}/structured").collect()
    assert len(found) == 300 and {r.EventTemplate for r in found} == set(KNOWN)
    names = [(r.EventId, r.EventTemplate) for r in logs.read_templates(spark, f"{out}/templates").collect()]
    assert [n for n, _ in names] == ["E1", "E2", "E3", "E4"] and {t for _, t in names} == set(KNOWN)
    row = spark.read.schema(logs.SUMMARY).option("header", True).csv(f"{out}/summary").first()
    assert row.Dataset == "Apache" and [row[m] for m in ("GA", "PA", "FGA", "PTA", "RTA", "FTA")] == [1.0] * 6
    R.run(spark, R.options([*args, *["--raw"] * raw, "--complexity", "2", "--corrected-truth"]))
    assert spark.read.option("header", True).csv(f"{reports}/summary").count() == 2
    assert {r.Dataset for r in spark.read.option("header", True).csv(f"{reports}/average").collect()} == {"Apache", "Average"}
    assert logs.read_structured(spark, f"{out}/truth_structured_corrected").count() == 300
    if mode == "batch":
        trace = spark.read.json(f"{out}/trace").orderBy("iter").collect()
        assert [r.iter for r in trace] == list(range(1, len(trace) + 1)) and all(1 <= len(r.logs_to_query) <= 5 for r in trace)


def test_catalogue_round_trip(spark, tmp_path):
    """Lines generated from a catalogue and scored against it, as a property of the parse."""
    (tmp_path / "t.csv").write_text('EventId,EventTemplate,Occurrences\nE1,"a, b <*>",3\nE2," x ""q"" <*>",4\n')
    assert [tuple(r) for r in logs.read_templates(spark, str(tmp_path / "t.csv")).collect()] == [("E1", "a, b <*>"), ("E2", ' x "q" <*>')]
