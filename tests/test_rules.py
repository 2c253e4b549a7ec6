"""Micro-goldens and properties of the template functions."""

import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalog.functions import rules
from stratalog.functions import templates as T
from stratalog.functions import text as X
from stratalog.operators import assign, cluster, metrics, sampling
from stratalog.plans import parse
from stratalog.sources import logs

POST = [
    ("Connected to {ip}:{port}", "Connected to <*>", True),
    ("Took 35 ms", "Took <*> ms", True),
    ("id 0x1fZ done", "id <*> done", True),
    ("{a} {b}", "", False),
    ("foo{x}bar baz", "<*> baz", True),
    ("size {n}ms", "size <*>", True),
    ("v{n} up", "v<*> up", True),
    ('open "{path}" now', "open <*> now", True),
    ("a={x} b={y} c={z} d= e", "a=<*> b=<*> c=<*> d=<*> e", True),
    ("run {a} {b} {c} end", "run <*> end", True),
    ("at {d}, level {n}. next", "at <*> level <*> next", True),
    ("dir /{p}", "dir <*>", True),
    ("temp -{n} ok", "temp -<*> ok", True),
    ("1.2.3.4 up", "<*> up", True),
    ("job_12 done", "job_12 done", True),
    ("Jan 5 10:20:30 host", "Jan <*> host", True),
    ("({a} {b}) z", "(<*>) z", True),
]


def test_post_processing(spark):
    d = spark.createDataFrame([(a,) for a, _, _ in POST], "t string")
    got = [(r.t, r.p.template, r.p.ok) for r in d.select("t", T.post_processed(F.col("t")).alias("p")).collect()]
    assert sorted(got) == sorted(POST)
    assert [(a, *rules.post_processed(a)) for a, _, _ in POST] == POST


def test_correction_as_stated_row_by_row(spark):
    rng = random.Random(3)
    bits = ["<*>", "<*>", " ", " ", "a", "7", ".", ",", ":", "#", "/", "@", "-", "+", "(", ")", '"', "'", "=", "0x1f", "ms"]
    texts = sorted({"".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(3000)})
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.corrected(F.col("t")).alias("c")).collect()
    wrong = [(r.t, r.c, rules.corrected(r.t)) for r in got if r.c != rules.corrected(r.t)]
    assert not wrong


@pytest.mark.parametrize(
    "text, template, want",
    [("open file a", "open file <*>", True), ("open file a b", "open file <*>", True), ("open  file a", "open file <*>", False), ("Open file a", "open file <*>", False), ("x=", "x=<*>", True), ("a.c", "a.c", True), ("abc", "a.c", False)],
)
def test_match(spark, text, template, want):
    d = spark.createDataFrame([(text, template)], "a string, b string")
    assert d.select(T.matches(F.col("a"), F.col("b"))).first()[0] is want
    assert bool(rules.matcher(template).match(text)) is want


def test_clusters_and_samples(spark):
    lines = spark.createDataFrame(list(enumerate(["open file a1", "open file a2", "close file a3", "  "])), "line_id long, content string")
    got = cluster.clusters(lines).collect()
    assert {r.content: (r.feature, r.cid1, r.cid2) for r in got} == {c: (["file"], 0, 0) for c in ("open file a1", "open file a2", "close file a3")}
    d = spark.createDataFrame([(0, c, i) for i, c in enumerate(["a b c", "a b d", "x y z"])], "cid2 int, content string, first_line long")
    assert [r.content for r in sampling.diverse(d, 5).orderBy("pick").collect()] == ["a b c", "x y z", "a b d"]
    assert parse.farthest_first(["a b c", "a b d", "x y z"]) == ["a b c", "x y z", "a b d"]


def _positional(contents):
    """Feature of every content, by counting."""
    split = {c: c.split() for c in contents if c.split()}
    freq = Counter((len(t), i, w) for t in split.values() for i, w in enumerate(t))
    out = {}
    for c, t in split.items():
        f = [freq[len(t), i, w] for i, w in enumerate(t)]
        k, mode = max((f.count(x), x) for x in f)
        want = max(f) if mode == 1 else mode
        out[c] = [w for w, x in zip(t, f) if x == want]
    return out


@pytest.mark.parametrize("least, share, most", [(1 << 20, 64, 1 << 26), (0, 1 << 30, 1 << 26), (40, 4, 1 << 26), (1 << 20, 64, 60)])
def test_features_of_small_and_large_lengths(spark, least, share, most):
    rows = [f"{'a b c'.split()[i % 3]} x{i % 7} y{i % 2} " + " ".join("z" * (i % 4)) for i in range(60)] + ["a  b", "a b", "a b", " ", "", "\u00a0"]
    lines = spark.createDataFrame(list(enumerate(rows)), "line_id long, content string")
    got = cluster.features(lines, least, share, most).collect()
    want = _positional(rows)
    assert len(got) == len(want) and {r.content: r.feature for r in got} == want
    assert {r.content: (r.n, r.cnt, r.first_line) for r in got} == {c: (len(c.split()), rows.count(c), rows.index(c)) for c in want}
    assert cluster.features(lines.limit(0), least, share, most).collect() == []


def test_small_lengths_move_lines_once(spark):
    """Tokens are counted where their lines are: one exchange, of lines by length."""
    lines = spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(20)], "line_id long, content string")
    plan = cluster.features(lines)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan) and "tok#" not in "".join(re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan))
    assert len(re.findall(r"Exchange ", plan)) == 1


def test_merge(spark):
    cases = [("open <*> ok", "open x ok", "open <*> ok"), ("open y ok", "open x ok", None), ("open <*> ok now", "open x ok", None)]
    d = spark.createDataFrame([c[:2] for c in cases], "a string, b string")
    assert [r[0] for r in d.select(T.merged(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]
    assert [rules.merged(a, b) for a, b, _ in cases] == [c[2] for c in cases]


def test_metrics(spark):
    def pairs(truth, pred):
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(truth, pred))], "line_id long, truth string, pred string")

    one = metrics.summary(pairs("AABBC", "xxyzz"), "d").first()
    assert (one.GA, round(one.FGA, 6), one.PA, one.FTA) == (0.4, round(1 / 3, 6), 0, 0)
    two = metrics.summary(pairs(["a <*>", "a <*>", "b <*>", "c"], ["a <*>", "a <*>", "b 1", "c"]), "d").first()
    assert (two.GA, two.FGA, two.PA) == (1, 1, 0.75)
    assert [round(x, 6) for x in (two.PTA, two.RTA, two.FTA)] == [round(2 / 3, 6)] * 3
    three = metrics.summary(pairs("AAB", "AAB"), "d").first()
    assert {three.GA, three.FGA, three.PA, three.PTA, three.RTA, three.FTA} == {1}
    none = metrics.summary(pairs("", ""), "d").first()
    assert none.GA == 0 and none.ground_templates == 0


def test_numbers_filters_formats(spark, tmp_path):
    lines = spark.createDataFrame(list(enumerate("qpqr")), "line_id long, template string")
    assert [r.event_id for r in assign.numbered_events(lines).orderBy("line_id").collect()] == ["E1", "E2", "E1", "E3"]
    d = spark.createDataFrame([("a -> b <> c",)], "t string")
    assert d.select(X.angle_count(F.col("t")), X.wildcards(F.col("t"))).first() == (2, 0)
    (tmp_path / "raw.log").write_text("Jan 5 host: hello 7\n\nbad\nJan 6 host[12]: bye\n")
    fmt = logs.compile_format(r"<Month> <Day> <Host>(\[<PID>\])?: <Content>")
    raw = logs.read_raw(spark, str(tmp_path / "raw.log"))
    got = logs.parse_lines(raw, fmt).orderBy("line_id").collect()
    assert [(r.line_id, r.Host, r.PID, r.Content) for r in got] == [(1, "host", None, "hello 7"), (4, "host", "12", "bye")]
    assert [r.value for r in logs.rejected(raw, fmt).collect()] == ["bad"]
    numbered = assign.numbered_events(lines.withColumn("content", F.concat(F.lit(' "'), "template", F.lit('", x'))))
    logs.write_structured(numbered, str(tmp_path / "out"))
    back = logs.read_structured(spark, str(tmp_path / "out")).orderBy("LineId").collect()
    assert [r.Content for r in back] == [f' "{c}", x' for c in "qpqr"]
    logs.write_templates(assign.catalog(numbered), str(tmp_path / "templates"))


def test_every_line_matches_its_template(spark):
    texts = [f"user {i} did {i % 3} things" for i in range(30)] + [f"disk {i} full" for i in range(9)] + ["", "one"]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id long, content string")
    for plan in (parse.batch, parse.sequential):
        got = plan(lines, ("[0-9]+",)).collect()
        assert len(got) == len(texts)
        for r in got:
            assert rules.matcher(r.template).match(r.content.replace("\n", " ")) or r.template == r.content
    pdf = parse.parse_length(pd.DataFrame({"content": ["a x", "a y"], "cnt": [1, 1], "cid2": [0, 0], "first_line": [0, 1]}))
    assert pdf["template"].tolist() == ["a <*>", "a <*>"]
    assert parse.replay({"a x": "q"})(["a x"]) == "q"


def test_stream(spark, tmp_path):
    from stratalog.streaming.match import counts_by_window, match_stream

    spark.sql("select 1L line_id, 'open a' content, timestamp'2024-01-01 00:00:00' ts union all select 2L, 'zz', timestamp'2024-01-01 00:01:00'").write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([(2, 1, "open <*>"), (2, 2, "<*> a")], "n int, seq int, template string")
    stream = spark.readStream.schema("line_id long, content string, ts timestamp").parquet(str(tmp_path / "in"))
    q = match_stream(stream, known).writeStream.format("memory").queryName("matched").start()
    q.processAllAvailable()
    q.stop()
    assert {r.line_id: r.template for r in spark.table("matched").collect()} == {1: "open <*>", 2: None}
    w = counts_by_window(match_stream(stream, known), "ts").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    w.processAllAvailable()
    w.stop()
    assert sum(r.lines for r in spark.table("counted").collect()) == 2
