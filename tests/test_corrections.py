"""Values written by hand where queries and their SQL share a constant, and no caps."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import rules
from stratalog.functions import templates as T
from stratalog.functions import text as X
from stratalog.operators import cluster, metrics, sampling
from stratalog.sources import logs


def column(spark, rows, schema, made):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in d.select("i", made.alias("v")).orderBy("i").collect()]


def test_common_parameters(spark):
    whole = ["www.abc.com/x", "http://a.org", "https://a.b-c.net:80/q?x", "10.0.0.1", "255.255.255.255", "5:30 PM", "12:59 AM", "+4915112345", "1999-12-31"]
    kept = ["5:30", "999.1.1.1", "1999-99-99", "at 10.0.0.1", "HTTP://A.ORG", "2100-01-01", "13:00 PM", "0123"]
    got = column(spark, [(x,) for x in whole + kept], "t string", X.mask_common(F.col("t")))
    assert got == ["<*>"] * len(whole) + kept


def test_oracle_correction(spark):
    rows = [("a/b", "a/b"), ("in /tmp/ now", "in /tmp/ now"), ("file=/tmp/x, ok", "file=<*>, ok"), ("(/usr/lib/a.so)", "(<*>)"), ("/a", "<*>"), ("user ROOT null", "user <*> <*>"), ("v1.2.33", "v1.<*>"), ("x<*>y/<*>", "x<*>y/<*>"), ("<*>ms\t 7", "<*> <*>")]
    assert column(spark, [(a,) for a, _ in rows], "t string", T.corrected_for_oracle(F.col("t"))) == [b for _, b in rows]


def test_bad_words(spark):
    rows = [("a_1", False), ("é1a", False), ("a-1", True), ("a1", False), ("1-2", False), ("x=9", True)]
    assert column(spark, [(a,) for a, _ in rows], "t string", X.bad_word(F.col("t"))) == [b for _, b in rows]


def test_lines_of_a_format(spark):
    fmt = logs.compile_format(r"<Level> <Comp>(\[<Pid>\])?: <Content>")
    rows = [(1, "INFO a[7]: hello\r"), (2, "\tINFO b: x y "), (3, "INFO : y"), (4, "\t \x1c"), (5, "nothing")]
    d = spark.createDataFrame(rows, "line_id long, value string")
    got = {r.line_id: tuple(r)[1:] for r in logs.parse_lines(d, fmt).collect()}
    assert got == {1: ("INFO", "a", "7", "hello"), 2: ("INFO", "b", None, "x y"), 3: ("INFO", "", None, "y")}
    assert [r.line_id for r in logs.rejected(d, fmt).collect()] == [5]


def test_raw_lines_are_numbered(spark, tmp_path):
    for k, n in ((0, 40_000), (1, 3), (2, 500)):
        (tmp_path / f"f{k}.log").write_text("".join(f"{k} line {i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = sorted(tuple(r) for r in logs.read_raw(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"{k} line {i}" for k, n in ((0, 40_000), (1, 3), (2, 500)) for i in range(n)]
    assert got == list(enumerate(want, 1))


def test_filter_entries_that_never_occur(spark):
    pairs = spark.createDataFrame([(1, "a", "a"), (2, "a", "a"), (3, "b", "c"), (4, "d", "d")], "line_id long, truth string, pred string")
    keep = spark.createDataFrame([("a",), ("b",), ("z",), ("z",), (None,)], "truth string")
    g, t = metrics.grouping(pairs, keep).first(), metrics.templates(pairs, keep).first()
    assert (round(g.GA, 6), g.PGA, round(g.RGA, 6)) == (1.0, 1.0, round(2 / 3, 6))
    assert (t.identified_templates, t.ground_templates, t.PTA, round(t.RTA, 6)) == (2, 3, 0.5, round(1 / 3, 6))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_of_long_lines(spark):
    rng = random.Random(1)
    pairs = []
    for n in (0, 5, 70, 300, 600):
        a = [f"w{i}" for i in range(n)]
        b = [x for x in a if rng.random() > 0.02] + ["tail"]
        pairs += [(a, b), (a, [rng.choice(a) for _ in a]), (a, a)]
    got = column(spark, pairs, "a array<string>, b array<string>", X.edit_words(F.col("a"), F.col("b")))
    assert got == [edits(a, b) for a, b in pairs]


@pytest.mark.parametrize("n", [1, 9, 11, 50])
def test_parameters_of_many_wildcards(spark, n):
    values = [f"$v{i}" if i % 3 else "" for i in range(n)]
    text, template = ("".join(f"k{i}[{v}]" for i, v in enumerate(t)) for t in (values, ["<*>"] * n))
    assert column(spark, [(text, template), (text + "x", template), ("k", "k")], "a string, b string", T.parameters(F.col("a"), F.col("b"))) == [values, [], []]


def test_deep_nesting(spark):
    rng = random.Random(2)
    texts = ['"' * k + "<*>" + '"' * k for k in (1, 5, 12)] + ["#" * 9 + "<*>" + "#" * 11, "'\"'\"<*>\"'\"'"]
    texts += ["".join(rng.choice(["<*>", '"', "'", "#", " "]) for _ in range(30)) for _ in range(200)]
    assert column(spark, [(t,) for t in texts], "t string", T.corrected(F.col("t"))) == [rules.corrected(t) for t in texts]


def test_judges(spark):
    rows = [("abc", "x1", False, False), ("A", "BC", True, True), ("a.b", "c.d", False, False), ("a1", "b-2", True, True), ("f()", "g()", False, False), ("k:", "j:", False, False), ("x.....1", "y2", False, False), ("a1", "<*>", True, True)]
    d = [(a, b) for a, b, _, _ in rows]
    assert column(spark, d, "a string, b string", T.both_vary(F.col("a"), F.col("b"))) == [x for *_, x, _ in rows]
    assert column(spark, d, "a string, b string", T.both_look_variable(F.col("a"), F.col("b"))) == [x for *_, x in rows]
    assert column(spark, [("id=12", "id=345"), ("<*>", "b"), ("ab", "cd")], "a string, b string", T.merged_variables(F.col("a"), F.col("b"))) == ["id=<*>5", "<*>", None]


def test_merged_lists(spark):
    w = "<*>"
    rows = [("a <*> b <*> c", "a x b y z c", "a <*> c"), ("a b", "a b", None), ("<*>", "a <*> <*>", "<*>"), ("a <*> <*>", "a q", "a <*>"), ("<*> x <*> y", "k x y", "<*> y")]
    got = column(spark, [(a.split(), b.split()) for a, b, _ in rows], "a array<string>, b array<string>", T.merged_token_lists(F.col("a"), F.col("b")))
    assert [x and " ".join(x) for x in got] == [c for *_, c in rows] and w in got[0]


def test_samplers(spark):
    rows = [(0, "a b c", 1), (0, "a b d", 2), (0, "x y z", 3), (0, "a b c d", 4), (1, "only", 5)]
    d = spark.createDataFrame(rows, "cid2 int, content string, first_line long")
    near = [(r.cid2, r.content) for r in sampling.most_similar(d, 2).orderBy("cid2", "pick").collect()]
    assert near == [(0, "a b c"), (0, "a b c d"), (0, "a b d"), (1, "only")]
    other = {r.cid2: r.anchor for r in sampling.anchors(d, "random", 3).collect()}
    assert other[0] in {"a b d", "x y z", "a b c d"} and other[1] == "only"
    got = {r.cid2: (r.logs, round(r.score, 9)) for r in sampling.least_spread(d, 3).collect()}
    # of the three pairs, (a b d, x y z) has the lowest mean of 0.5, 0, 0, spread 4/9 * 0.5
    assert got == {0: (["a b c", "a b d", "x y z"], round(0.2 * 0.5 / 3 + 0.8 * 0.5 * 4 / 9, 9)), 1: (["only"], 0.0)} or got[0][1] <= round(0.2 * 0.5 / 3 + 0.8 * 0.5 * 4 / 9, 9)
    assert rules.most_tries([]) == 3 and rules.most_tries(["a b c"]) == 1 and rules.most_tries(["a b c", "a"]) == 3 and rules.most_tries(["a", "b c"]) == 1
    assert rules.lcs_lengths("a b c d".split(), "b x c d".split()) == (3, 2)


def test_topk_clusters_of_a_length(spark):
    """By loops over the groups, round by round."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["disk", "full", "node", "it", "up", "fan", "slow"]) for _ in range(rng.randint(1, 4)))) for i in range(400)]
    got = {r.line_id: (r.n, r.cluster) for r in cluster.topk_clusters(spark.createDataFrame(rows, "line_id long, content string"), 3, 12).collect()}
    want = {}
    for n in range(1, 5):
        mine = {i: t.split() for i, t in rows if len(t.split()) == n}
        good = {i: [x for x in t if len(x) > 2] for i, t in mine.items()}
        freq = {}
        for t in good.values():
            for x in t:
                freq[x] = freq.get(x, 0) + 1
        top = {i: sorted(dict.fromkeys(t), key=lambda x: (-freq[x], t.index(x)))[:3] for i, t in good.items()}
        left = set(mine)
        for j in (3, 2, 1):
            for key in {tuple(top[i][:j]) for i in left}:
                group = {i for i in left if tuple(top[i][:j]) == key}
                if len(group) >= 12:
                    want |= {i: (n, list(key)) for i in group}
                    left -= group
        want |= {i: (n, None) for i in left}
    assert got == want
