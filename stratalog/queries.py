"""Registered queries and their SQL equivalents for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import templates as T
from .functions import text as X
from .operators import assign, cluster, metrics, sampling
from .plans import parse
from .sources import logs
from .sources.views import DOC_SQL, EVENT_SQL, doc_lines, event_lines, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LINES = f"lines AS ({EVENT_SQL})"
DOCS = f"docs AS ({DOC_SQL})"
MASKS = ("[0-9]+",)
# Lines as the event view has them, masked: what most text queries run on.
TOK = "list_filter(string_split_regex({}, '\\s+'), x -> x <> '')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = re.sub(r"\((\w+), (\w+)\) ->|\b(\w+) ->", lambda m: f"lambda {m[3] or f'{m[1]}, {m[2]}'}:", sql)
        return f

    return register


def _masked(spark, sf_dir):
    return event_lines(spark, sf_dir).withColumn("content", X.mask(F.col("content"), MASKS))


_MASKED = "regexp_replace(content, '[0-9]+', '<*>', 'g')"


# ---- projections, masks, formats ------------------------------------------------------------


@query(f"WITH {LINES} SELECT line_id, {_MASKED} AS masked FROM lines")
def mask_regex(spark, sf_dir):
    return event_lines(spark, sf_dir).select("line_id", X.mask(F.col("content"), MASKS).alias("masked"))


@query(f"""WITH {LINES}, q AS (SELECT line_id, replace(replace(content, 'user', '`user`'), 'item', '`item''') AS content FROM lines)
    SELECT line_id, regexp_replace(regexp_replace(content, '`[^`]*`', '{{variable}}', 'g'), '`[^'']*''', '{{variable}}', 'g') AS masked FROM q""")
def mask_quoted(spark, sf_dir):
    quoted = F.replace(F.replace("content", F.lit("user"), F.lit("`user`")), F.lit("item"), F.lit("`item'"))
    return event_lines(spark, sf_dir).select("line_id", X.mask_quoted(quoted).alias("masked"))


@query(f"WITH {DOCS} SELECT line_id, regexp_replace(content, '[^\\x00-\\x7F]+', '<N/ASCII>', 'g') AS content FROM docs")
def non_ascii_replace(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("line_id", X.mask_non_ascii(F.col("content")).alias("content"))


@query(f"""WITH {LINES}, t AS (SELECT line_id, unnest({TOK.format('content')}) AS tok FROM lines)
    SELECT tok, count(*) AS hits FROM t WHERE regexp_matches(tok, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') OR regexp_matches(tok, '^[a-z]+$') GROUP BY tok""")
def token_shapes(spark, sf_dir):
    t = event_lines(spark, sf_dir).select(F.explode(X.tokens(F.col("content"))).alias("tok"))
    return t.where(F.col("tok").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.col("tok").rlike("^[a-z]+$")).groupBy("tok").agg(F.count("*").alias("hits"))


FORMAT = r"user <User> (clicked|viewed) item <Content>"
_RAW = "lower(content)"


@query(f"""WITH {LINES} SELECT line_id, regexp_extract(content, '^user\\s+(.*?)\\s+(clicked|viewed)\\s+item\\s+(.*?)$', 1) AS "User",
    regexp_extract(content, '^user\\s+(.*?)\\s+(clicked|viewed)\\s+item\\s+(.*?)$', 3) AS "Content" FROM lines
    WHERE regexp_matches(content, '^user\\s+(.*?)\\s+(clicked|viewed)\\s+item\\s+(.*?)$')""")
def format_parse(spark, sf_dir):
    return logs.parse_lines(event_lines(spark, sf_dir).select("line_id", F.col("content").alias("value")), logs.compile_format(FORMAT))


@query(f"WITH {LINES} SELECT line_id, content AS value FROM lines WHERE NOT regexp_matches(content, '^user\\s+(.*?)\\s+(clicked|viewed)\\s+item\\s+(.*?)$')")
def format_rejects(spark, sf_dir):
    return logs.rejected(event_lines(spark, sf_dir).select("line_id", F.col("content").alias("value")), logs.compile_format(FORMAT))


@query(f"WITH {LINES} SELECT avg(CASE WHEN regexp_matches(content, '^user\\s+(.*?)\\s+(clicked|viewed)\\s+item\\s+(.*?)$') THEN 1.0 ELSE 0.0 END) AS rate FROM lines")
def format_success_rate(spark, sf_dir):
    return logs.success_rate(event_lines(spark, sf_dir).select("line_id", F.col("content").alias("value")), logs.compile_format(FORMAT))


# ---- tokens, partitions, clusters -----------------------------------------------------------


@query(f"WITH {DOCS} SELECT line_id, array_to_string({TOK.format('content')}, '|') AS tokens, CAST(len({TOK.format('content')}) AS INT) AS n FROM docs")
def tokenize(spark, sf_dir):
    t = doc_lines(spark, sf_dir).withColumn("t", X.tokens(F.col("content")))
    return t.select("line_id", F.array_join("t", "|").alias("tokens"), F.size("t").alias("n"))


@query(f"WITH {DOCS} SELECT CAST(len({TOK.format('content')}) AS INT) AS n, count(*) AS lines, count(DISTINCT content) AS contents FROM docs GROUP BY 1")
def token_length_hist(spark, sf_dir):
    t = doc_lines(spark, sf_dir).groupBy("content").agg(F.count("*").alias("c")).withColumn("n", F.size(X.tokens(F.col("content"))))
    return t.groupBy("n").agg(F.sum("c").alias("lines"), F.count("*").alias("contents"))


@query(f"""WITH {DOCS}, t AS (SELECT line_id, len({TOK.format('content')}) AS n FROM docs)
    SELECT line_id, CAST(n AS INT) AS n, CAST(dense_rank() OVER (ORDER BY n) - 1 AS INT) AS cid1 FROM t""")
def length_partition(spark, sf_dir):
    t = doc_lines(spark, sf_dir).select("line_id", F.size(X.tokens(F.col("content"))).alias("n"))
    ranks = t.select("n").distinct().withColumn("cid1", F.row_number().over(Window.orderBy("n")) - 1)
    return t.join(F.broadcast(ranks), "n").select("line_id", "n", "cid1")


_STOP = ", ".join(f"'{w}'" for w in cluster.STOP_WORDS)
_VOCAB = f"""t AS (SELECT unnest({TOK.format('content')}) AS tok FROM docs),
    vocab AS (SELECT tok, count(*) AS freq FROM t WHERE length(tok) > 2 AND lower(tok) NOT IN ({_STOP}) GROUP BY tok)"""


@query(f"WITH {DOCS}, {_VOCAB} SELECT tok, freq FROM vocab")
def vocab_counts(spark, sf_dir):
    return cluster.vocabulary(doc_lines(spark, sf_dir))


_TOP = f"""lt AS (SELECT line_id, tok, min(pos) AS pos FROM (SELECT line_id, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM (SELECT line_id, {TOK.format('content')} AS t FROM docs)) GROUP BY ALL),
    top AS (SELECT line_id, list(tok ORDER BY freq DESC, pos)[1:3] AS top FROM lt JOIN vocab USING (tok) GROUP BY line_id)"""


@query(f"WITH {DOCS}, {_VOCAB}, {_TOP} SELECT line_id, array_to_string(top, ' ') AS top FROM top")
def vocab_topk(spark, sf_dir):
    return cluster.top_tokens(doc_lines(spark, sf_dir), 3).select("line_id", F.array_join("top", " ").alias("top"))


_TOP_OF_LENGTH = f"""lines_ AS (SELECT line_id, len({TOK.format('content')}) AS n, {TOK.format('content')} AS t FROM docs),
    words AS (SELECT line_id, n, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM lines_),
    good AS (SELECT * FROM words WHERE length(tok) > 2 AND lower(tok) NOT IN ({_STOP})),
    freqs AS (SELECT n, tok, count(*) AS freq FROM good GROUP BY ALL),
    tops AS (SELECT line_id, list(tok ORDER BY freq DESC, pos)[1:3] AS top FROM (SELECT line_id, n, tok, min(pos) AS pos FROM good GROUP BY ALL) JOIN freqs USING (n, tok) GROUP BY line_id),
    r4 AS (SELECT line_id, n, coalesce(top, CAST([] AS VARCHAR[])) AS top FROM lines_ LEFT JOIN tops USING (line_id))"""


def _rounds(least: int) -> str:
    out = []
    for j in (3, 2, 1):
        out.append(f"""h{j} AS (SELECT line_id, n, top[1:{j}] AS c FROM r{j + 1} QUALIFY count(*) OVER (PARTITION BY n, top[1:{j}]) >= {least}),
            r{j} AS (SELECT * FROM r{j + 1} WHERE line_id NOT IN (SELECT line_id FROM h{j}))""")
    return ", ".join(out)


@query(f"""WITH {DOCS}, {_TOP_OF_LENGTH}, {_rounds(100)}, h AS (SELECT * FROM h3 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h1)
    SELECT line_id, CAST(n AS INT) AS n, array_to_string(c, ' ') AS cluster FROM h UNION ALL SELECT line_id, CAST(n AS INT), NULL FROM r1""")
def topk_cluster(spark, sf_dir):
    return cluster.topk_clusters(doc_lines(spark, sf_dir)).select("line_id", "n", F.array_join("cluster", " ").alias("cluster"))


_CONTENTS = f"u AS (SELECT content, count(*) AS cnt, min(line_id) AS first_line, {TOK.format('content')} AS t FROM docs GROUP BY content)"
_FREQ = f"""{_CONTENTS}, e AS (SELECT content, len(t) AS n, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM u),
    f AS (SELECT content, n, pos, tok, count(*) OVER (PARTITION BY n, pos, tok) AS freq FROM e)"""
_CLUSTERS = f"""{_FREQ}, h AS (SELECT content, n, freq, count(*) AS k FROM f GROUP BY ALL),
    m AS (SELECT content, n, max_by(freq, k * 1000000000 + freq) AS md, max(freq) AS mx FROM h GROUP BY content, n),
    ft AS (SELECT f.content, f.n, list(tok ORDER BY pos) AS feature FROM f JOIN m USING (content) WHERE f.freq = CASE WHEN md = 1 THEN mx ELSE md END GROUP BY f.content, f.n),
    cl AS (SELECT content, n, feature, dense_rank() OVER (ORDER BY n) - 1 AS cid1, dense_rank() OVER (ORDER BY n, feature) - 1 AS cid2 FROM ft)"""


@query(f"WITH {DOCS}, {_FREQ} SELECT CAST(n AS INT) AS n, CAST(pos AS INT) AS pos, tok, freq, count(*) AS contents FROM f GROUP BY ALL")
def positional_freq(spark, sf_dir):
    f = cluster.positional_frequency(cluster.distinct_contents(doc_lines(spark, sf_dir)))
    return f.groupBy("n", "pos", "tok", "freq").agg(F.count("*").alias("contents"))


@query(f"WITH {DOCS}, {_CLUSTERS} SELECT content, CAST(n AS INT) AS n, array_to_string(feature, ' ') AS feature FROM cl")
def positional_feature(spark, sf_dir):
    return cluster.features(doc_lines(spark, sf_dir)).select("content", "n", F.array_join("feature", " ").alias("feature"))


@query(f"WITH {DOCS}, {_CLUSTERS} SELECT content, CAST(cid1 AS INT) AS cid1, CAST(cid2 AS INT) AS cid2 FROM cl")
def positional_cluster(spark, sf_dir):
    return cluster.clusters(doc_lines(spark, sf_dir)).select("content", "cid1", "cid2")


@query(f"WITH {DOCS}, {_CLUSTERS} SELECT CAST(cid1 AS INT) AS cid1, CAST(cid2 AS INT) AS cid2, CAST(sum(cnt) AS BIGINT) AS lines, count(*) AS contents FROM cl JOIN u USING (content) GROUP BY ALL")
def cluster_sizes(spark, sf_dir):
    return cluster.clusters(doc_lines(spark, sf_dir)).groupBy("cid1", "cid2").agg(F.sum("cnt").alias("lines"), F.count("*").alias("contents"))


@query(f"""WITH {DOCS}, {_CLUSTERS}, s AS (SELECT cid1, cid2, CAST(sum(cnt) AS BIGINT) AS lines FROM cl JOIN u USING (content) GROUP BY ALL)
    SELECT CAST(cid1 AS INT) AS cid1, CAST(cid2 AS INT) AS cid2, lines AS "rows" FROM s QUALIFY row_number() OVER (PARTITION BY cid1 ORDER BY lines DESC, cid2) = 1""")
def largest_cluster_per_length(spark, sf_dir):
    return sampling.largest_clusters(cluster.clusters(doc_lines(spark, sf_dir)))


# ---- sampling -------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT content, min(line_id) AS line_id FROM docs GROUP BY content")
def dedup_first(spark, sf_dir):
    return sampling.first_seen(doc_lines(spark, sf_dir))


def _jac(a: str, b: str) -> str:
    return f"coalesce(CAST(len(list_intersect({a}, {b})) AS DOUBLE) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def _diverse_sql(n: int) -> str:
    out = [f"""pool AS (SELECT n AS g, content, first_line, t FROM (SELECT *, len(t) AS n FROM (SELECT content, min(line_id) AS first_line, {TOK.format('content')} AS t FROM lines GROUP BY content))),
        p1 AS (SELECT g, 1 AS pick, content, t FROM pool QUALIFY row_number() OVER (PARTITION BY g ORDER BY first_line) = 1)"""]
    for k in range(2, n + 1):
        low = "least(" + ", ".join(f"coalesce({_jac('pool.t', f'p{i}.t')}, 2)" for i in range(1, k)) + ")"
        joins = " ".join(f"LEFT JOIN p{i} USING (g)" for i in range(1, k))
        gone = " AND ".join(f"pool.content <> p{i}.content" for i in range(1, k))
        out.append(f"p{k} AS (SELECT g, {k} AS pick, pool.content, pool.t FROM pool {joins} WHERE {gone} QUALIFY row_number() OVER (PARTITION BY g ORDER BY {low}, first_line) = 1)")
    return ", ".join(out)


@query(f"WITH {LINES}, {_diverse_sql(3)} SELECT CAST(g AS INT) AS cid2, pick, content FROM p1 UNION ALL BY NAME SELECT CAST(g AS INT) AS cid2, pick, content FROM p2 UNION ALL BY NAME SELECT CAST(g AS INT) AS cid2, pick, content FROM p3")
def diverse_sample(spark, sf_dir):
    c = cluster.distinct_contents(event_lines(spark, sf_dir)).select(F.col("n").alias("cid2"), "content", "first_line")
    return sampling.diverse(c, 3)


@query(f"""WITH {LINES}, c AS (SELECT content, min(line_id) AS first_line, {TOK.format('content')} AS t FROM lines GROUP BY content),
    a AS (SELECT len(t) AS g, content, t FROM c QUALIFY row_number() OVER (PARTITION BY len(t) ORDER BY first_line) = 1)
    SELECT CAST(g AS INT) AS cid2, c.content, CAST(len(list_intersect(c.t, a.t)) AS INT) AS shared FROM c JOIN a ON len(c.t) = a.g WHERE c.content <> a.content
    QUALIFY row_number() OVER (PARTITION BY g ORDER BY len(list_intersect(c.t, a.t)) DESC, first_line) <= 5""")
def shared_word_topk(spark, sf_dir):
    c = cluster.distinct_contents(event_lines(spark, sf_dir)).select(F.col("n").alias("cid2"), "content", "first_line")
    return sampling.most_shared(c, 5)


@query(f"""WITH {LINES} SELECT line_id, CAST(CASE WHEN regexp_matches(replace(content, '<*>', ''), '[^ A-Za-z!]') THEN 5
    WHEN len({TOK.format('content')}) <= 5 THEN 1 ELSE 5 END AS INT) AS n FROM lines""")
def adaptive_sample_size(spark, sf_dir):
    return event_lines(spark, sf_dir).select("line_id", X.sample_size(F.col("content"), 5).alias("n"))


# ---- similarities: each line with the one before it of the same event type --------------------

_PAIRS = f"""p AS (SELECT line_id, content AS a, lag(content) OVER (PARTITION BY truth ORDER BY line_id) AS b FROM lines),
    pt AS (SELECT line_id, a, b, {TOK.format('a')} AS ta, {TOK.format('b')} AS tb FROM p WHERE b IS NOT NULL)"""


def _pairs(spark, sf_dir):
    w = Window.partitionBy("truth").orderBy("line_id")
    p = event_lines(spark, sf_dir).select("line_id", F.col("content").alias("a"), F.lag("content").over(w).alias("b")).where("b is not null")
    return p.withColumns({"ta": X.tokens(F.col("a")), "tb": X.tokens(F.col("b"))})


_INTER, _UNION = "len(list_intersect(ta, tb))", "len(list_distinct(list_concat(ta, tb)))"


def _pair_query(name: str, column: Callable, sql: str):
    def run(spark, sf_dir):
        p = _pairs(spark, sf_dir)
        return p.select("line_id", column(F.col("ta"), F.col("tb")).alias("v"))

    run.__name__ = name
    query(f"WITH {LINES}, {_PAIRS} SELECT line_id, {sql} AS v FROM pt")(run)


_pair_query("jaccard_pairs", lambda a, b: F.round(X.jaccard(a, b), 9), f"round(CAST({_INTER} AS DOUBLE) / {_UNION}, 9)")
_pair_query("jaccard_smoothed", lambda a, b: F.round(X.jaccard_smoothed(a, b), 9), f"round(({_INTER} + 1e-5) / ({_UNION} + 1e-5), 9)")
_pair_query(
    "jaccard_weighted", lambda a, b: F.round(X.jaccard_weighted(a, b), 9),
    f"round(CAST({_INTER} AS DOUBLE) / {_UNION} * (len(ta) * len(tb) / 400.0) * (len(ta) * len(tb) / 400.0), 9)",
)
_GOOD = "list_filter({}, w -> NOT (regexp_matches(w, '\\p{{Nd}}') AND regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[^\\p{{L}}\\p{{N}}_]')))"
_pair_query(
    "jaccard_masked", lambda a, b: F.round(X.jaccard(X.good_words(a), X.good_words(b)), 9),
    f"round(CAST(len(list_intersect({_GOOD.format('ta')}, {_GOOD.format('tb')})) AS DOUBLE) / len(list_distinct(list_concat({_GOOD.format('ta')}, {_GOOD.format('tb')}))), 9)",
)
_pair_query("hamming_words", lambda a, b: X.hamming_words(a, b), "CASE WHEN len(ta) = len(tb) THEN CAST(len(list_filter(list_zip(ta, tb), z -> z[1] <> z[2])) AS INT) END")
_pair_query("edit_words", lambda a, b: X.edit_words(a, b), """CAST(levenshtein(
    array_to_string(list_transform(ta, w -> chr(CAST(list_position(list_distinct(list_concat(ta, tb)), w) + 191 AS INT))), ''),
    array_to_string(list_transform(tb, w -> chr(CAST(list_position(list_distinct(list_concat(ta, tb)), w) + 191 AS INT))), '')) AS INT)""")


@query(f"""WITH {LINES}, {_PAIRS} SELECT line_id, a[1:(SELECT count(*) FROM range(1, least(length(a), length(b)) + 1) r(i) WHERE a[1:i] = b[1:i])] AS v FROM pt""")
def common_prefix(spark, sf_dir):
    return _pairs(spark, sf_dir).select("line_id", X.common_prefix(F.col("a"), F.col("b")).alias("v"))


@query(f"""WITH {LINES}, {_PAIRS}, r AS (SELECT line_id, reverse(a) AS a, reverse(b) AS b FROM pt)
    SELECT line_id, reverse(a[1:(SELECT count(*) FROM range(1, least(length(a), length(b)) + 1) q(i) WHERE a[1:i] = b[1:i])]) AS v FROM r""")
def common_suffix(spark, sf_dir):
    return _pairs(spark, sf_dir).select("line_id", X.common_suffix(F.col("a"), F.col("b")).alias("v"))


@query()
def lcs_words(spark, sf_dir):
    """Longest common word subsequence and run; dynamic programming in Arrow batches."""
    from .functions import rules

    def run(batches):
        for b in batches:
            rows = list(zip(b["a"], b["b"]))
            yield b[["line_id"]].assign(
                subsequence=[" ".join(rules.lcs(x.split(), y.split())) for x, y in rows], run=[" ".join(rules.lcs_run(x.split(), y.split())) for x, y in rows]
            )

    return _pairs(spark, sf_dir).select("line_id", "a", "b").mapInPandas(run, "line_id long, subsequence string, run string")


_SPLIT_CLASS = "".join("\\" + ("''" if c == "'" else c) for c in X.SPLITTERS)
_SPLIT_GONE = "".join("\\" + ("''" if c == "'" else c) for c in X.SPLITTERS if c not in X.STAYING)
_SPLIT = f"""list_filter(list_transform(regexp_extract_all({{}}, '([^\\s{_SPLIT_CLASS}]+|[\\s{_SPLIT_CLASS}]+)', 1),
    t -> CASE WHEN contains(t, '<*>') THEN '<*>' ELSE regexp_replace(t, '[\\s{_SPLIT_GONE}]', '', 'g') END), t -> t <> '')""".replace("{}", "\u00a7")


def _split_sql(c: str) -> str:
    return _SPLIT.replace("\u00a7", c)


@query(f"""WITH {LINES}, w AS (SELECT line_id, {_split_sql(_MASKED)} AS p FROM lines)
    SELECT line_id, array_to_string(list_filter(p, (t, i) -> NOT (t = '<*>' AND i > 1 AND coalesce(p[i - 1], '') = '<*>')), '|') AS parts FROM w""")
def message_split(spark, sf_dir):
    return _masked(spark, sf_dir).select("line_id", F.array_join(X.split_message(F.col("content")), "|").alias("parts"))


# ---- templates ------------------------------------------------------------------------------

# Placeholders put into event lines, so that the correction chain has work.
_DIRTY = "regexp_replace(replace(replace(content, 'item ', 'item \"{id}\" '), 'user ', 'user 0x1f '), 'page', '{a}:{b}, {c} {d} page')"
_TC = T.DELIMITERS.replace("\\s", "\\s")


def _dirty():
    c = F.replace(F.replace("content", F.lit("item "), F.lit('item "{id}" ')), F.lit("user "), F.lit("user 0x1f "))
    return F.regexp_replace(c, "page", "{a}:{b}, {c} {d} page")


def _chain_sql(t: str) -> str:
    """The correction chain for RE2: rules with a following space are applied twice."""
    w = "<\\*>"
    sub = lambda s, p, r: f"regexp_replace({s}, '{p}', '{r}', 'g')"
    parts = f"regexp_extract_all(trim(regexp_replace({t}, '\\s+', ' ', 'g')), '([^\\s,!;:=|\"''\\[\\](){{}}.\\-+@#$%&]+|[\\s,!;:=|\"''\\[\\](){{}}.\\-+@#$%&])', 1)"
    token = f"CASE WHEN regexp_full_match(x, '[0-9]+') OR regexp_matches(x, '^0x[0-9a-fA-F]+') THEN '<*>' ELSE regexp_replace(regexp_replace(x, '(0x)+{w}', '<*>', 'g'), '^[^\\s/]+{w}[^\\s/]+$', '<*>') END"
    s = f"array_to_string(list_transform({parts}, x -> {token}), '')"
    s = sub(s, f"({w})[^()\\[\\]{{}},.:<>#$/\"''\\s]*", "\\1")
    for c in ("\\.", ""):
        s = sub(s, f"{w}({c}{w})+", "<*>")
    for _ in range(2):
        s = f"replace(replace({s}, ' #<*># ', ' <*> '), ' #<*> ', ' <*> ')"
    for c in (":", "#", "/", "@", "\\."):
        s = sub(s, f"{w}({c}{w})+", "<*>")
    for _ in range(2):
        s = f"replace(replace({s}, '\"<*>\"', '<*>'), '''<*>''', '<*>')"
    s = sub(s, f"{w}({w})+", "<*>")
    s = f"replace(replace({s}, '( <*>, <*>)', '(<*>, <*>)'), '`', '')"
    for _ in range(2):
        s = f"replace(replace({s}, ' <*>. ', ' <*> '), ' <*>, ', ' <*> ')"
    for c in ("\\+", "##"):
        s = sub(s, f"{w}({c}{w})+", "<*>")
    s = f"replace({s}, '#<*>#', '<*>')"
    s = sub(s, f"{w}(-{w})+", "<*>")
    for _ in range(4):
        s = f"replace({s}, ' <*> <*> ', ' <*> ')"
    s = sub(s, f"( {w}){{2,}}$", " <*>")
    s = sub(s, f"^{w} ({w} )+", "<*> ")
    s = sub(s, f"{w}(,{w})+", "<*>")
    s = f"replace({s}, '(<*> <*>)', '(<*>)')"
    for _ in range(2):
        s = f"replace({s}, ' /<*> ', ' <*> ')"
    s = sub(s, f" /{w}$", " <*>")
    return f"(SELECT CASE WHEN (length(z) - length(replace(z, '=<*>', ''))) / 4 >= 3 THEN replace(z, '= ', '=<*> ') ELSE z END FROM (SELECT {s} AS z))"


_PLACED = "regexp_replace({}, '\\{{[A-Za-z0-9_\\-]+\\}}', '<*>', 'g')"


@query(f"WITH {LINES}, d AS (SELECT line_id, {_PLACED.format(_DIRTY)} AS c FROM lines) SELECT line_id, {_chain_sql('c')} AS template FROM d")
def correct_template(spark, sf_dir):
    return event_lines(spark, sf_dir).select("line_id", T.corrected(T.placeholders(_dirty())).alias("template"))


_GENERAL = "regexp_replace(replace({}, '<*>', ''), '[\\s!-/:-@\\[-`{{-~]', '', 'g') = ''"


@query(f"""WITH {LINES}, d AS (SELECT line_id, regexp_replace(content, '[A-Za-z]+', CASE WHEN line_id % 2 = 0 THEN '<*>' ELSE 'w' END, 'g') AS c FROM lines)
    SELECT line_id, {_GENERAL.format(_chain_sql('c'))} AS too_general FROM d""")
def too_general_filter(spark, sf_dir):
    c = F.when(F.col("line_id") % 2 == 0, F.regexp_replace("content", "[A-Za-z]+", "<*>")).otherwise(F.regexp_replace("content", "[A-Za-z]+", "w"))
    return event_lines(spark, sf_dir).select("line_id", T.too_general(T.corrected(c)).alias("too_general"))


@query(f"""WITH {LINES}, d AS (SELECT line_id, repeat('<*> ', CAST(line_id % 60 AS INT)) AS t FROM lines)
    SELECT line_id, t <> '' AND (length(t) - length(replace(t, '<*>', ''))) / 3 <= 50 AS valid FROM d""")
def validate_template(spark, sf_dir):
    t = F.repeat(F.lit("<*> "), (F.col("line_id") % 60).cast("int"))
    return event_lines(spark, sf_dir).select("line_id", T.valid(t).alias("valid"))


_ORACLE_CHAIN = """regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all(array_to_string(list_transform(
    regexp_extract_all(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '([^\\s,!;:=|"''\\[\\](){{}}]+|[\\s,!;:=|"''\\[\\](){{}}])', 1),
    w -> CASE WHEN regexp_matches(w, '^(/[^/]+)+$') THEN '<*>' ELSE w END), ''),
    '([^\\s,!;:=|"''\\[\\](){{}}.\\-+@#$%&]+|[\\s,!;:=|"''\\[\\](){{}}.\\-+@#$%&])', 1),
    x -> CASE WHEN lower(x) IN ('true', 'false', 'null', 'root', 'admin') OR regexp_full_match(x, '[0-9]+') THEN '<*>' ELSE regexp_replace(x, '^[^\\s/]*<\\*>[^\\s/]*$', '<*>') END), ''),
    '<\\*>(\\.<\\*>)+', '<*>', 'g'), '<\\*>(<\\*>)+', '<*>', 'g')"""


@query(f"WITH {LINES} SELECT line_id, {_ORACLE_CHAIN.format('content')} AS template FROM lines")
def correct_oracle_template(spark, sf_dir):
    return event_lines(spark, sf_dir).select("line_id", T.corrected_for_oracle(F.col("content")).alias("template"))


@query(f"""WITH {LINES}, d AS (SELECT DISTINCT truth FROM lines), i AS (SELECT 'E' || row_number() OVER (ORDER BY truth) AS id, regexp_replace(truth, '(user|item) <\\*>', '<*>', 'g') AS t FROM d),
    c AS (SELECT id, {_ORACLE_CHAIN.format('t')} AS corrected FROM i) SELECT corrected, min(id) AS id, count(*) AS merged FROM c GROUP BY corrected""")
def correct_id_groups(spark, sf_dir):
    """Ids whose corrected templates coincide; the lowest id by text wins."""
    d = event_lines(spark, sf_dir).select("truth").distinct()
    i = d.select(F.concat(F.lit("E"), F.row_number().over(Window.orderBy("truth"))).alias("id"), F.regexp_replace("truth", r"(user|item) <\*>", "<*>").alias("t"))
    return i.withColumn("corrected", T.corrected_for_oracle(F.col("t"))).groupBy("corrected").agg(F.min("id").alias("id"), F.count("*").alias("merged"))


_PATTERN = "'^' || replace(regexp_replace({}, '([\\\\.\\[\\]{{}}()*+?^$|])', '\\\\\\1', 'g'), '<\\*>', '.*') || '$'"
_KNOWN = "known AS (SELECT DISTINCT truth AS template, len(string_split(truth, ' ')) AS n FROM lines)"


@query(f"""WITH {LINES}, {_KNOWN} SELECT template, count(*) AS lines FROM lines JOIN known ON len({TOK.format('content')}) = n AND regexp_matches(content, {_PATTERN.format('template')}) GROUP BY template""")
def template_match(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    known = lines.select(F.col("truth").alias("template")).distinct().withColumn("n", F.size(X.tokens(F.col("template"))))
    c = cluster.distinct_contents(lines)
    hit = c.join(F.broadcast(known), "n").where(T.matches(F.col("content"), F.col("template")))
    return hit.groupBy("template").agg(F.sum("cnt").alias("lines"))


_SEQ = "seqs AS (SELECT template, n, row_number() OVER (ORDER BY template) AS seq FROM known)"
_FIRST = f"first_match AS (SELECT line_id, content, min_by(template, seq) AS template FROM lines JOIN seqs ON len({TOK.format('content')}) = n AND regexp_matches(content, {_PATTERN.format('template')}) GROUP BY ALL)"


def _known(lines):
    t = lines.select(F.col("truth").alias("template")).distinct()
    return t.select("template", F.size(X.tokens(F.col("template"))).alias("n"), F.row_number().over(Window.orderBy("template")).alias("seq"))


@query(f"WITH {LINES}, {_KNOWN}, {_SEQ}, {_FIRST} SELECT line_id, template FROM first_match")
def template_first_match(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    found = assign.first_match(cluster.distinct_contents(lines), _known(lines))
    return lines.join(found, "content").select("line_id", "template")


@query(f"""WITH {LINES}, {_KNOWN}, {_SEQ}, s AS (SELECT * FROM seqs WHERE seq > 2)
    SELECT DISTINCT content FROM lines WHERE NOT EXISTS (SELECT 1 FROM s WHERE len({TOK.format('content')}) = n AND regexp_matches(content, {_PATTERN.format('template')}))""")
def unparsed_anti(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    c = cluster.distinct_contents(lines)
    return assign.unmatched(c, assign.first_match(c, _known(lines).where("seq > 2"))).select("content")


@query(f"""WITH {LINES}, d AS (SELECT line_id, content, CASE line_id % 4 WHEN 0 THEN truth WHEN 1 THEN 'x' || truth WHEN 2 THEN truth || 'x' ELSE regexp_replace(truth, '(item|user)', '\\1 zz', 'g') END AS t FROM lines),
    k AS (SELECT *, string_split(t, '<*>') AS p FROM d)
    SELECT line_id, CASE WHEN regexp_matches(content, {_PATTERN.format('t')}) THEN true ELSE false END AS ok FROM k""")
def template_diagnose_ok(spark, sf_dir):
    return template_diagnose(spark, sf_dir).select("line_id", (F.col("why") == "ok").alias("ok"))


@query()
def template_diagnose(spark, sf_dir):
    """Why a template doesn't match: wrong start, first missing piece, or trailing text."""
    t = F.when(F.col("line_id") % 4 == 0, F.col("truth")).when(F.col("line_id") % 4 == 1, F.concat(F.lit("x"), "truth"))
    t = t.when(F.col("line_id") % 4 == 2, F.concat("truth", F.lit("x"))).otherwise(F.regexp_replace("truth", "(item|user)", "$1 zz"))
    return event_lines(spark, sf_dir).select("line_id", T.diagnosis(F.col("content"), t).alias("why"))


@query(f"""WITH {LINES}, d AS (SELECT line_id, content, '^' || regexp_replace(replace(regexp_replace(truth, '([\\\\.\\[\\]{{}}()*+?^$|])', '\\\\\\1', 'g'), '<\\*>', '(.*?)'), ' +', '\\\\s+', 'g') || '$' AS p,
        (length(truth) - length(replace(truth, '<*>', ''))) / 3 AS n FROM lines)
    SELECT line_id, CASE WHEN n >= 3 THEN concat(regexp_extract(content, p || '|()()()()', 1), '|', regexp_extract(content, p || '|()()()()', 2), '|', regexp_extract(content, p || '|()()()()', 3))
        WHEN n >= 2 THEN concat(regexp_extract(content, p || '|()()()()', 1), '|', regexp_extract(content, p || '|()()()()', 2)) ELSE regexp_extract(content, p || '|()()()()', 1) END AS params FROM d""")
def template_params(spark, sf_dir):
    return event_lines(spark, sf_dir).select("line_id", F.array_join(T.parameters(F.col("content"), F.col("truth")), "|").alias("params"))


@query(f"""WITH {LINES}, d AS (SELECT DISTINCT truth AS t FROM lines UNION SELECT DISTINCT replace(truth, 'item', '<*>') FROM lines)
    SELECT x.t AS x, y.t AS y FROM d x JOIN d y ON x.t <> y.t AND regexp_matches(y.t, '^' || regexp_replace(replace(regexp_replace(x.t, '([\\\\.\\[\\]{{}}()*+?^$|])', '\\\\\\1', 'g'), '<\\*>', '(\\S+?)'), ' +', '\\\\s+', 'g') || '$')""")
def is_abstract(spark, sf_dir):
    lines = event_lines(spark, sf_dir).select("truth").distinct()
    d = lines.select(F.col("truth").alias("t")).union(lines.select(F.replace("truth", F.lit("item"), F.lit("<*>")))).distinct()
    x, y = d.select(F.col("t").alias("x"), F.size(X.tokens(F.col("t"))).alias("n")), d.select(F.col("t").alias("y"), F.size(X.tokens(F.col("t"))).alias("n"))
    # a wildcard is a run of non-space, so both have as many tokens
    return x.join(y, "n").where((F.col("x") != F.col("y")) & T.more_abstract(F.col("x"), F.col("y"))).select("x", "y")


@query()
def template_merge_pairs(spark, sf_dir):
    """Known templates merged with variants that have one constant in a wildcard's place."""
    lines = event_lines(spark, sf_dir).select("truth").distinct()
    new = lines.select(F.col("truth").alias("new"))
    known = lines.select(F.regexp_replace("truth", r"^(\S+ )<\*>", "$1x").alias("known"), F.size(X.tokens(F.col("truth"))).alias("n"))
    p = new.withColumn("n", F.size(X.tokens(F.col("new")))).join(known, "n")
    return p.select("new", "known", T.merged(F.col("new"), F.col("known")).alias("merged"))


@query("""WITH a AS (SELECT o_custkey, list(o_orderkey) AS x FROM orders GROUP BY 1),
        b AS (SELECT o_custkey, list(l_partkey) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))), ',') AS ids FROM a FULL JOIN b USING (o_custkey)""")
def sorted_index_merge(spark, sf_dir):
    """Two lists of numbers of a customer, its orders and the parts in them, as one sorted set."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(o, "o_orderkey")
    a = o.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("x"))
    b = parts.groupBy("o_custkey").agg(F.collect_list("l_partkey").alias("y"))
    none = F.array().cast("array<bigint>")
    both = F.array_union(F.coalesce("x", none), F.coalesce("y", none))
    return a.join(b, "o_custkey", "full").select("o_custkey", F.array_join(F.array_sort(both), ",").alias("ids"))


# ---- proposer replies -------------------------------------------------------------------------

_REPLY = "concat('LogTemplate[1]: `', truth, '`', chr(10), 'LogTemplate[2]: `', content, '`', chr(10), 'LogTemplate[3]: `', truth, '`')"


@query(f"""WITH {LINES}, r AS (SELECT line_id, {_REPLY} AS reply FROM lines),
    e AS (SELECT line_id, regexp_extract_all(reply, 'LogTemplate\\[(\\d+)\\]: `([^`]*)`', 1) AS i, regexp_extract_all(reply, 'LogTemplate\\[(\\d+)\\]: `([^`]*)`', 2) AS t FROM r)
    SELECT line_id, CAST(unnest(i) AS INT) AS idx, unnest(t) AS template FROM e""")
def reply_extract(spark, sf_dir):
    p = F.lit(r"LogTemplate\[(\d+)\]: `([^`]*)`")
    reply = event_lines(spark, sf_dir).select("line_id", F.expr(_REPLY.replace("chr(10)", "'\\n'")).alias("reply"))
    z = F.arrays_zip(F.regexp_extract_all("reply", p, F.lit(1)).alias("i"), F.regexp_extract_all("reply", p, F.lit(2)).alias("t"))
    return reply.select("line_id", F.explode(z).alias("z")).select("line_id", F.col("z.i").cast("int").alias("idx"), F.col("z.t").alias("template"))


@query(f"""WITH {LINES}, v AS (SELECT truth AS g, content AS t, count(*) AS c, min(line_id) AS f FROM lines GROUP BY ALL)
    SELECT g, t AS template FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY c DESC, f) = 1""")
def majority_vote(spark, sf_dir):
    v = event_lines(spark, sf_dir).groupBy(F.col("truth").alias("g"), F.col("content").alias("t")).agg(F.count("*").alias("c"), F.min("line_id").alias("f"))
    return v.groupBy("g").agg(F.min_by("t", F.struct((-F.col("c")).alias("less"), "f")).alias("template"))


# ---- numbering --------------------------------------------------------------------------------

_IDS = "ids AS (SELECT truth, 'E' || row_number() OVER (ORDER BY min(line_id)) AS event_id FROM lines GROUP BY truth)"


@query(f"WITH {LINES}, {_IDS} SELECT line_id, event_id FROM lines JOIN ids USING (truth)")
def event_id_numbering(spark, sf_dir):
    return assign.numbered_events(event_lines(spark, sf_dir).withColumnRenamed("truth", "template")).select("line_id", "event_id")


@query(f"WITH {LINES}, {_IDS} SELECT event_id, truth AS template, count(*) AS occurrences FROM lines JOIN ids USING (truth) GROUP BY ALL")
def template_catalog(spark, sf_dir):
    return assign.catalog(assign.numbered_events(event_lines(spark, sf_dir).withColumnRenamed("truth", "template")))


@query("""SELECT id, CAST(row_number() OVER (ORDER BY regexp_extract(id, '^\\D*', 0), CAST(regexp_extract(id, '(\\d+)', 1) AS INT)) AS INT) AS place
    FROM (SELECT DISTINCT concat(substr(p_brand, 1, 1), p_partkey % 200) AS id FROM part)""")
def natural_sort_templates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.substring("p_brand", 1, 1), (F.col("p_partkey") % 200).cast("string")).alias("id")).distinct()
    w = Window.orderBy(F.regexp_extract("id", r"^\D*", 0), F.regexp_extract("id", r"(\d+)", 1).cast("int"))
    return p.select("id", F.row_number().over(w).alias("place"))


# ---- metrics ----------------------------------------------------------------------------------

# A prediction that splits one event, merges two, and is right for the rest.
_PRED = "CASE WHEN truth LIKE 'user%items' AND line_id % 2 = 0 THEN content WHEN truth LIKE '%signup%' THEN 'user <*> viewed item <*>' ELSE truth END"
PAIRS = f"pairs AS (SELECT line_id, truth, {_PRED} AS pred FROM lines)"
_G = "g AS (SELECT truth, pred, c, sum(c) OVER (PARTITION BY truth) AS ct, sum(c) OVER (PARTITION BY pred) AS cp FROM (SELECT truth, pred, count(*) AS c FROM pairs GROUP BY ALL))"


def _pred(spark, sf_dir):
    return event_lines(spark, sf_dir).select("line_id", "truth", F.expr(_PRED).alias("pred"))


def _ga_sql(where: str = "") -> str:
    return f"""m AS (SELECT sum(CASE WHEN c = ct AND c = cp THEN c ELSE 0 END) / CAST(sum(c) AS DOUBLE) AS GA,
        sum(CASE WHEN c = ct AND c = cp THEN 1 ELSE 0 END) / CAST(count(DISTINCT pred) AS DOUBLE) AS PGA, sum(CASE WHEN c = ct AND c = cp THEN 1 ELSE 0 END) / CAST(count(DISTINCT truth) AS DOUBLE) AS RGA FROM g {where})"""


_FGA = 'CASE WHEN PGA + RGA > 0 THEN 2 * PGA * RGA / (PGA + RGA) ELSE 0.0 END AS "FGA"'


@query(f'WITH {LINES}, {PAIRS}, {_G}, {_ga_sql()} SELECT round("GA", 9) AS "GA" FROM m')
def ga(spark, sf_dir):
    return metrics.grouping(_pred(spark, sf_dir)).select(F.round("GA", 9).alias("GA"))


@query(f'WITH {LINES}, {PAIRS}, {_G}, {_ga_sql()} SELECT PGA AS "PGA", RGA AS "RGA", {_FGA} FROM m')
def fga(spark, sf_dir):
    return metrics.grouping(_pred(spark, sf_dir)).select("PGA", "RGA", "FGA")


@query(f'WITH {LINES}, {PAIRS} SELECT avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS "PA" FROM pairs')
def pa(spark, sf_dir):
    return metrics.parsing(_pred(spark, sf_dir))


_TA = """p AS (SELECT pred, min(truth) AS lo, max(truth) AS hi FROM pairs GROUP BY pred),
    ta AS (SELECT count(*) AS identified_templates, (SELECT count(DISTINCT truth) FROM pairs) AS ground_templates, sum(CASE WHEN lo = pred AND hi = pred THEN 1.0 ELSE 0.0 END) AS r FROM p)"""


@query(f"""WITH {LINES}, {PAIRS}, {_TA} SELECT identified_templates, ground_templates, CAST(r AS DOUBLE) / identified_templates AS "PTA", CAST(r AS DOUBLE) / ground_templates AS "RTA",
    round(2 * (CAST(r AS DOUBLE) / identified_templates) * (CAST(r AS DOUBLE) / ground_templates) / (CAST(r AS DOUBLE) / identified_templates + CAST(r AS DOUBLE) / ground_templates), 9) AS "FTA" FROM ta""")
def pta_rta_fta(spark, sf_dir):
    return metrics.templates(_pred(spark, sf_dir)).withColumn("FTA", F.round("FTA", 9))


_WILD = "(length(truth) - length(replace(truth, '<*>', ''))) / 3"


@query(f"""WITH {LINES}, {PAIRS}, {_G}, {_ga_sql(f'WHERE {_WILD} BETWEEN 1 AND 4')} SELECT round("GA", 9) AS "GA", PGA AS "PGA", RGA AS "RGA" FROM m""")
def filtered_metrics_complex(spark, sf_dir):
    pairs = _pred(spark, sf_dir)
    keep = metrics.of_complexity(pairs.select("truth").distinct(), 2)
    return metrics.grouping(pairs, keep).select(F.round("GA", 9).alias("GA"), "PGA", "RGA")


@query(f"""WITH {LINES}, {PAIRS}, {_G}, o AS (SELECT truth, count(*) AS occurrences FROM lines GROUP BY truth), f AS (SELECT truth FROM o QUALIFY row_number() OVER (ORDER BY occurrences, truth) <= 3),
    {_ga_sql('WHERE truth IN (SELECT truth FROM f)')} SELECT round("GA", 9) AS "GA", PGA AS "PGA", RGA AS "RGA" FROM m""")
def filtered_metrics_frequent(spark, sf_dir):
    pairs = _pred(spark, sf_dir)
    counts = pairs.groupBy("truth").agg(F.count("*").alias("occurrences"))
    return metrics.grouping(pairs, metrics.of_frequency(counts, 60)).select(F.round("GA", 9).alias("GA"), "PGA", "RGA")


# Metric rows of seven "datasets": orders by priority, twice, so that first runs count.
_RUNS = "r AS (SELECT o_orderpriority AS \"Dataset\", CAST(o_orderkey AS BIGINT) AS run, " + ", ".join(f"(o_orderkey * {k}) % 1000 / 1000.0 AS \"{m}\"" for k, m in zip((3, 7, 11, 13, 17, 19), metrics.METRICS)) + " FROM orders)"
_MS = ", ".join(f'"{m}"' for m in metrics.METRICS)
_ONCE = f'once AS (SELECT "Dataset", {_MS} FROM r QUALIFY row_number() OVER (PARTITION BY "Dataset" ORDER BY run) = 1)'


def _runs(spark, sf_dir):
    cols = [((F.col("o_orderkey") * k) % 1000 / 1000.0).alias(m) for k, m in zip((3, 7, 11, 13, 17, 19), metrics.METRICS)]
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("Dataset"), F.col("o_orderkey").alias("run"), *cols)


@query(f"WITH {_RUNS}, {_ONCE} SELECT \"Dataset\", " + ", ".join(f'CAST("{m}" AS DOUBLE) AS "{m}"' for m in metrics.METRICS) + " FROM once UNION ALL SELECT 'Average', " + ", ".join(f'round(avg("{m}"), 3)' for m in metrics.METRICS) + " FROM once")
def metric_average(spark, sf_dir):
    return metrics.averages(_runs(spark, sf_dir))


@query(f"WITH {_RUNS}, {_ONCE} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, \"Dataset\", CAST(\"{m}\" AS DOUBLE) AS \"value\" FROM once" for m in metrics.METRICS))
def metric_transpose(spark, sf_dir):
    w = Window.partitionBy("Dataset").orderBy("run")
    once = _runs(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r = 1")
    return metrics.transposed(once.select("Dataset", *metrics.METRICS))


# ---- smaller functions --------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT line_id, regexp_replace(concat(content, ' 0x', lower(hex(CAST(line_id AS VARCHAR)))), '0x[0-9a-fA-F]+', '<*>', 'g') AS masked FROM lines")
def replace_hex(spark, sf_dir):
    t = F.concat("content", F.lit(" 0x"), F.lower(F.hex(F.col("line_id").cast("string"))))
    return event_lines(spark, sf_dir).select("line_id", X.replace_hex(t).alias("masked"))


_COMMON = "url"
for _p in X.COMMON_PARAMETERS:
    _COMMON = f"regexp_replace({_COMMON}, '{_p}', '<*>', 'g')"


@query(f"SELECT page_id, {_COMMON} AS masked FROM pages")
def mask_common(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.mask_common(F.col("url")).alias("masked"))


@query(f"WITH {LINES} SELECT line_id, regexp_matches(replace(content, '<*>', ''), '[^ A-Za-z!]') AS looks FROM lines")
def variable_looking(spark, sf_dir):
    return event_lines(spark, sf_dir).select("line_id", X.variable_looking(F.col("content")).alias("looks"))


@query(f"""WITH {LINES}, t AS (SELECT line_id, {TOK.format('content')} AS a, {TOK.format('truth')} AS b FROM lines)
    SELECT line_id, (contains(b[1], '<*>') OR a[1] = b[1]) AND (contains(b[-1], '<*>') OR a[-1] = b[-1]) AS ends, len(list_filter(b, x -> NOT contains(x, '<*>') AND NOT list_contains(a, x))) = 0 AS constants FROM t""")
def template_prefilters(spark, sf_dir):
    return event_lines(spark, sf_dir).select("line_id", T.ends_agree(F.col("content"), F.col("truth")).alias("ends"), T.constants_within(F.col("content"), F.col("truth")).alias("constants"))


@query(f"""WITH {LINES}, w AS (SELECT line_id, truth, {_split_sql('truth')} AS p FROM lines), d AS (SELECT truth, min(line_id) AS f, any_value(list_filter(p, (t, i) -> NOT (t = '<*>' AND i > 1 AND coalesce(p[i - 1], '') = '<*>'))) AS p FROM w GROUP BY truth)
    SELECT x.truth AS a, y.truth AS b, round(CAST(len(list_intersect(x.p, y.p)) AS DOUBLE) / (len(x.p) + len(y.p) - len(list_intersect(x.p, y.p))), 9) AS v FROM d x JOIN d y ON x.f < y.f""")
def template_similarity(spark, sf_dir):
    """All pairs of the few distinct templates of event lines, joined on the order of first lines."""
    d = event_lines(spark, sf_dir).groupBy("truth").agg(F.min("line_id").alias("f"))
    x, y = d.select(F.col("truth").alias("a"), F.col("f").alias("fa")), d.select(F.col("truth").alias("b"), F.col("f").alias("fb"))
    return x.join(F.broadcast(y), F.col("fa") < F.col("fb")).select("a", "b", F.round(X.template_similarity(F.col("a"), F.col("b")), 9).alias("v"))


_pair_query("merge_test_combined", lambda a, b: T.mergeable(a, b), """len(ta) = len(tb) AND (len(list_filter(list_zip(ta, tb), z -> z[1] IS DISTINCT FROM z[2])) <= 1
    OR (len(list_filter(list_zip(ta, tb), z -> z[1] IS DISTINCT FROM z[2])) = 2 AND len(ta) > 10))""")
_pair_query("merge_test_simple", lambda a, b: T.mergeable_simply(a, b), "len(ta) = len(tb) AND CAST(len(list_filter(list_zip(ta, tb), z -> z[1] IS DISTINCT FROM z[2])) AS DOUBLE) / len(ta) < 0.2")
_pair_query("shared_words", lambda a, b: X.shared_words(a, b), f"CAST({_INTER} AS INT)")


@query()
def merge_test_distance(spark, sf_dir):
    return _pairs(spark, sf_dir).select("line_id", T.mergeable_by_distance(F.col("ta"), F.col("tb")).alias("v"))


_THREES = f"""n AS (SELECT truth, content, row_number() OVER (PARTITION BY truth ORDER BY line_id) AS r FROM lines), g AS (SELECT truth, (r - 1) // 3 AS k, list(content ORDER BY r) AS l FROM n GROUP BY ALL HAVING count(*) = 3),
    t AS (SELECT truth, k, {TOK.format('l[1]')} AS a, {TOK.format('l[2]')} AS b, {TOK.format('l[3]')} AS c FROM g),
    s AS (SELECT truth, k, {_jac('a', 'b')} AS x, {_jac('a', 'c')} AS y, {_jac('b', 'c')} AS z FROM t)"""


@query(f"""WITH {LINES}, {_THREES} SELECT truth, k, round(0.5 * (x + y + z) / 3 + 0.5 * 2 * (abs(x - y) + abs(x - z) + abs(y - z)) / 9, 9) AS every_pair, round(0.5 * (x + y) / 2 + 0.5 * 2 * abs(x - y) / 4, 9) AS to_first FROM s""")
def lcu_score(spark, sf_dir):
    """Spread scores of consecutive threes of lines of an event."""
    w = Window.partitionBy("truth").orderBy("line_id")
    n = event_lines(spark, sf_dir).withColumn("r", F.row_number().over(w) - 1)
    g = n.groupBy("truth", F.expr("cast(r div 3 as bigint)").alias("k")).agg(F.sort_array(F.collect_list(F.struct("r", "content"))).alias("l")).where(F.size("l") == 3)
    g = g.withColumn("l", F.transform("l", lambda x: x["content"]))
    score = lambda first: F.round(X.spread_score(X.similarities(F.col("l"), first)), 9)
    return g.select("truth", "k", score(False).alias("every_pair"), score(True).alias("to_first"))


@query("SELECT o_custkey, array_to_string(list_transform(range(7), i -> x[1 + i % len(x)]), ',') AS padded FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS x FROM orders GROUP BY 1)")
def list_padding(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("x"))
    return o.select("o_custkey", F.array_join(X.padded(F.col("x"), 7), ",").alias("padded"))


@query(f"""WITH {LINES}, d AS (SELECT truth AS g, line_id, content, row_number() OVER (PARTITION BY truth ORDER BY line_id) AS idx FROM lines), f AS (SELECT g, idx, 'T' || idx AS template FROM d WHERE idx % 3 = 2)
    SELECT d.g AS "group", CAST(d.idx AS INT) AS idx, coalesce(f.template, 'T2', d.content) AS template FROM d LEFT JOIN f ON d.g = f.g AND d.idx = f.idx""")
def reply_fill_missing(spark, sf_dir):
    from .plans.propose import fill_missing

    w = Window.partitionBy("truth").orderBy("line_id")
    d = event_lines(spark, sf_dir).select(F.col("truth").alias("group"), F.row_number().over(w).alias("idx"), F.col("content").alias("log"))
    found = d.where("idx % 3 = 2").select("group", "idx", F.concat(F.lit("T"), F.col("idx").cast("string")).alias("template"))
    return fill_missing(d, found)


@query(f"WITH {LINES} SELECT truth AS g, CAST(count(DISTINCT content) AS DOUBLE) / count(*) >= 0.8 AS again FROM lines GROUP BY 1")
def requery_test(spark, sf_dir):
    return event_lines(spark, sf_dir).groupBy(F.col("truth").alias("g")).agg((F.countDistinct("content") / F.count("*") >= 0.8).alias("again"))


@query(f"WITH {LINES} SELECT DISTINCT truth AS template, CAST(length(truth) AS INT) AS n FROM lines ORDER BY n DESC, template")
def sort_templates(spark, sf_dir):
    return event_lines(spark, sf_dir).select(F.col("truth").alias("template"), F.length("truth").alias("n")).distinct().orderBy(F.col("n").desc(), "template")


@query("SELECT 'none' AS \"Dataset\", CAST(NULL AS BIGINT) AS identified_templates, CAST(NULL AS BIGINT) AS ground_templates, " + ", ".join(f'CAST(NULL AS DOUBLE) AS "{m}"' for m in metrics.METRICS))
def missing_result_row(spark, sf_dir):
    return metrics.missing(spark, "none")


# ---- whole plans --------------------------------------------------------------------------------


_BATCH = f"""{_CLUSTERS.replace('FROM docs', 'FROM masked')}, tk AS (SELECT cid2, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM cl JOIN u USING (content)),
    ag AS (SELECT cid2, pos, CASE WHEN min(tok) = max(tok) THEN min(tok) ELSE '<*>' END AS tok FROM tk GROUP BY ALL),
    co AS (SELECT cid2, string_agg(tok, ' ' ORDER BY pos) AS c FROM ag GROUP BY cid2),
    fi AS (SELECT n, cid2, sum(cnt) AS rows_, min_by(content, first_line) AS f FROM cl JOIN u USING (content) GROUP BY ALL),
    ok AS (SELECT n, cid2, rows_, f, {_chain_sql('c')} AS ct, {_chain_sql('f')} AS fc FROM fi JOIN co USING (cid2)),
    tp AS (SELECT n, row_number() OVER (ORDER BY rows_ DESC, cid2) AS seq, CASE WHEN NOT ({_GENERAL.format('ct')}) AND (length(ct) - length(replace(ct, '<*>', ''))) / 3 <= 50 THEN ct WHEN NOT ({_GENERAL.format('fc')}) THEN fc ELSE f END AS template FROM ok),
    hit AS (SELECT content, min_by(template, seq) AS template FROM cl JOIN tp USING (n) WHERE regexp_matches(content, {_PATTERN.format('template')})
        AND (contains(string_split(template, ' ')[1], '<*>') OR string_split(template, ' ')[1] = string_split(content, ' ')[1])
        AND (contains(string_split(template, ' ')[-1], '<*>') OR string_split(template, ' ')[-1] = string_split(content, ' ')[-1]) GROUP BY content)"""


@query(f"""WITH {LINES}, masked AS (SELECT line_id, {_MASKED} AS content, content AS raw FROM lines), {_BATCH}
    SELECT coalesce(template, content) AS template, count(*) AS lines, min(line_id) AS first_line FROM masked LEFT JOIN hit USING (content) GROUP BY 1""")
def parse_batch(spark, sf_dir):
    """Flagship: event lines masked, clustered, agreed, corrected, assigned and counted."""
    out = parse.batch(event_lines(spark, sf_dir), MASKS)
    return out.groupBy("template").agg(F.count("*").alias("lines"), F.min("line_id").alias("first_line"))


@query()
def parse_batch_unmasked(spark, sf_dir):
    out = parse.batch(event_lines(spark, sf_dir))
    return out.groupBy("template").agg(F.count("*").alias("lines"), F.min("line_id").alias("first_line"))


@query()
def parse_sequential(spark, sf_dir):
    out = parse.sequential(event_lines(spark, sf_dir), MASKS)
    return out.groupBy("template").agg(F.count("*").alias("lines"), F.min("line_id").alias("first_line"))


@query()
def parse_and_score(spark, sf_dir):
    """The batch parse of event lines scored against their known templates."""
    lines = event_lines(spark, sf_dir)
    found = parse.batch(lines, MASKS).select("line_id", F.col("template").alias("pred"))
    return metrics.summary(lines.join(found, "line_id").select("line_id", "truth", "pred"), "events")
