"""Two-level clustering of lines, vocabulary and top-k token clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.lineage import cut, kept, release

# Words that say nothing about an event.
STOP_WORDS = (
    "a an and i ie so to the "
    "mon tue wed thu fri sat sun monday tuesday wednesday thursday friday saturday sunday "
    "jan feb mar apr may jun jul aug sep oct nov dec "
    "january february march april june july august september october november december"
).split()


def distinct_contents(lines: DataFrame) -> DataFrame:
    """``content, cnt, first_line, tokens, n``: work is done once per distinct content. Blank
    contents have no tokens and are left out."""
    d = lines.groupBy("content").agg(F.count("*").alias("cnt"), F.min("line_id").alias("first_line"))
    d = d.withColumn("tokens", tokens(F.col("content")))
    return d.withColumn("n", F.size("tokens")).where("n > 0")


def positional_frequency(contents: DataFrame) -> DataFrame:
    """``key, n, pos, tok, freq``: how many distinct contents of a length have a token at a
    position. The counts are hash aggregates, joined back. ``key`` is a content's 128-bit
    digest: a line's text isn't repeated for each of its tokens."""
    long = contents.select(_digest(), "n", F.posexplode("tokens").alias("pos", "tok"))
    freq = long.groupBy("n", "pos", "tok").agg(F.count("*").alias("freq"))
    return long.join(freq, ["n", "pos", "tok"]).select("key", "n", "pos", "tok", "freq")


def _digest() -> Column:
    return F.unhex(F.md5(F.col("content").cast("binary"))).alias("key")


def _chosen(freqs: DataFrame) -> DataFrame:
    """``key, feature`` from the rows of ``positional_frequency``."""
    per = freqs.groupBy("key", "n", "freq").agg(F.count("*").alias("k"), F.collect_list(F.struct("pos", "tok")).alias("at"))
    chosen = per.groupBy("key", "n").agg(
        F.max_by("freq", F.struct("k", "freq")).alias("mode"),
        F.max("freq").alias("top"),
        F.collect_list(F.struct("freq", "at")).alias("parts"),
    )
    want = F.when(F.col("mode") == 1, F.col("top")).otherwise(F.col("mode"))
    chosen = chosen.withColumn("want", want)
    at = F.flatten(F.transform(F.filter("parts", lambda p: p["freq"] == F.col("want")), lambda p: p["at"]))
    return chosen.select("key", F.transform(F.sort_array(at), lambda x: x["tok"]).alias("feature"))


def _features_of_large(lines: DataFrame) -> DataFrame:
    """Features where a length has too many lines for a task: tokens are counted by hash
    aggregates and joined back, so no length is gathered anywhere."""
    contents = cut(distinct_contents(lines))
    found = _chosen(positional_frequency(contents))
    return contents.select(_digest(), "content", "n", "cnt", "first_line").join(found, "key").select("content", "n", "feature", "cnt", "first_line")


def _commonest(freq: np.ndarray) -> np.ndarray:
    """Of every row the commonest number (ties: the larger; if it is 1: the largest number)."""
    s, place = np.sort(freq, axis=1), np.arange(freq.shape[1], dtype=np.int32)
    first = np.ones(s.shape, bool)
    first[:, 1:] = s[:, 1:] != s[:, :-1]
    run = place - np.maximum.accumulate(np.where(first, place, 0), axis=1)
    mode = s[np.arange(len(s)), len(place) - 1 - np.argmax(run[:, ::-1], axis=1)]
    return np.where(mode == 1, s[:, -1], mode)


def _of_length(lines: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of one length with their features. Words are numbers in a table of lines and
    positions; work on it is in blocks."""
    n = lines.column("n")[0].as_py()
    step, parts = max(1, BLOCK // n), []
    for at in range(0, len(lines), step):
        parts.append(pa.array([w for c in lines.column("content").slice(at, step).to_pylist() for w in c.split()], pa.string()))
    coded = pa.chunked_array(parts).dictionary_encode().unify_dictionaries()
    del parts
    words, codes = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in coded.chunks]).reshape(-1, n)
    del coded
    freq, wide = np.empty(codes.shape, np.int32), max(1, BLOCK // len(codes))
    for j in range(0, n, wide):
        part = codes[:, j : j + wide].astype(np.int64)
        part += np.arange(part.shape[1]) * len(words)
        _, back, count = np.unique(part.ravel(), return_inverse=True, return_counts=True)
        freq[:, j : j + wide] = count[back].reshape(part.shape)
    for at in range(0, len(codes), step):
        f = freq[at : at + step]
        chosen = f == _commonest(f)[:, None]
        ends = np.concatenate([[0], np.cumsum(chosen.sum(axis=1))]).astype(np.int32)
        feature = pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(codes[at : at + step][chosen])))
        rows = lines.slice(at, step).combine_chunks()
        own = {c: rows.column(c).combine_chunks() for c in ("content", "n", "cnt", "first_line")}
        yield pa.RecordBatch.from_arrays([own["content"], own["n"], feature, own["cnt"], own["first_line"]], ["content", "n", "feature", "cnt", "first_line"])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of rows in order of their length; one length at a time is held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        n = b.column("n").to_numpy()
        cuts = [0, *(np.flatnonzero(n[1:] != n[:-1]) + 1), len(n)] if len(n) else []
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column("n")[0].as_py() != n[lo]:
                yield from _of_length(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield from _of_length(pa.Table.from_batches(held))


def _features_of_small(lines: DataFrame) -> DataFrame:
    """Features of lengths that each fit a task: lines are dealt by their length once, and all
    else is done where they are."""
    d = lines.repartition("n").groupBy("n", "content").agg(F.count("*").alias("cnt"), F.min("line_id").alias("first_line"))
    kind = d.schema["first_line"].dataType.simpleString()
    return d.sortWithinPartitions("n").mapInArrow(_lengths, f"content string, n int, feature array<string>, cnt long, first_line {kind}")


def _by_size(lines: DataFrame, least: int, share: int, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """``line_id, content, n`` of the lines of small lengths and of large ones, None where there
    are none of large or only of large. A length is large with over ``least`` tokens that are
    over 1 / ``share`` of all, or with over ``most``. The lengths' sizes reach the driver, a
    number each."""
    d = lines.select("line_id", "content", F.size(tokens(F.col("content"))).alias("n")).where("n > 0")
    sizes = d.groupBy("n").agg((F.count("*") * F.col("n")).alias("k"))
    sizes = {row["n"]: row["k"] for row in sizes.collect()}
    limit = min(most, max(least, sum(sizes.values()) // share))
    large = [n for n, k in sizes.items() if k > limit]
    small = len(large) < len(sizes) or not sizes
    return d.where(~F.col("n").isin(large)) if small else None, d.where(F.col("n").isin(large)) if large else None


# Tokens of a length: as many, or this share of all, are one task's work, but never more than the
# last, which takes a few hundred MB of a Python worker. BLOCK: tokens that are sorted at once.
LEAST_TOKENS, SHARE, MOST_TOKENS = 1 << 20, 64, 1 << 23
BLOCK = 1 << 19


def features(lines: DataFrame, least: int = LEAST_TOKENS, share: int = SHARE, most: int = MOST_TOKENS) -> DataFrame:
    """``content, n, feature, cnt, first_line`` of ``lines`` (line_id, content): tokens whose
    frequency is the commonest in the line (ties: the larger; if it is 1: the largest frequency).
    Frequencies are those within a length, so lengths are dealt out whole where they are small."""
    small, large = _by_size(lines, least, share, most)
    if large is None:
        return _features_of_small(small)
    large = _features_of_large(large)
    return large if small is None else _features_of_small(small).unionByName(large)


def numbered(feature_rows: DataFrame) -> DataFrame:
    """``feature_rows`` with ``cid1, cid2``: ranks of lengths and of (length, feature). Features
    are ranked within their length and lengths carry an offset, so no task sees all of them."""
    groups = feature_rows.select("n", "feature").distinct()
    groups = groups.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy("feature")))
    lengths = groups.groupBy("n").agg(F.count("*").alias("k"))
    w = Window.orderBy("n")
    lengths = lengths.select(
        "n", (F.row_number().over(w) - 1).alias("cid1"), F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    ids = groups.join(F.broadcast(lengths), "n").select("n", "feature", "cid1", (F.col("before") + F.col("r") - 1).cast("int").alias("cid2"))
    return feature_rows.join(ids, ["n", "feature"])


def clusters(lines: DataFrame) -> DataFrame:
    """``content, n, feature, cid1, cid2, cnt, first_line`` of ``lines`` (line_id, content). The
    features are written once, as several steps read them."""
    rows = kept(features(lines))
    # only here nothing holds the features' plan, so that their shuffle files can go
    release(rows.sparkSession)
    return numbered(rows).select("content", "n", "feature", "cid1", "cid2", "cnt", "first_line")


def vocabulary(lines: DataFrame) -> DataFrame:
    """``tok, freq`` over all lines, without stop words and tokens of up to two characters."""
    t = lines.select(F.explode(tokens(F.col("content"))).alias("tok"))
    return t.where((F.length("tok") > 2) & ~F.lower("tok").isin(*STOP_WORDS)).groupBy("tok").agg(F.count("*").alias("freq"))


def top_tokens(lines: DataFrame, k: int) -> DataFrame:
    """``line_id, top``: the k commonest vocabulary tokens of a line, ties by place."""
    vocab = vocabulary(lines)
    long = lines.select("line_id", F.posexplode(tokens(F.col("content"))).alias("pos", "tok")).groupBy("line_id", "tok").agg(F.min("pos").alias("pos"))
    ranked = long.join(vocab, "tok").groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("freq")).alias("less"), "pos", "tok"))).alias("all"))
    return ranked.select("line_id", F.transform(F.slice("all", 1, k), lambda x: x["tok"]).alias("top"))


def topk_clusters(lines: DataFrame, k: int = 3, least: int = 100) -> DataFrame:
    """``line_id, n, cluster`` of the non-blank lines: within every token count n, groups by the
    k top tokens with at least ``least`` lines, then by k - 1 of what is left, and so on; the
    rest of a count is one cluster, the null one. The vocabulary is that of the count. Lines
    with fewer top tokens are grouped by those they have in every round."""
    t = lines.select("line_id", tokens(F.col("content")).alias("t")).withColumn("n", F.size("t")).where("n > 0")
    long = t.select("line_id", "n", F.posexplode("t").alias("pos", "tok")).where((F.length("tok") > 2) & ~F.lower("tok").isin(*STOP_WORDS))
    vocab = long.groupBy("n", "tok").agg(F.count("*").alias("freq"))
    once = long.groupBy("line_id", "n", "tok").agg(F.min("pos").alias("pos"))
    ranked = once.join(vocab, ["n", "tok"]).groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("freq")).alias("less"), "pos", "tok"))).alias("all"))
    top = F.transform(F.slice("all", 1, k), lambda x: x["tok"])
    rest = t.select("line_id", "n").join(ranked, "line_id", "left").select("line_id", "n", F.coalesce(top, F.array().cast("array<string>")).alias("top"))
    # the rounds are decided on the few distinct keys with their counts, not on lines
    keys = rest.groupBy("n", "top").agg(F.count("*").alias("c"))
    done = None
    for j in range(k, 0, -1):
        part = keys.withColumn("cluster", F.slice("top", 1, j))
        big = part.groupBy("n", "cluster").agg(F.sum("c").alias("lines")).where(F.col("lines") >= least).select("n", "cluster")
        hit = part.join(big, ["n", "cluster"]).select("n", "top", "cluster")
        done = hit if done is None else done.unionByName(hit)
        keys = keys.join(hit, ["n", "top"], "left_anti")
    return rest.join(done, ["n", "top"], "left").select("line_id", "n", "cluster")
