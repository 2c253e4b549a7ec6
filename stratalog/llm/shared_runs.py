"""Exact repeats of word windows wherever they stand, across lines and inside paragraphs.

A window is 51 words in a row of a document, the same but for case of A-Z and white space; so
every passage of over 50 words that two places share holds one. Windows are gathered under the
smallest 16-word digit within them (their anchor), and neighbours of one anchor are one row
with the hash of all words they cover (their context), as in ``suffix_dedup``. Anchors whose
digit occurs once end here; windows of a context that occurs twice are all repeated; where
contexts of a digit differ, one occurrence of each gives its windows as rows of their own.
Every pass is an aggregate and an equi-join, so no digit is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, connected_components, cut, mix64, release
from .substring_dedup import _chunks, _keyed, words_of

WINDOW = 51
DIGIT = 16
_LOW = np.uint64((1 << 32) - 1)


class _Words(Rolling):
    """Hashes of runs of words from the hashes of the words."""

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        self._grow(len(hashes))
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=out[1:])
        return out


def _joined(texts, first: int, size: int, rolling: Rolling):
    """Words of some texts: starts and ends in their text, hashes, text, and each text's first word."""
    parts = [texts[i].as_buffer() for i in range(first, first + size)]
    begins = np.cumsum([0] + [p.size + 1 for p in parts])
    starts, ends, hashes, _ = words_of(np.frombuffer(b"\n".join(parts), np.uint8), rolling)
    own = np.searchsorted(begins, starts, "right") - 1
    return starts - begins[own], ends - begins[own], hashes, own, np.searchsorted(own, np.arange(size))


def anchors(hashes: np.ndarray, own: np.ndarray, words: _Words, window: int = WINDOW, digit: int = DIGIT):
    """(first, last, digit hash, context hash) arrays: windows first..last share an anchor and a text."""
    n = len(hashes) - window + 1
    prefix = words.prefix(hashes)
    kh = mix64(words.windows(prefix, digit))
    m = (kh & ~_LOW) | np.arange(len(kh), dtype=np.uint64)
    width, span = window - digit + 1, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[:n], m[width - span : width - span + n])
    a = (m & _LOW).astype(np.int64)
    inside = own[:n] == own[window - 1 :]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (own[1:n] != own[: n - 1]) | (inside[1:] != inside[:-1])]))
    last = np.concatenate([first[1:], [n]]) - 1
    first, last = first[inside[first]], last[inside[first]]
    shape = ((a[first] - first) * 1024 + (last - first)).astype(np.uint64)
    return first, last, kh[a[first]], mix64(words.spans(prefix, first, last + window) + mix64(shape + np.uint64(1)))


def _find(window: int):
    def run(batches):
        rolling, words = Rolling(9, fold_case=True), _Words()
        for b in batches:
            for first, size in _chunks(pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False)):
                starts, ends, hashes, own, base = _joined(b.column(3), first, size, rolling)
                if len(hashes) < window:
                    continue
                lo, hi, d, c = anchors(hashes, own, words, window, min(DIGIT, window))
                at = pa.array(first + own[lo])
                lengths = [lo - base[own[lo]], hi - base[own[lo]], starts[lo], ends[hi + window - 1]]
                cols = [pa.array(d.view(np.int64)), pa.array(c.view(np.int64)), *(b.column(k).take(at) for k in range(3)), *(pa.array(x.astype(np.int32)) for x in lengths)]
                yield pa.RecordBatch.from_arrays(cols, ["d", "c", "k1", "k2", "id", "lo", "hi", "from", "to"])

    return run


def _windows(window: int):
    """Every window of the asked runs as a row: k1, k2, id, text, runs -> h, k1, k2, id, p, from, to, times, g."""

    def run(batches):
        rolling, words = Rolling(9, fold_case=True), _Words()
        for b in batches:
            counts = pc.list_value_length(b.column(4)).to_numpy(zero_copy_only=False)
            runs = b.column(4).flatten()
            lo, hi, times, g = (runs.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            edge = np.concatenate([[0], np.cumsum(counts)])
            for first, size in _chunks(pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False)):
                starts, ends, hashes, _, base = _joined(b.column(3), first, size, rolling)
                part = slice(edge[first], edge[first + size])
                row = np.repeat(np.arange(size), counts[first : first + size])
                many = (hi[part] - lo[part] + 1).astype(np.int64)
                before = np.cumsum(many) - many
                p = np.arange(many.sum()) + np.repeat(lo[part] - before, many)
                row = np.repeat(row, many)
                w = p + base[row]
                h = mix64(words.spans(words.prefix(hashes), w, w + window))
                at = pa.array(first + row)
                cols = [pa.array(h.view(np.int64)), *(b.column(k).take(at) for k in range(3)), *(pa.array(x.astype(np.int32)) for x in (p, starts[w], ends[w + window - 1], np.repeat(times[part], many))), pa.array(np.repeat(g[part], many))]
                yield pa.RecordBatch.from_arrays(cols, ["h", "k1", "k2", "id", "p", "from", "to", "times", "g"])

    return run


def _merged(window: int):
    """Maximal runs of windows of one kind: k1, k2, id, copies, hits -> rows of the result and their groups."""

    def run(batches):
        for b in batches:
            hits = b.column(4).flatten()
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(4)).to_numpy(zero_copy_only=False))
            lo, hi, start, end, later, g, f = (hits.field(k).to_numpy(zero_copy_only=False) for k in range(7))
            order = np.lexsort((lo, row))
            order = order[np.concatenate([[True], (np.diff(row[order]) != 0) | (np.diff(lo[order]) != 0)])]  # rows told apart by nothing
            row, lo, hi, start, end, later, g, f = (x[order] for x in (row, lo, hi, start, end, later, g, f))
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] > hi[:-1] + 1) | (later[1:] != later[:-1])]))
            last = np.concatenate([first[1:], [len(row)]]) - 1
            at = pa.array(row[first])
            both = np.stack([g, f], 1).ravel()
            groups = pa.ListArray.from_arrays(pa.array(np.concatenate([2 * first, [len(both)]]).astype(np.int32)), pa.array(both))
            head = np.minimum.reduceat(both, 2 * first)
            cols = [*(b.column(k).take(at) for k in range(4)), pa.array(start[first].astype(np.int64)), pa.array(end[last].astype(np.int64)), pa.array((hi[last] - lo[first] + window).astype(np.int32)), pa.array(later[first]), pa.array(head), groups]
            yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "id", "copies", "lo", "hi", "n_words", "removed", "head", "groups"])

    return run


def shared_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``k1, k2, id, lo, hi, n_words, component, removed``: every maximal run of windows that
    are there twice or more; lo and hi are byte offsets.

    Of a window's occurrences the one with the smallest id (nulls first), then the first in the
    text, stays. A run is of windows that all go or all stay; a word goes if any window over it
    goes, so a run that stays loses the words it shares with a neighbour that goes, and every
    word that goes has an earlier copy. component is that of runs which share a window. Rows
    with equal id and text are told apart by nothing and keep their windows in all copies.
    """
    spark = docs.sparkSession
    src = _keyed(docs, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()
    scratch = Scratch(spark)
    shape = f"d long, c long, k1 long, k2 long, id {kind}, lo int, hi int, from int, to int"
    found = scratch.table(src.select("k1", "k2", "id", "text").mapInArrow(_find(window), shape), "found")
    digits = found.groupBy("d").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).where("n > 1")
    alive = scratch.table(found.join(digits.select("d", (F.col("c0") == F.col("c1")).alias("one")), "d").withColumn("g", F.xxhash64("d", "c")).drop("d", "c"), "anchors")
    scratch.drop(found)
    contexts = alive.groupBy("g", "one").agg(F.count("*").alias("n"), F.min(F.struct("id", "k1", "k2", "lo", "hi")).alias("w"))
    contexts = scratch.table(contexts.where("n > 1 or not one"), "contexts")
    first = (F.col("k1") == F.col("w.k1")) & (F.col("k2") == F.col("w.k2")) & (F.col("lo") == F.col("w.lo"))
    settled = alive.drop("one").join(contexts.where("n > 1"), "g").withColumn("later", ~first).where("one or later")
    asked = contexts.where("not one").groupBy(F.col("w.k1").alias("k1"), F.col("w.k2").alias("k2"))
    asked = asked.agg(F.collect_list(F.struct(F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"), F.when(F.col("n") > 1, 2).otherwise(1).alias("times"), "g")).alias("runs"))
    whole = src.join(asked, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "id", "text", "runs")
    single = scratch.table(whole.mapInArrow(_windows(window), f"h long, k1 long, k2 long, id {kind}, p int, from int, to int, times int, g long"), "windows")
    again = single.groupBy("h").agg(F.sum("times").alias("n"), F.min(F.struct("id", "k1", "k2", "p", "g")).alias("w")).where("n > 1")
    stays = (F.col("k1") == F.col("w.k1")) & (F.col("k2") == F.col("w.k2")) & (F.col("p") == F.col("w.p"))
    compared = single.join(again, "h").select("k1", "k2", "id", F.col("p").alias("lo"), F.col("p").alias("hi"), "from", "to", (~stays).alias("later"), "g", F.col("w.g").alias("f"))
    hits = settled.select("k1", "k2", "id", "lo", "hi", "from", "to", "later", "g", F.col("g").alias("f")).unionByName(compared)
    copies = src.groupBy("k1", "k2").agg(F.count("*").cast("int").alias("copies")).where("copies > 1")
    hits = hits.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.collect_list(F.struct("lo", "hi", "from", "to", "later", "g", "f")).alias("hits"))
    hits = hits.join(copies, ["k1", "k2"], "left").select("k1", "k2", "id", F.coalesce("copies", F.lit(1)).alias("copies"), "hits")
    runs = scratch.table(hits.mapInArrow(_merged(window), f"k1 long, k2 long, id {kind}, copies int, lo long, hi long, n_words int, removed boolean, head long, groups array<long>"), "runs")
    scratch.drop(alive, contexts, single)
    labels = connected_components(runs.select("head", F.explode("groups").alias("g")))
    named = runs.drop("groups").join(labels.withColumnRenamed("node", "head"), "head", "left")
    out = cut(named.select("k1", "k2", "id", "lo", "hi", "n_words", F.coalesce("label", "head").alias("component"), "removed", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy"))
    scratch.drop()
    release(spark)
    return out
