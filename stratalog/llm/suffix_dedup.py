"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart by most-significant-digit passes and only as deep as the threshold
(200 bytes): what is still in one group then starts the same 200-byte string, so groups of two
or more are exactly the repeated windows. Passes carry 64-bit digits instead of text:

1. Windows are gathered under the smallest 64-byte digit within them (their anchor). All
   windows of one anchor are neighbours, so an anchor occurrence is one row (lo, hi). Anchors
   whose digit occurs once hold no repeated window and end here.
2. Where all occurrences of a digit agree on everything their windows cover, all those windows
   are repeated. Where contexts differ, a context that occurs twice is settled likewise, and
   one occurrence of every context goes on.
3. Their windows are compared at full depth, one row per window start.

Each pass is a hash aggregate with map-side combining and an equi-join, which Spark can split
where a passage is hot; texts are joined by document only where windows or results are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, cut, mix64, release

THRESHOLD = 200
DIGIT = 64
PIECE = 1 << 17
MOST = 20_000
_LOW = np.uint64((1 << 18) - 1)


def anchors(data: np.ndarray, rolling: Rolling, depth: int = THRESHOLD, digit: int = DIGIT):
    """(lo, hi, digit hash, context hash) arrays: window starts lo..hi share an anchor."""
    n = len(data) - depth + 1
    width = depth - digit + 1
    for at in range(0, max(n, 0), PIECE):
        count = min(PIECE, n - at)
        seg = data[at : at + count + depth - 1]
        prefix = rolling.prefix(seg)
        kh = mix64(rolling.windows(prefix, digit))
        m = (kh & ~_LOW) | np.arange(len(kh), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        m = np.minimum(m[:count], m[width - span : width - span + count])
        a = (m & _LOW).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
        last = np.concatenate([first[1:], [count]]) - 1
        inside = ((a[first] - first) * 1024 + (last - first)).astype(np.uint64)
        context = mix64(rolling.spans(prefix, first, last + depth) + mix64(inside + np.uint64(1)))
        yield at + first, at + last, kh[a[first]], context


def window_hashes(data: np.ndarray, rolling: Rolling, lo: int, hi: int, depth: int = THRESHOLD) -> np.ndarray:
    """Hash of every window that starts at lo..hi."""
    return mix64(rolling.windows(rolling.prefix(data[lo : hi + depth]), depth))


def _keyed(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Rows with one id and one text share a key; what is repeated in one is in the other."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("text")).select(
        F.xxhash64("id").alias("k1"), F.xxhash64("text").alias("k2"), "id", "text"
    )


def _compare(batches):
    """Runs of repeated windows from packed rows in order of their digit; the rows of a batch's
    last digit wait for the next batch."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        d = t.column("d").to_numpy()
        full = int(np.searchsorted(d, d[-1])) if len(d) else 0
        held = t.slice(full)
        if full:
            yield from _repeated(t.slice(0, full))
    if held is not None and held.num_rows:
        yield from _repeated(held)


def _repeated(t: pa.Table):
    t = t.combine_chunks()
    cells = [x.as_py() for x in t.column("hashes")]
    sizes = np.array([len(x) // 8 for x in cells])
    h = np.frombuffer(b"".join(cells), np.uint64)
    row = np.repeat(np.arange(len(cells)), sizes)
    first = np.cumsum(sizes) - sizes
    times = t.column("times").to_numpy()[row]
    _, inverse = np.unique(h, return_inverse=True)
    hit = (np.bincount(inverse, weights=times)[inverse] > 1) & (times == 1)
    at = np.flatnonzero(hit)
    if not len(at):
        return
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
    begin, end = at[new], at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    own = row[begin]
    lo = t.column("lo").to_numpy()[own] - first[own]
    take = pa.array(own)
    yield pa.RecordBatch.from_arrays(
        [t.column("k1").combine_chunks().take(take), t.column("k2").combine_chunks().take(take), pa.array((lo + begin).astype(np.int32)), pa.array((lo + end).astype(np.int32))],
        ["k1", "k2", "lo", "hi"],
    )


def _unpacked(batches):
    for b in batches:
        for d, k1, k2, lo, times, _, hashes in zip(*(c.to_pylist() for c in b.columns)):
            h = np.frombuffer(hashes, np.int64)
            n = len(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(np.arange(lo, lo + n, dtype=np.int32)), pa.array(np.full(n, times, np.int32))],
                ["h", "k1", "k2", "p", "times"],
            )


def repeated_windows(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", depth: int = THRESHOLD, digit: int = DIGIT) -> DataFrame:
    """``k1, k2, lo, hi``: runs of starts of windows that start anywhere else, too; it reads
    tables of ``scratch``."""
    src = _keyed(docs, id_col, F.col(text_col))

    def find(batches):
        rolling = Rolling()
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i in range(b.num_rows):
                data = np.frombuffer(b.column(2)[i].as_buffer(), np.uint8)
                for lo, hi, kh, context in anchors(data, rolling, depth, digit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kh.view(np.int64)), pa.array(context.view(np.int64)), pa.array(np.full(len(lo), k1[i])), pa.array(np.full(len(lo), k2[i])), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                        ["d", "c", "k1", "k2", "lo", "hi"],
                    )

    def gathered(batches):
        held, rows = [], 0
        for b in find(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 20_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    found = src.select("k1", "k2", "text").where(F.octet_length("text") >= depth).mapInArrow(gathered, "d long, c long, k1 long, k2 long, lo int, hi int")

    # pass 1: digits that occur once end here
    digits = found.select("d", "c").groupBy("d").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).where("n > 1")
    alive = scratch.table(found.join(digits.select("d", (F.col("c0") == F.col("c1")).alias("one")), "d"), "anchors")

    # pass 2: contexts
    mixed = alive.where("not one")
    contexts = scratch.table(
        mixed.groupBy("d", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("w")), "contexts"
    )
    settled = alive.where("one").select("k1", "k2", "lo", "hi").unionByName(
        mixed.join(contexts.where("n > 1").select("d", "c"), ["d", "c"], "left_semi").select("k1", "k2", "lo", "hi")
    )

    # pass 3: windows of one occurrence of every context, packed in a row each
    many = contexts.groupBy("d").agg(F.count("*").alias("contexts")).where(F.col("contexts") > MOST).select("d", F.lit(True).alias("many"))
    asked = contexts.join(many, "d", "left").select("d", "w.*", (F.col("n") > 1).alias("twice"), F.coalesce("many", F.lit(False)).alias("many"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("d", "lo", "hi", "twice", "many")).alias("runs"))

    def windows(batches):
        rolling = Rolling()
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                data = np.frombuffer(b.column(2)[i].as_buffer(), np.uint8)
                k1, k2 = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                rows += [(r["d"], k1, k2, r["lo"], 1 + r["twice"], r["many"], window_hashes(data, rolling, r["lo"], r["hi"], depth).tobytes()) for r in b.column(3)[i].as_py()]
            for at in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 5000]), shape_types)], shape_names)

    shape = "d long, k1 long, k2 long, lo int, times int, many boolean, hashes binary"
    shape_names = [x.split()[0] for x in shape.split(", ")]
    shape_types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    packed = scratch.table(src.select("k1", "k2", "text").join(asked, ["k1", "k2"]).mapInArrow(windows, shape), "windows")
    release(docs.sparkSession)

    # equal windows share their digit, so a task compares the contexts of its digits as they come
    few = packed.where("not many").drop("many").repartition("d").sortWithinPartitions("d").mapInArrow(_compare, "k1 long, k2 long, lo int, hi int")

    # a digit with very many contexts is not gathered: its windows are rows of their own
    single = packed.where("many").mapInArrow(_unpacked, "h long, k1 long, k2 long, p int, times int")
    again = single.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1").select("h")
    rest = single.where("times = 1").join(again, "h", "left_semi").select("k1", "k2", F.col("p").alias("lo"), F.col("p").alias("hi"))
    rest = rest.unionByName(few)
    return settled.unionByName(rest)


def _merged(runs: DataFrame) -> DataFrame:
    """Every document's runs in order, those that touch as one."""

    def run(batches):
        for b in batches:
            out = []
            for cell in b.column(2):
                lo, hi = cell.values.field("lo").to_numpy(), cell.values.field("hi").to_numpy()
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.concatenate([[True], lo[1:] > hi[:-1] + 1])
                last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hi) - 1]])
                out.append([{"lo": int(x), "hi": int(y)} for x, y in zip(lo[new], hi[last])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], ["k1", "k2", "runs"])

    return runs.mapInArrow(run, "k1 long, k2 long, runs array<struct<lo:int,hi:int>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = THRESHOLD, digit: int = DIGIT) -> DataFrame:
    """``id, n_bytes, spans, kept`` of every row: the removed byte spans and what is left.

    A byte goes if a string of ``depth`` bytes that covers it also starts anywhere else, in the
    same document or another, overlaps included; strings are judged on the input. Null and
    empty texts have no bytes; texts shorter than ``depth`` stay whole; repeated rows repeat
    each other; other columns are dropped; an empty table gives an empty result.
    """
    src = _keyed(docs, id_col, F.col(text_col))
    scratch = Scratch(docs.sparkSession)
    found = repeated_windows(docs, scratch, id_col, text_col, depth, digit)
    runs = cut(_merged(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))))
    del found
    scratch.drop()
    release(docs.sparkSession)
    joined = src.join(runs, ["k1", "k2"], "left").select("id", "text", "runs")
    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def remove(batches):
        for b in batches:
            sizes, spans, kept = [], [], []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                sizes.append(len(text))
                cell = b.column(2)[i]
                if not cell.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                lo = cell.values.field("lo").to_numpy()
                hi = cell.values.field("hi").to_numpy() + depth
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.concatenate([[True], lo[1:] > hi[:-1]])
                lo, hi = lo[new], hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hi) - 1]])]
                spans.append([{"lo": int(x), "hi": int(y)} for x, y in zip(lo, hi)])
                ends = [0, *map(int, hi)]
                kept.append(b"".join(text[x:y] for x, y in zip(ends, [*map(int, lo), len(text)])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"]
            )

    kind = src.schema["id"].dataType.simpleString()
    return joined.mapInArrow(remove, f"id {kind}, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary")
