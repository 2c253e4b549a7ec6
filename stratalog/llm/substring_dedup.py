"""Substring dedup of paragraphs by MinHash banding.

Paragraphs (lines) of at least 50 words are units; below that, one word changed inside takes a
paragraph under a similarity of 0.8. Equal units (same words but for case of A-Z and white
space) form a class. Classes get 16 MinHash values of their five-word shingles in 8 bands of 2:
at similarity 0.8 a pair shares no band in 3 of 10,000 cases. Colliding classes are joined as
stars around the commonest class of a band and compared with it by exact Jaccard; of the others
in a band only those pairs are compared that share enough of what sets them apart from it, which
no similar pair lacks. Links are closed to components, of which the first occurrence stays.

What is repeated word by word but is no unit (inside a paragraph, or across lines) is found by
``shared_runs``, which takes every 51-word window of a text as a paragraph and bands it by one
MinHash; ``duplicate_passages`` has both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, connected_components, cut, mix64, release

SHINGLE = 5
MIN_WORDS = 50
BANDS, ROWS = 8, 2
SIMILARITY = 0.8
CHUNK = 1 << 16
TOGETHER = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(23)
_MULT = _RNG.integers(1, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(1, 2**64, BANDS * ROWS, dtype=np.uint64)
_STEPS = _RNG.integers(1, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)


def words_of(data: np.ndarray, rolling: Rolling):
    """Starts, ends and hashes of words, and for each the number of newlines before it."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), CHUNK):
        s, e = starts[i : i + CHUNK], ends[i : i + CHUNK]
        hashes[i : i + CHUNK] = mix64(rolling.spans(rolling.prefix(data[s[0] : e[-1]]), s - s[0], e - s[0]))
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    return starts, ends, hashes, line


def units_of(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after the last of every unit, from the line of every word."""
    lo = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    hi = np.concatenate([lo[1:], [len(line)]])
    keep = hi - lo >= MIN_WORDS
    return lo[keep], hi[keep]


def classes_of(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, rolling: Rolling) -> np.ndarray:
    """Class of every unit: hash of its words."""
    rolling._grow(len(hashes))
    run = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * rolling.up[: len(hashes)], out=run[1:])
    return mix64(rolling.spans(run, a, b) + (b - a).astype(np.uint64))


def band_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key for every unit and band."""
    n = len(hashes) - SHINGLE + 1
    sh = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        sh += hashes[j : j + n] * _STEPS[j]
    sh = mix64(sh)
    keys = np.empty((len(a), BANDS), np.uint64)
    last = b - SHINGLE + 1
    for band in range(BANDS):
        key = np.full(len(a), np.uint64(band + 1))
        for r in range(ROWS):
            k = band * ROWS + r
            v = (sh ^ _ADD[k]) * _MULT[k]
            v = v ^ (v >> np.uint64(32))
            pairs = np.empty(2 * len(a), np.int64)
            pairs[::2], pairs[1::2] = a, np.minimum(last, n - 1)
            low = np.minimum.reduceat(v, pairs)[::2]
            low = np.where(last > n - 1, np.minimum(low, v[n - 1]), low)
            key = mix64(key * _STEPS[1] + low)
        keys[:, band] = key
    return keys


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).select(
        F.xxhash64("id").alias("k1"), F.xxhash64("text").alias("k2"), "id", "text"
    )


def _chunks(sizes: np.ndarray):
    """(first row, rows) of runs of rows with about TOGETHER bytes; at least one row each."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > TOGETHER:
            yield first, i - first
            first, total = i, 0
        total += n
    if len(sizes):
        yield first, len(sizes) - first


def units(src: DataFrame) -> DataFrame:
    """``cls, k1, k2, id, lo, hi, n_words`` and band keys ``b0..`` of every unit. lo and hi are
    byte offsets."""
    kind = src.schema["id"].dataType.simpleString()
    schema = f"cls long, k1 long, k2 long, id {kind}, lo long, hi long, n_words int" + "".join(f", b{i} long" for i in range(BANDS))

    def run(batches):
        rolling = Rolling(9, fold_case=True)
        for b in batches:
            rows = []
            texts = b.column(3)
            for first, size in _chunks(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                parts = [texts[i].as_buffer() for i in range(first, first + size)]
                # units don't cross lines, so texts joined by line ends are searched at once
                begins = np.cumsum([0] + [p.size + 1 for p in parts])
                data = np.frombuffer(b"\n".join(parts), np.uint8)
                starts, ends, hashes, line = words_of(data, rolling)
                if len(starts) < MIN_WORDS:
                    continue
                x, y = units_of(line)
                if not len(x):
                    continue
                own = np.searchsorted(begins, starts[x], "right") - 1
                lo, hi = starts[x] - begins[own], ends[y - 1] - begins[own]
                rows.append((first + own, classes_of(hashes, x, y, rolling), lo, hi, y - x, band_keys(hashes, x, y)))
            if not rows:
                continue
            ids = b.column(2)
            cat = lambda k: np.concatenate([r[k] for r in rows])
            at = cat(0)
            cols = [pa.array(cat(1).view(np.int64)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), ids.take(pa.array(at)), pa.array(cat(2)), pa.array(cat(3)), pa.array(cat(4).astype(np.int32))]
            keys = cat(5).view(np.int64)
            cols += [pa.array(np.ascontiguousarray(keys[:, j])) for j in range(BANDS)]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = [f.split()[0] for f in schema.split(", ")]
    return src.select("k1", "k2", "id", "text").mapInArrow(run, schema)


def _shingles(text: bytes) -> set:
    w = text.lower().split()
    return set(zip(*(w[j:] for j in range(SHINGLE))))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of ``a, b`` those whose exact Jaccard similarity is enough."""
    one = pairs.join(texts.select(F.col("cls").alias("a"), F.col("unit").alias("ta")), "a")
    two = one.join(texts.select(F.col("cls").alias("b"), F.col("unit").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            known: dict = {}
            for i, (x, y, tx, ty) in enumerate(zip(*(b.column(j).to_pylist() for j in range(4)))):
                sx = known.get(x) or known.setdefault(x, _shingles(tx))
                sy = known.get(y) or known.setdefault(y, _shingles(ty))
                both = len(sx & sy)
                keep[i] = both >= similarity * (len(sx) + len(sy) - both)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["a", "b"])

    return two.mapInArrow(run, "a long, b long")


def _compared(stars: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``cls, centre, linked, size, differ, apart``: exact similarity of members to their centre,
    the number of their shingles, and the number and hashes of the shingles that only one of
    both has."""
    one = stars.join(texts.select("cls", F.col("unit").alias("t")), "cls")
    two = one.join(texts.select(F.col("cls").alias("centre"), F.col("unit").alias("tc")), "centre").select("cls", "centre", "t", "tc")

    def run(batches):
        for b in batches:
            known: dict = {}
            linked, size, differ, apart = [], [], [], []
            for c, t, tc in zip(*(b.column(j).to_pylist() for j in (1, 2, 3))):
                sc = known.get(c) or known.setdefault(c, _shingles(tc))
                sx = _shingles(t)
                both = len(sx & sc)
                linked.append(both >= similarity * (len(sx) + len(sc) - both))
                size.append(len(sx))
                apart.append({xxhash.xxh32_intdigest(b" ".join(s)) >> 1 for s in sx ^ sc})
                differ.append(len(apart[-1]))
            cols = [pa.array(linked, pa.bool_()), pa.array(size, pa.int32()), pa.array(differ, pa.int32()), pa.array(map(list, apart), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["cls", "centre", "linked", "size", "differ", "apart"])

    return two.mapInArrow(run, "cls long, centre long, linked boolean, size int, differ int, apart array<int>")


def _among(compared: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: members of one centre that may be similar although one isn't similar to it.

    Let A and B be what sets the two apart from the centre. Similar sets of sizes x and y differ
    in at most d = (x + y) / 9 elements at 0.8, so A and B, of sizes p and q, have at least
    o = (p + q - d) / 2 common elements, of which there is one: one of the two differs from the
    centre by more than such sets do. In one order of all elements, the first common one then
    is among the first p - o + 1 of A and q - o + 1 of B. The order is by how many members of
    the centre have an element, rare ones first; an element of one member meets no other. So
    this join on (centre, element) loses no pair, and near copies with edits of their own don't
    meet.
    """
    spread = (1 - similarity) / (1 + similarity)
    odd = compared.groupBy("centre").agg(F.count("*").alias("n"), F.min("linked").alias("all")).where("n > 1 and not all").select("centre")
    own = ("centre", "cls", "linked", "size", "differ")
    rows = compared.join(odd, "centre").select(*own, F.explode("apart").alias("element"))
    times = rows.groupBy("centre", "element").agg(F.count("*").alias("times")).where("times > 1")
    common = rows.join(times, ["centre", "element"]).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("times", "element"))).alias("common"))
    alone = F.col("differ") - F.size("common")
    # similar sets are at most 1 / similarity times as large, so these are all that can be first
    first = F.floor(F.col("size") * F.lit((1 + 1 / similarity) * spread)) + 2 - alone
    rows = common.select(*own, alone.alias("alone"), F.slice("common", F.lit(1), F.greatest(first, F.lit(0)).cast("int")).alias("common"))
    rows = rows.select(*own, "alone", F.posexplode("common").alias("i", "e"))
    side = lambda k: rows.select("centre", F.col("e.element").alias("element"), (F.col("i") + F.col("alone")).alias(f"i_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in own[1:]))
    pairs = side("a").join(side("b"), ["centre", "element"]).where("cls_a < cls_b and not (linked_a and linked_b)")
    least = F.greatest((F.col("differ_a") + F.col("differ_b") - (F.col("size_a") + F.col("size_b")) * F.lit(spread)) / 2 - 1e-6, F.lit(1.0))
    early = (F.col("i_a") <= F.col("differ_a") - least) & (F.col("i_b") <= F.col("differ_b") - least)
    return pairs.where(early).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()


def duplicate_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``k1, k2, id, lo, hi, n_words, component, removed``: every occurrence of a unit that is
    there twice or more, exactly or nearly.

    component is the smallest class in it; the occurrence with the smallest id (nulls first),
    then the first in the text, stays. Rows with equal id and text are told apart by nothing
    and keep their units in all copies. Null and empty texts have no units; other columns are
    dropped; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    src = _keyed(docs, id_col, text_col)
    scratch = Scratch(spark)
    bands = [f"b{i}" for i in range(BANDS)]
    here = scratch.table(units(src), "units")
    first = F.min(F.struct("id", "k1", "k2", "lo", "hi")).alias("first")
    # copies of a class have one set of keys
    classes = scratch.table(here.groupBy("cls").agg(F.count("*").alias("copies"), first, *(F.min(b).alias(b) for b in bands)), "classes")
    owners = classes.select("cls", "copies", "first")
    banded = classes.select(F.explode(F.array(*bands)).alias("band"), "cls", "copies")
    # the centre of a band is the class with most copies
    centres = banded.groupBy("band").agg(F.count("*").alias("n"), F.max(F.struct("copies", "cls"))["cls"].alias("centre")).where("n > 1").drop("n")
    members = scratch.table(banded.join(centres, "band").select("cls", "centre"), "members")
    # texts of the classes that collide, each from its first occurrence
    asked = owners.join(members.select("cls").distinct(), "cls").groupBy(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
    asked = asked.agg(F.collect_list(F.struct("cls", F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi"))).alias("parts"))
    whole = src.select("k1", "k2", "text").join(asked, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    # cut inside the document's row, so that a text is not copied for each of its units
    part = F.transform("parts", lambda p: F.struct(p["cls"].alias("cls"), F.call_function("substring", "text", (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")).alias("unit")))
    texts = scratch.table(whole.select(F.inline(part)), "texts")
    release(spark)
    stars = members.where("cls <> centre").select("cls", "centre").distinct()
    compared = scratch.table(_compared(stars, texts, similarity), "compared")
    scratch.drop(members)
    pair = (F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b"))
    near = compared.where("linked").select(*pair)
    far = scratch.table(_among(compared, similarity).join(compared.select(*pair), ["a", "b"], "left_anti"), "far")
    labels = connected_components(near.unionByName(_verified(far, texts, similarity)))
    found = owners.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "copies", "first", F.coalesce("label", "cls").alias("component"))
    groups = found.groupBy("component").agg(F.sum("copies").alias("n"), F.min("first").alias("stays")).where("n > 1")
    known = found.join(groups, "component").select("cls", "component", "stays")
    stays = (F.col("k1") == F.col("stays.k1")) & (F.col("k2") == F.col("stays.k2")) & (F.col("lo") == F.col("stays.lo")) & (F.col("hi") == F.col("stays.hi"))
    out = cut(here.drop(*bands).join(known, "cls").select("k1", "k2", "id", "lo", "hi", "n_words", "component", (~stays).alias("removed")))
    scratch.drop()
    release(spark)
    return out


def duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``duplicate_units`` and, with components of their own, the ``shared_runs`` of words: exact
    repeats of over 50 words that stand anywhere. A passage that is both has two rows."""
    from .shared_runs import shared_runs

    # in this order the larger tables of the units are gone when the runs are made
    found = duplicate_units(docs, id_col, text_col, similarity)
    return found.unionByName(shared_runs(docs, id_col, text_col))


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the removed units and runs cut out of ``text_col``; all rows and columns stay, and
    a text that loses nothing is as it was. Columns ``_k1, _k2, _cuts`` are replaced."""
    gone = duplicate_passages(docs, id_col, text_col, similarity).where("removed").groupBy("k1", "k2")
    gone = cut(gone.agg(F.collect_list(F.struct("lo", "hi")).alias("_cuts")))
    docs = docs.drop("_k1", "_k2", "_cuts")
    keyed = docs.withColumns({"_k1": F.xxhash64(id_col), "_k2": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))})
    joined = keyed.join(gone.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), ["_k1", "_k2"], "left").select(*docs.columns, "_cuts")
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            out = b.column(at).to_pylist()
            for i, cuts in enumerate(b.column(len(docs_columns)).to_pylist()):
                if cuts and out[i]:
                    raw, kept, end = out[i].encode(), [], 0
                    for c in sorted(cuts, key=lambda c: c["lo"]):
                        kept.append(raw[end : max(end, c["lo"])])
                        end = max(end, c["hi"])
                    out[i] = b"".join([*kept, raw[end:]]).decode()
            cols = list(b.columns[: len(docs_columns)])
            cols[at] = pa.array(out, b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, docs_columns)

    docs_columns = docs.columns
    return joined.mapInArrow(run, docs.schema)
