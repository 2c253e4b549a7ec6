"""Benchmark decontamination by SimHash of item-sized windows.

A document window as long as an item is a leak if the weighted (multiset) Jaccard similarity
of their five-word shingles is at least 0.8. A window so similar shares a shingle with its item, so
windows are taken around every shingle that an item has; they and the items get 64-bit
fingerprints, multi-index Hamming blocks (8 blocks of 8 bits, up to two bits off in a block)
give all items within the radius, and the similarity itself is computed for those.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, mix64

SHINGLE = 5
RADIUS = 20
SIMILARITY = 0.8
BLOCK_BYTES = 16 << 20
BLOCKS, FLIPS = 8, 2
CHUNK = 1 << 16

_WORD = np.ones(256, bool)
_WORD[[c for c in range(128) if not chr(c).isalnum()]] = False
_STEPS = np.random.default_rng(11).integers(1, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of ASCII letters, digits and non-ASCII bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rolling: Rolling) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), CHUNK):
        s, e = starts[i : i + CHUNK], ends[i : i + CHUNK]
        prefix = rolling.prefix(data[s[0] : e[-1]])
        out[i : i + CHUNK] = mix64(rolling.spans(prefix, s - s[0], e - s[0]))
    return out


def shingle_hashes(words: np.ndarray, length: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``length`` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(length))
    for j in range(length):
        total += words[j : j + n] * _STEPS[j]
    return mix64(total)


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of shingles[s : s + count] for every start s."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:], dtype=np.int32)
    on = 2 * (sums[starts + count] - sums[starts]) > count
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()


class Items:
    """What a block of items needs for the search."""

    def __init__(self, rows: list[tuple[object, str | None]], radius: int = RADIUS, similarity: float = SIMILARITY):
        if radius >= BLOCKS * (FLIPS + 1):
            raise ValueError("the blocks do not guarantee this radius")
        self.rolling, self.radius, self.similarity = Rolling(5, fold_case=True), radius, similarity
        self.ids, self.length, self.size, self.bags, fps, hashes, owners = [], [], [], [], [], [], []
        for item, text in rows:
            words, h = self.words((text or "").encode())
            if not words:
                continue
            k = min(SHINGLE, len(words))
            sh = shingle_hashes(h, k)
            fps.append(window_fingerprints(sh, np.zeros(1, np.int64), len(sh))[0])
            hashes.append(np.unique(sh))
            owners.append(np.full(len(hashes[-1]), len(self.ids)))
            self.ids.append(item)
            self.length.append(len(words))
            self.size.append(len(sh))
            self.bags.append(Counter(zip(*(words[j:] for j in range(k)))))
        self.fp = np.array(fps, np.uint64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner = h[order], o[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash >> np.uint64(44)).astype(np.int64)] = True
        self.short = sorted({n for n in self.length if n < SHINGLE})
        byte = np.arange(256, dtype=np.uint8)
        parts = self.fp.view(np.uint8).reshape(-1, 8) if len(self.fp) else np.zeros((0, 8), np.uint8)
        self.near = [np.bitwise_count(byte[:, None] ^ parts[None, :, b]) <= FLIPS for b in range(BLOCKS)]

    def words(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        s, e = word_bounds(data)
        lower = text.lower()
        return [lower[i:j] for i, j in zip(s.tolist(), e.tolist())], word_hashes(data, s, e, self.rolling)

    def within(self, fps: np.ndarray):
        """(window, item) of all fingerprints within the radius."""
        parts = fps.view(np.uint8).reshape(-1, 8)
        some = np.zeros((len(fps), len(self.fp)), bool)
        for b in range(BLOCKS):
            some |= self.near[b][parts[:, b]]
        w, i = np.nonzero(some)
        close = np.bitwise_count(fps[w] ^ self.fp[i]) <= self.radius
        return w[close], i[close]

    def leaks(self, text: bytes) -> list[tuple[int, float, int, int]]:
        """(item number, similarity, first word, words) of the best window for each leaked item."""
        if not self.ids or not text:
            return []
        data = np.frombuffer(text, np.uint8)
        starts, ends = word_bounds(data)
        if not len(starts):
            return []
        hashes = word_hashes(data, starts, ends, self.rolling)
        found: dict[int, tuple[float, int, int]] = {}
        lower = None
        for k in (SHINGLE, *self.short):
            sh = shingle_hashes(hashes, k) if len(hashes) >= k or k < SHINGLE else shingle_hashes(hashes, len(hashes))
            maybe = np.flatnonzero(self.seen[(sh >> np.uint64(44)).astype(np.int64)])
            if not len(maybe):
                continue
            lo = np.searchsorted(self.hash, sh[maybe], "left")
            hi = np.searchsorted(self.hash, sh[maybe], "right")
            hits: dict[int, list[int]] = {}
            for p, x, y in zip(maybe.tolist(), lo.tolist(), hi.tolist()):
                for o in self.owner[x:y].tolist():
                    if (self.length[o] < SHINGLE) == (k < SHINGLE):
                        hits.setdefault(o, []).append(p)
            for item, places in hits.items():
                n = min(self.size[item], len(sh))
                top = len(sh) - n
                p = np.array(places)
                first, last = np.clip(p - n + 1, 0, top), np.clip(p, 0, top)
                mark = np.zeros(len(sh) + 2, np.int32)
                np.add.at(mark, first, 1)
                np.add.at(mark, last + 1, -1)
                at = np.flatnonzero(np.cumsum(mark)[: top + 1] > 0)
                base, end = int(at[0]), int(at[-1]) + n
                fps = np.concatenate([
                    window_fingerprints(sh[g[0] : g[-1] + n], g - g[0], n) for g in np.split(at, np.flatnonzero(np.diff(at) > n) + 1)
                ])
                w, i = self.within(fps)
                w = w[i == item]  # every other item has its own windows
                if not len(w):
                    continue
                hit = np.zeros(end - base + 1, np.int32)
                hit[p - base + 1] = 1
                most = np.cumsum(hit)
                bound = most[at[w] - base + n] - most[at[w] - base]
                for j in np.argsort(-bound, kind="stable"):
                    best = max(found.get(item, (0.0,))[0], self.similarity)
                    most_alike = bound[j] / (n + self.size[item] - bound[j])
                    if most_alike < best or (item in found and most_alike <= found[item][0]):
                        break
                    lower = lower or text.lower()
                    s = int(at[w[j]])
                    ws = [lower[x:y] for x, y in zip(starts[s : s + n + k - 1].tolist(), ends[s : s + n + k - 1].tolist())]
                    size = min(k, len(ws))
                    bag = Counter(zip(*(ws[q:] for q in range(size))))
                    both = sum((bag & self.bags[item]).values())
                    alike = both / (bag.total() + self.bags[item].total() - both)
                    if alike >= self.similarity and alike > found.get(item, (0.0,))[0]:
                        found[item] = (alike, s, len(ws))
        return [(i, *x) for i, x in sorted(found.items())]


def _blocks(items: DataFrame, item_col: str, item_text: str) -> tuple[DataFrame, int]:
    chosen = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return chosen, 1 + total // BLOCK_BYTES


def _sent(chosen: DataFrame, blocks: int, k: int):
    """Block k of the items, sent to the executors; about BLOCK_BYTES large."""
    part = chosen.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text")
    return chosen.sparkSession.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    radius: int = RADIUS, similarity: float = SIMILARITY,
) -> DataFrame:
    """``id, item, similarity, first_word, n_words``: a row per document and item leaked in it,
    with its most similar window (the first of equals).

    Items are taken in blocks of at most about 16 MB, which are sent to the executors, and
    every block is held against the whole texts of all rows in one pass without a shuffle.
    Case and ASCII punctuation don't count. An item or text shorter than five words is one
    shingle; a text shorter than an item is one window. Null and empty texts and items have no
    words and leak nothing; repeated rows are reported again; no items or rows give no rows.
    """
    chosen, blocks = _blocks(items, item_col, item_text)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((src, "id"), (chosen, "item"))]
    schema = f"id {kinds[0]}, item {kinds[1]}, similarity double, first_word long, n_words long"

    def search(rows):
        def run(batches):
            own = Items(rows.value, radius, similarity)
            for b in batches:
                got = [(b.column(0)[i], own.ids[k], *x) for i in range(b.num_rows) for k, *x in own.leaks(b.column(1)[i].as_py() or b"")]
                cols = list(zip(*got)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.as_py() for x in cols[0]], b.column(0).type), pa.array(cols[1], item_type), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    ["id", "item", "similarity", "first_word", "n_words"],
                )

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(chosen.schema["item"].dataType)
    out = None
    for k in range(blocks):
        rows = _sent(chosen, blocks, k)
        found = src.mapInArrow(search(rows), schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY
) -> DataFrame:
    """Rows of ``docs`` that leak no item, all columns kept; the same search as ``find_leaks``."""
    chosen, blocks = _blocks(items, item_col, item_text)
    at = docs.columns.index(text_col)

    def clean(rows):
        def run(batches):
            own = Items(rows.value, radius, similarity)
            for b in batches:
                keep = [not own.leaks((x.as_py() or "").encode()) for x in b.column(at)]
                yield b.filter(pa.array(keep, pa.bool_()))

        return run

    for k in range(blocks):
        docs = docs.mapInArrow(clean(_sent(chosen, blocks, k)), docs.schema)
    return docs
