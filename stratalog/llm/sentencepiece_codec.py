"""SentencePiece-style encoding and decoding.

Unigram Viterbi: of all ways to write a text as vocabulary pieces, the one with the largest
sum of log scores. Pieces are looked up in a double-array trie over UTF-8 bytes. White-space
markers stand for spaces; characters without a piece fall back to one piece per byte. If no
piece has a marker after another character (checked on loading), the best path of a text is
the best paths of its marker-led words, so words are solved once and remembered.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
REMEMBER = 250_000


class DoubleArray:
    """Double-array trie: state s goes by byte c to base[s] + c + 1 if check there is s.
    value[s] is the piece that ends in s, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, v in keys.items():
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = v
        size = 4096
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        start = 1  # below it, slots are nearly all taken
        stack = [(tree, 0)]
        while stack:
            node, s = stack.pop()
            value[s] = node.get(-1, -1)
            labels = sorted(c for c in node if c >= 0)
            if not labels:
                continue
            first, span, slot, taken, tried = labels[0] + 1, labels[-1] - labels[0], max(start, labels[0] + 1), 0, 0
            while True:
                if slot + span >= len(check):
                    more = len(check) + span
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                tried += 1
                if check[slot] != -1:
                    taken += 1
                elif all(check[slot + c + 1 - first] == -1 for c in labels):
                    break
                slot += 1
            if tried > 32 and taken >= 0.9 * tried:
                start = slot
            elif tried > 512:
                start += tried // 4
            at = slot - first
            base[s] = at
            for c in labels:
                check[at + c + 1] = s
                stack.append((node[c], at + c + 1))
        self.base, self.check, self.value = base, check, value


class Codec:
    """Encoder and decoder of one vocabulary. ``pieces`` are (piece, score, kind) in id order,
    kind one of normal, byte, other."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.score = [s for _, s, _ in pieces]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        if len(self.byte_id) != 256:
            raise ValueError("the vocabulary has no full byte fallback")
        normal = {p: i for i, (p, _, k) in enumerate(pieces) if k == "normal" and p}
        self.trie = DoubleArray({p.encode(): i for p, i in normal.items()})
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in normal)
        pairs = {p[k : k + 2] for p in normal for k in range(len(p) - 1)}
        self.pairs = pairs
        self.unknown = min((self.score[i] for i in normal.values()), default=0.0) - 10.0
        self.out = [b"" if k == "other" else bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.bytes_from = np.array([k == "byte" for _, _, k in pieces])
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, model: bytes) -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        kind = lambda i: "byte" if sp.IsByte(i) else "other" if sp.IsControl(i) or sp.IsUnknown(i) or sp.IsUnused(i) else "normal"
        return cls([(sp.IdToPiece(i), sp.GetScore(i), kind(i)) for i in range(sp.GetPieceSize())])

    def viterbi(self, text: str) -> tuple[int, ...]:
        """Best path over ``text``, in which spaces are markers already; ``\\0`` stands for a
        literal marker and goes to bytes. Of equal sums the path whose last piece is longest
        wins, from the end backwards."""
        data = text.encode("utf-8", "surrogatepass")
        n = len(data)
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        size = len(check)
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            c = data[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            single, here, state, end = False, best[i], 0, i
            while end < n and c:
                t = base[state] + data[end] + 1
                if t >= size or check[t] != state:
                    break
                state = t
                end += 1
                piece = value[t]
                if piece >= 0:
                    if end == i + width:
                        single = True
                    s = here + score[piece]
                    if s > best[end]:
                        best[end] = s
                        back[end] = (i, piece)
            if not single and here + self.unknown > best[i + width]:
                best[i + width], back[i + width] = here + self.unknown, (i, -1)
            i += width
        ids: list[int] = []
        while n:
            i, piece = back[n]
            if piece >= 0:
                ids.append(piece)
            else:
                raw = data[i:n] if data[i] else MARK.encode()
                ids += [self.byte_id[c] for c in reversed(raw)]
            n = i
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        """Ids of a text. A marker is put before it, as before every word; a literal marker or
        NUL character is written in bytes, so decoding gives back exactly the text."""
        if not text:
            return []
        if MARK in text or "\0" in text:
            out: list[int] = []
            for k, part in enumerate(re.split(f"([{MARK}\0])", text)):
                if k % 2:
                    out += [self.byte_id[c] for c in part.encode()]
                elif part or k == 0:
                    out += self._plain((MARK if k == 0 else "") + part.replace(" ", MARK))
            return out
        return self._plain(MARK + text.replace(" ", MARK))

    def _plain(self, marked: str) -> list[int]:
        if not self.by_word:
            return list(self.viterbi(marked))
        out: list[int] = []
        known = self.known
        words = marked.split(MARK)
        run = ""
        first = words[0]
        if first:
            out += self._word(first)
        for w in words[1:]:
            run += MARK
            if w:
                key = run + w
                ids = known.get(key)
                out += ids if ids is not None else self._word(key)
                run = ""
        if run:
            out += self._word(run)
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None and (ids := self.older.get(word)) is not None:
            self._remember(word, ids)
        if ids is None:
            ids, at, pairs = (), 0, self.pairs
            for k in range(1, len(word)):  # no piece spans two characters that stand together in none
                if word[k - 1 : k + 1] not in pairs:
                    ids += self._part(word[at:k])
                    at = k
            ids += self._part(word[at:])
            self._remember(word, ids)
        return ids

    def _part(self, part: str) -> tuple[int, ...]:
        ids = self.known.get(part)
        if ids is None:
            ids = self.older.get(part)
            if ids is None:
                ids = self.viterbi(part)
            self._remember(part, ids)
        return ids

    def _remember(self, word: str, ids: tuple[int, ...]) -> None:
        if len(word) <= 64:
            if len(self.known) >= REMEMBER:
                self.older, self.known = self.known, {}
            self.known[word] = ids

    def decode(self, ids) -> str:
        """The text of ids: bytes are joined, markers are spaces, the leading one is dropped."""
        return b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")[1:]


_CODECS: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = Codec.load(model)
    return _CODECS[key]


def read_model(path: str = MODEL) -> bytes:
    """The model file, read on the driver and sent to the executors; refuses over 64 MB."""
    with open(path, "rb") as f:
        data = f.read((64 << 20) + 1)
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is too large to broadcast")
    return data


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, summarise=None, schema: str = "ids array<int>") -> DataFrame:
    """``id`` and the ids of every row's whole text, in one pass without a shuffle.

    A null or empty text has no ids; repeated rows are encoded again; other columns are
    dropped; an empty table gives an empty result. ``summarise`` maps (codec, text, ids) to
    the columns of ``schema`` where ids themselves are not wanted.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches):
        c = codec(sent.value)
        for b in batches:
            if summarise is None:
                rows = [pa.array([c.encode(x.as_py() or "") for x in b.column(1)], pa.list_(pa.int32()))]
            else:
                got = [summarise(c, text := x.as_py() or "", c.encode(text)) for x in b.column(1)]
                rows = [pa.array(col, t) for col, t in zip(zip(*got), summarise.types)] if got else [pa.array([], t) for t in summarise.types]
            yield pa.RecordBatch.from_arrays([b.column(0), *rows], ["id", *names])

    names = [x.split()[0] for x in schema.split(", ")]
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, {schema}")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``id, text`` from ``id, ids``; null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_model(model))
    src = encoded.select("id", "ids")

    def run(batches):
        c = codec(sent.value)
        for b in batches:
            texts = [c.decode(x.as_py() or []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, text string")
