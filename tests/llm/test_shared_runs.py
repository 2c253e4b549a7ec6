"""Shared runs against a brute force over word windows."""

import collections
import random
import re

from stratalog.llm import shared_runs, substring_dedup

SCHEMA = "doc_id long, text string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rng, n, vocab=5000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def texts():
    rng = random.Random(7)
    inside, turn, block = prose(rng, 51), prose(rng, 70), [prose(rng, 6) for _ in range(12)]
    splice = lambda x: f"{prose(rng, 90)} {x} {prose(rng, 90)}"  # noqa: E731  no sentence ends
    chain = prose(rng, 200).split()
    rows = [
        (1, splice(inside)), (2, splice(inside.upper())), (3, prose(rng, 9) + " " + inside + " " + prose(rng, 9)),
        (4, splice("\n".join(block))), (5, "\n\n".join(block)), (6, prose(rng, 30) + "\n" + "\n".join(block) + "\n" + prose(rng, 25)),
        (7, turn), (8, turn.replace(" ", "\n", 35)), (9, splice(turn)), (9, splice(turn)),
        (10, " ".join(chain[:101])), (11, splice(" ".join(chain[50:]))), (12, splice(" ".join(chain))),
        (13, "line here now\n" * 30), (14, prose(rng, 50)), (15, None), (16, ""), (None, splice(inside)),
        (17, splice(" ".join(inside.split()[:50]))), (18, "one é " + turn + " ü"), (19, turn + " " + prose(rng, 60) + " " + turn),
    ]
    return rows + [rows[11], rows[3]]


def brute(rows, window=shared_runs.WINDOW):
    """{(id, text): (repeated bytes, bytes that go)} by windows as tuples of words."""
    where = collections.defaultdict(list)
    words = {}
    for n, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        words[n] = [m.span() for m in WORD.finditer(raw)]
        low = [raw[a:b].lower() for a, b in words[n]]
        for p in range(len(low) - window + 1):
            where[tuple(low[p : p + window])].append((i is not None, i or 0, n, p))
    same = {}
    out = {n: (set(), set()) for n in words}
    for n, r in enumerate(rows):
        same.setdefault(r, n)
    for places in where.values():
        if len(places) > 1:
            keep = min(places, key=lambda x: (x[:2], same[rows[x[2]]], x[3]))
            for place in places:
                n, p = place[2:]
                span = range(words[n][p][0], words[n][p + window - 1][1])
                out[n][0].update(span)
                if (rows[n], p) != (rows[keep[2]], keep[3]):
                    out[n][1].update(span)
    return out


def test_shared_runs(spark):
    rows = texts()
    d = spark.createDataFrame(rows, SCHEMA)
    keyed = {(r.k1, r.k2): (r.id, r.text.decode() or None) for r in substring_dedup._keyed(d, "doc_id", "text").collect()}
    # two texts of one id are told apart by their hash, as in the operator
    order = {v: k for k, v in keyed.items()}
    rows.sort(key=lambda r: order.get((r[0], r[1] or None), (0, 0)))
    got = collections.defaultdict(lambda: (set(), set(), []))
    linked = collections.defaultdict(set)
    for r in shared_runs.shared_runs(d).collect():
        cell = got[keyed[r.k1, r.k2]]
        cell[r.removed].update(range(r.lo, r.hi))
        cell[2].append((r.lo, r.hi, r.removed))
        linked[r.component].add(r.id)
        raw = keyed[r.k1, r.k2][1].encode()
        assert r.n_words >= shared_runs.WINDOW and r.n_words == len(WORD.findall(raw[r.lo : r.hi]))
    for n, (repeated, goes) in brute(rows).items():
        stays, gone, spans = got[rows[n][0], rows[n][1] or None]
        assert stays | gone == repeated and gone == goes
        assert len(spans) == rows.count(rows[n]) * len(set(spans))
    assert {None, 1, 2, 3} in linked.values() and {4, 5, 6} in linked.values() and {10, 11, 12} in linked.values()
    assert {7, 8, 9, 18, 19} in linked.values() and len(linked) == 5


def test_passages_are_removed(spark):
    """A passage inside long lines, and one of short lines, stay once; neither is a unit."""
    rng = random.Random(8)
    inside, block = prose(rng, 60), "\n".join(prose(rng, 6) for _ in range(12))
    rows = [(i, f"{prose(rng, 90)} {inside} {prose(rng, 90)}") for i in range(3)] + [(i, f"{prose(rng, 9)}\n{block}\n{prose(rng, 9)}") for i in range(3, 6)]
    d = spark.createDataFrame(rows, SCHEMA)
    found = {(r.id, r.removed) for r in substring_dedup.duplicate_passages(d).collect()}
    assert found == {(0, False), (1, True), (2, True), (3, False), (4, True), (5, True)}
    clean = {r.doc_id: r.text for r in substring_dedup.remove_duplicates(d).collect()}
    assert [i for i in clean if inside in clean[i]] == [0] and [i for i in clean if block in clean[i]] == [3]
    assert all(clean[i] == t.replace(inside if i < 3 else block, "") for i, t in rows if i not in (0, 3))


def test_passages_across_lines_are_found(spark):
    """51 words in different lines of 60, and over a line end whose pieces are under 20 words."""
    rng = random.Random(9)
    passage = prose(rng, 51)
    w = passage.split()
    wrapped = "\n".join(" ".join(w[k : k + 17]) for k in (0, 17, 34))
    rows = [(1, f"{passage} {prose(rng, 9)}"), (2, f"{prose(rng, 9)} {passage}"), (3, f"{prose(rng, 30)}\n{wrapped}\n{prose(rng, 30)}")]
    d = spark.createDataFrame(rows, SCHEMA)
    found = {(r.id, r.lo, r.hi, r.n_words, r.removed) for r in substring_dedup.duplicate_passages(d).collect()}
    at = {i: t.index(passage if i < 3 else wrapped) for i, t in rows}
    assert found == {(i, at[i], at[i] + len(passage), 51, i > 1) for i in at}
