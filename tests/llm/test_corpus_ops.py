"""The corpus operators against brute force, and on odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import chat_format as G
from stratalog.llm import common, decontaminate, license_scan, quality_rules, sentencepiece_codec, sharding, simhash_dedup, substring_dedup, suffix_dedup, token_counts
from stratalog.llm import queries as Q

WS = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, a column named as the operators name theirs."""
    rng = random.Random(1)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    texts = [
        (1, base), (2, base), (3, base.upper()), (4, base + " tail end"), (5, None), (6, ""), (7, "   \n\t "), (8, "one"), (9, "two words"),
        (10, prose(rng, 30_000)), (11, prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 80)), (12, prose(rng, 70) + "\n" + passage), (12, prose(rng, 20)),
        (13, "é▁ü\x00 日本 \U0001f600 " + base[:100]), (None, base), (None, None), (14, "x" * 900), (15, "line here now\n" * 30), (11, None),
    ]
    repeated = texts + [texts[0], texts[11]]
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, None if k % 5 == 0 else "src0", len(t or "")) for k, (i, t) in enumerate(repeated)], SCHEMA).withColumns({"fp": F.lit(1), "shard": F.lit("s"), "n_words": F.lit(0)})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hamming_components(rows):
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                up[find(a)] = find(b)
    low = {}
    for i, f in rows:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return {(i, f): low.get(find(f)) for i, f in rows}


def slow_fingerprint(text):
    import xxhash

    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(WS, text or "")]
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(request, which):
    d = request.getfixturevalue(which)
    got = simhash_dedup.near_duplicates(d).collect()
    texts = collections.defaultdict(set)
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    want = collections.Counter((i, slow_fingerprint(t)) for i, t in rows)
    assert collections.Counter((r.id, r.fp % 2**64) for r in got) == want
    comp = hamming_components(list(want))
    assert all(comp[(r.id, r.fp % 2**64)] == r.component for r in got)


def test_simhash_links_all_pairs(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ int(np.bitwise_or.reduce([1 << int(b) for b in rng.integers(0, 63, rng.integers(1, 5))])) for _ in range(150)}
    fps |= {int(x) for x in rng.integers(0, 2**63, 100)}
    got = {(r.a, r.b) for r in simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (3, None)] + [(500, 500 + k) for k in range(1, 80)]
    real = [(a, b) for a, b in edges if b is not None and a != b]
    up = {n: n for e in real for n in e}
    for _ in up:
        for a, b in real:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.label for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == up
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_sharding(request, spark, tmp_path, which):
    d = request.getfixturevalue(which)
    path = str(tmp_path / "shards")
    sharding.write_shards(d, path, 7, bucket_bytes=4000)
    out = sharding.with_slots(spark.read.parquet(path)).collect()
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.text or "")
    assert sorted(map(key, out)) == sorted(map(key, d.collect()))
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r.grown_shard in (r["shard"], 7)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(by) < 7
    assert len({(r.doc_id, r["shard"]) for r in out}) == len({r.doc_id for r in out})
    pick = lambda p: sorted((r["shard"], r["slot"], *key(r)) for r in sharding.with_slots(spark.read.parquet(p)).collect())
    for size in (1 << 30, 20_000):  # one bucket a shard, and several
        sharding.write_shards(d.repartition(3), str(tmp_path / f"again{size}"), 7, bucket_bytes=size)
        sharding.write_shards(d.repartition(5), str(tmp_path / f"once{size}"), 7, bucket_bytes=size)
        assert pick(str(tmp_path / f"again{size}")) == pick(str(tmp_path / f"once{size}"))


def test_sharding_odd_tables(spark, tmp_path):
    """Clashing column names, an empty table, and one row that fills buckets."""
    rows = [(i, f"text {i} " * 20) for i in range(30)] + [(7, "same " * 100)] * 200 + [(None, None)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("offset", "slot", "_at", "n", "s", "r")})
    sharding.write_shards(d, str(tmp_path / "a"), 4, bucket_bytes=3000)
    out = sharding.with_slots(spark.read.parquet(str(tmp_path / "a")))
    assert out.where("offset = 1 and n = 1").count() == len(rows) and out.where("doc_id = 7").select("bucket").distinct().count() > 3
    for r in out.groupBy("shard").agg(F.count("*").alias("c"), F.max("slot").alias("m"), F.countDistinct("slot").alias("k")).collect():
        assert r.c == r.k == r.m + 1
    sharding.write_shards(d.limit(0), str(tmp_path / "b"), 4)
    assert sharding.with_slots(spark.read.schema(out.drop("slot").schema).parquet(str(tmp_path / "b"))).count() == 0


def removed_spans(texts, depth):
    seen = collections.Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        out.append((bytes(b for b, g in zip(t, gone) if not g), len([p for p in bytes(gone).split(b"\0") if p])))
    return out


@pytest.mark.parametrize("which, depth", [("docs", 200), ("odd", 200)])
def test_suffix_dedup(request, which, depth):
    d = request.getfixturevalue(which)
    rows = [(r.doc_id, (r.text or "").encode()) for r in d.select("doc_id", "text").collect()]
    want = collections.Counter((i, len(t), n, k) for (i, t), (k, n) in zip(rows, removed_spans([t for _, t in rows], depth)))
    got = collections.Counter((r.id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(d, depth=depth).collect())
    assert got == want


def test_suffix_dedup_periodic(spark):
    rng = random.Random(9)
    texts = ["ab" * 150, "abc" * 90, "a" * 199, "a" * 200, "a" * 201, "".join(rng.choice("ab") for _ in range(5000)), "x" + "ab" * 120 + "y"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (bytes(r.kept), len(r.spans)) for r in suffix_dedup.remove_repeats(d).collect()}
    assert got == dict(enumerate(removed_spans([t.encode() for t in texts], 200)))


def test_suffix_dedup_hot_digits(spark, docs, monkeypatch):
    """The way for digits with very many contexts gives the same."""
    key = lambda r: (r.id, bytes(r.kept))
    want = sorted(map(key, suffix_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "MOST", 1)
    assert sorted(map(key, suffix_dedup.remove_repeats(docs).collect())) == want


def test_license(spark):
    rows = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/x", "some words"), ("a/b/c/y", "Released under the MIT License.\nmore " + "words " * 50), ("z", None),
        ("a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("a/q", ""), (None, "nothing"), ("a/q", ""), ("q/ab", "licence free prose"),
    ]
    got = {r.path: (r.license, r.method) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "a/LICENSE": ("Apache-2.0", "header"), "a/b/x": ("GPL-3.0", "inherited"), "a/b/c/y": ("MIT", "header"), "z": (None, "none"), "a/b/LICENSE": ("GPL-3.0", "header"),
        "a/q": ("Apache-2.0", "inherited"), "": (None, "none"), "q/ab": (None, "none"),
    }
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_license_headers(spark):
    """Notices within a line or over lines, tags, rows with one path, columns named as the operator's."""
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 3 of the License, or (at your option) any later version."
    filler = "\n".join(f"some ordinary words {i}" for i in range(60))
    rows = [
        ("p/a", f"Copyright 2021 The Foo Authors. All rights reserved. Released under the MIT License. Have fun with it.\n{filler}"), ("p/b", f"{filler}\n{lgpl}\n{filler}"),
        ("p/c", f"// SPDX-License-Identifier: Apache-2.0\n{filler}"), ("p/d", f"# SPDX-License-Identifier: MIT\n{filler}"), ("p/e", filler), ("p/e", f"x\nReleased under the MIT License.\n{filler}"),
        ("p/e", f"y\nz\n{filler}"), ("p/f", None), ("p/g", "word " * 50_000), ("p/g", "word " * 50_000),
    ]
    d = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit(1) for c in ("part", "header", "b", "unit", "dir")})
    got = {r.path: (r.license, r.method) for r in license_scan.scan(d).collect()}
    assert got == {"p/a": ("MIT", "header"), "p/b": ("LGPL-3.0", "header"), "p/c": ("Apache-2.0", "header"), "p/d": ("MIT", "header"), "p/e": ("MIT", "header"), "p/f": (None, "none"), "p/g": (None, "none")}


def test_license_oracle(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(map(repr, con.sql(Q.ORACLE["op4_license_scan"]).select("doc_id, path, license, method, similarity").fetchall()))
    assert sorted(repr(tuple(r)) for r in Q.op4_license_scan(spark, sf_dir).select("doc_id", "path", "license", "method", "similarity").collect()) == want


def slow_units(docs_rows):
    """Lines of 50 words and more: words, and where each occurrence is; by regular expressions."""
    classes = collections.defaultdict(list)
    for i, t in docs_rows:
        at = 0
        for line in (t or "").encode().split(b"\n"):
            w = list(re.finditer(WS.encode(), line))
            if len(w) >= 50:
                classes[tuple(x[0].lower() for x in w)].append((i, at + w[0].start(), at + w[-1].end()))
            at += len(line) + 1
    return classes


def near(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def edited(spark):
    """Groups of near copies with one to three words changed, some changed alike."""
    rng = random.Random(21)
    rows = []
    for g in range(6):
        base = prose(rng, rng.choice([52, 60, 75, 110]))
        other = near(base, rng, 2)
        rows += [near(rng.choice([base, other]), rng, rng.randrange(4)) for _ in range(40)]
    return spark.createDataFrame([(i, prose(rng, 5) + "\n" + t) for i, t in enumerate(rows)], "doc_id long, text string")


@pytest.mark.parametrize("which", ["docs", "odd", "edited"])
def test_substring_dedup(request, which):
    d = request.getfixturevalue(which)
    classes = slow_units([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
    keys = list(classes)
    sets = [set(zip(*(k[j:] for j in range(5)))) for k in keys]
    up = list(range(len(keys)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, k in enumerate(keys):
        groups[find(i)] += classes[k]
    norm = lambda xs: tuple(sorted(xs, key=repr))
    want = {norm(g) for g in groups.values() if len(g) > 1}
    assert which != "edited" or len(want) > 3
    got = collections.defaultdict(list)
    stay = collections.Counter()
    for r in substring_dedup.duplicate_units(d).collect():
        got[r.component].append((r.id, r.lo, r.hi))
        stay[r.component] += not r.removed
    assert {norm(g) for g in got.values()} == want
    assert all(n >= 1 for n in stay.values())
    clean = substring_dedup.remove_duplicates(d)
    assert clean.columns == d.columns and clean.count() == d.count()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_base(request, spark, which):
    d = request.getfixturevalue(which).select("doc_id", "text", "lang")
    weights = quality_rules.fit(d, spark.createDataFrame([(1,), (2,), (1,), (None,)], "doc_id long"))
    for r in quality_rules.scored(d, weights).collect():
        w = re.findall(WS, r.text or "")
        tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if re.search(WS, x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_scores(spark):
    """The score against its definition, from Python dictionaries."""
    import xxhash

    d = spark.createDataFrame([(1, "a b c a"), (2, "z y"), (3, "a z q")], "doc_id long, text string")
    sign = lambda x: x - 2**64 if x >> 63 else x
    word = lambda t: sign(xxhash.xxh64_intdigest(t.encode(), 42))
    weights = quality_rules.fit(d, spark.createDataFrame([(1,)], "doc_id long"))
    ones = {t: word(t) % quality_rules.LEAST_BINS for t in "abczyq"}
    raw, good = collections.Counter(), collections.Counter()
    for i, t in [(1, "abca"), (2, "zy"), (3, "azq")]:
        for c in t:
            raw[ones[c]] += 1
            good[ones[c]] += i == 1
    assert sum(raw.values()) == 9
    better = [weights[ones[c]] for c in "bc"]
    worse = [weights[ones[c]] for c in "zy"]
    assert min(better) > 0 > max(worse)
    got = {r.doc_id: r.score for r in quality_rules.scored(d, weights).collect()}
    assert got[1] > got[3] > got[2]
    assert quality_rules.fit(d, spark.createDataFrame([], "doc_id long")) == [0] * quality_rules.LEAST_BINS


def test_token_counts(spark, odd):
    enc = token_counts.encoder(token_counts.read_vocabulary())
    lengths = sorted(len(enc.encode_ordinary(r.text or "")) for r in odd.select("text").collect())
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(odd)))
    for r in sums.collect():
        over = [x for x in lengths if x >= r.n_tokens]
        assert (r.documents, r.documents_at_least, r.tokens_at_least) == (lengths.count(r.n_tokens), len(over), sum(over))
        assert (r.total_tokens, r.truncated_tokens) == (sum(lengths), sum(min(x, r.n_tokens) for x in lengths))
        assert r.share_up_to == sum(x <= r.n_tokens for x in lengths) / len(lengths)
    for r in token_counts.at_limits(sums, [1, 64, 10_000, 10**7]).collect():
        assert (r.documents_over, r.truncated_tokens) == (sum(x > r.context for x in lengths), sum(min(x, r.context) for x in lengths))
    half = token_counts.quantile(sums, [0.5]).first()
    assert half.n_tokens == lengths[-(-len(lengths) // 2) - 1]
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(odd.limit(0)))).count() == 0


def small_codec():
    pieces = [("<unk>", 0.0, "other")] + [(f"<0x{i:02X}>", -20.0, "byte") for i in range(256)]
    pieces += [(p, s, "normal") for p, s in [("▁", -3.0), ("a", -4.0), ("b", -4.0), ("ab", -5.0), ("▁ab", -6.0), ("ba", -7.9), ("aba", -9.5), ("é", -5.0), ("▁▁", -4.0)]]
    return sentencepiece_codec.Codec(pieces), pieces


def test_viterbi_is_best():
    c, pieces = small_codec()
    score = {p: s for p, s, k in pieces if k == "normal"}

    def best(t):
        table = [0.0] + [-1e9] * len(t)
        for i in range(len(t)):
            options = [(len(p), s) for p, s in score.items() if t.startswith(p, i)]
            if not any(n == 1 for n, _ in options):
                options.append((1, c.unknown))
            for n, s in options:
                table[i + n] = max(table[i + n], table[i] + s)
        return table[-1]

    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice("ab é") for _ in range(rng.randint(1, 12)))
        marked = "▁" + t.replace(" ", "▁")
        ids = c.encode(t)
        assert list(c.viterbi(marked)) == ids
        assert sum(c.score[i] for i in ids) == pytest.approx(best(marked))
        assert c.decode(ids) == t


def test_sentencepiece_round_trip(odd, docs):
    for d in (odd, docs):
        enc = sentencepiece_codec.encode(d)
        want = collections.Counter((r.doc_id, r.text or "") for r in d.select("doc_id", "text").collect())
        assert collections.Counter((r.id, r.text) for r in sentencepiece_codec.decode(enc).collect()) == want


def test_decontamination(spark, docs, odd, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = lambda s: [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (s or "").encode().lower().decode()) if w]
    target = {r.item_id: words(r.text) for r in items.collect()}
    bags = {k: collections.Counter(zip(*(w[j:] for j in range(5)))) for k, w in target.items()}
    index = collections.defaultdict(set)
    for k, b in bags.items():
        for s in b:
            index[s].add(k)
    edited = []
    for k, w in list(target.items())[:12]:
        for where in (len(w) // 2, 1):
            edited.append((10_000 + len(edited), "start of it " + " ".join(w[:where] + ["changed"] + w[where + 1 :]) + " and the end"))
    d = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(edited, "doc_id long, text string"))
    want = {}
    for r in d.collect():
        w = words(r.text)
        sh = list(zip(*(w[j:] for j in range(5))))
        for k in set().union(*(index.get(s, ()) for s in sh)) if sh else ():
            m = len(target[k]) - 4
            n = min(m, len(sh))
            best = 0
            for s in range(len(sh) - n + 1):
                both = sum((collections.Counter(sh[s : s + n]) & bags[k]).values())
                best = max(best, both / (n + m - both))
            if best >= 0.8:
                want[(r.doc_id, k)] = max(best, want.get((r.doc_id, k), 0))
    got = {(r.id, r.item): r.similarity for r in decontaminate.find_leaks(d, items).collect()}
    assert len(want) > 12 and got == pytest.approx(want)
    left = decontaminate.without_leaks(d, items)
    assert left.count() == d.count() - sum(1 for r in d.collect() if any(k[0] == r.doc_id for k in want))
    assert decontaminate.find_leaks(d, items.limit(0)).count() == 0


def test_chat(spark):
    ok = Q.CONTROL_TURN
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", ok), (1, 2, None, None), (2, 5, "assistant", None), (2, 5, "assistant", "b\\<|x"), (None, 1, "user", "q"), (3, None, "as\nis\\n<|", "<\\|")]
    out = {r.conv_id: r for r in G.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert G.parse_chatml(out[1].formatted) == [("user", "hi"), ("assistant", ok), ("", "")]
    assert G.parse_chatml(out[3].formatted) == [("as\nis\\n<|", "<\\|")]
    got = ["".join(G.unescape(r.formatted[s.lo : s.hi]) for s in r.loss) for r in (out[1], out[2])]
    assert got == [ok, "b\\<|x"]
    assert all(not r.rewrites_history and r.spans[-1].hi == len(r.formatted) for r in out.values())
    last_only = lambda ts: f"{len(ts)} turns: " + G.chatml(ts[-1:])
    assert all(r.rewrites_history for r in G.format_conversations(spark.createDataFrame(rows[:2], "conv_id long, turn long, role string, text string"), last_only).collect())
    for t in ("", "<|", "<\\|", "<\\\\|<|", "a<|im_end|>"):
        assert G.unescape(G.escape(t)) == t and "<|" not in G.escape(t)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.duplicate_units(none).count() == 0
    assert sentencepiece_codec.encode(none).count() == 0
    assert quality_rules.scored(none, [0] * 8).count() == 0
    assert G.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_queries_digest(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = Q.op2_sharding(spark, sf_dir).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    rows = Q.op8_sentencepiece(spark, sf_dir).collect()
    assert all(r.round_trip for r in rows)
    assert {(r.doc_id, r.decoded_sha256) for r in rows} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
