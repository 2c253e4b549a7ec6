"""Proposer boundary and dataset registry; no Spark needed."""

import re

from stratalog.plans import propose
from stratalog.sources.registry import DATASETS, Config


def test_extract_and_fill():
    reply = "LogTemplate[1]: `a {x}`\nLog template[3]: b\nnoise [9]\nLogTemplate[3]: `c`"
    assert propose.extract(reply) == {1: "a {x}", 3: "b"}
    assert propose.filled(["l1", "l2", "l3"], propose.extract(reply)) == ["a {x}", "a {x}", "b"]
    assert propose.filled(["l1"], {}) == ["l1"]


def test_votes():
    assert propose.majority(["t1", "t2", "t2", "t1"]) == "t1"
    assert propose.majority(["", ""]) == ""
    assert propose.ask_again(["a", "b", "c", "d", "a"]) and not propose.ask_again(["a", "a"])


def test_refinement():
    replies = iter(["LogTemplate[1]: `open {x} ok`", RuntimeError, "LogTemplate[1]: `open {x}`"])
    asked = []

    def chat(messages):
        asked.append(messages)
        r = next(replies)
        if r is RuntimeError:
            raise r
        return r

    assert propose.from_chat(chat)(["open file", "open dir"]) == "open <*>"
    assert "missing" in asked[1][-1]["content"]
    assert propose.from_chat(lambda m: "")(["a 1", "a 2"]) == "a <*>"


def test_mismatch_messages():
    assert propose.why_not("a b", "a <*>") == ""
    assert "start" in propose.why_not("a b", "x <*>")
    assert "missing" in propose.why_not("a b", "a <*> c")
    assert "goes on" in propose.why_not("a b c", "a b")


def test_markdown_tables():
    text = "so:\n| a | b |\n|---|:-:|\n| 1 | x |\n| 2 | y |\nend"
    assert propose.markdown_tables(text) == [[{"a": "1", "b": "x"}, {"a": "2", "b": "y"}]]


def test_registry():
    assert len(DATASETS) == 17
    for d in DATASETS.values():
        f = d.format()
        assert re.compile(f.pattern).groups >= len(f.fields) and f.fields[-1][0] == "Content"
        for m in d.masks:
            re.compile(m)
    line = "Jun 14 15:16:01 combo sshd(pam_unix)[19939]: authentication failure"
    f = DATASETS["Linux"].format()
    got = re.match(f.pattern, line)
    assert {n: got[g] for n, g, _ in f.fields}["PID"] == "19939"
    assert Config("Apache").masks() and not Config("Apache", mask="add").masks()
