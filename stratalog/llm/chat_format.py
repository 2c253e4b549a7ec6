"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. Successive turn
prefixes are rendered and consecutive outputs compared: what a turn adds is its span. Where an
output does not begin with the one before it, the template rewrites history; such a
conversation is rendered once, flagged, and given no spans. The place of the text within a
span is found by rendering the turn with two texts that differ in their first character.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Put a backslash into every ``<|``, also where backslashes stand between already."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def chatml(turns: list[Turn]) -> str:
    """``<|im_start|>role\\ntext<|im_end|>\\n`` per turn, control strings in texts escaped."""
    return "".join(f"<|im_start|>{_role_out(r)}\n{escape(t)}<|im_end|>\n" for r, t in turns)


def parse_chatml(formatted: str) -> list[Turn]:
    """The turns of a ChatML string, read back from its markers."""
    turns = []
    for part in formatted.split("<|im_start|>")[1:]:
        role, _, text = part.partition("\n")
        turns.append((_role_in(role), unescape(text.removesuffix("<|im_end|>\n"))))
    return turns


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]]
    loss: list[tuple[int, int]]
    rewrites: bool


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def render(turns: list[Turn], template: Callable[[list[Turn]], str] = chatml, train: str = "assistant") -> Rendered:
    """Render turn prefixes one after the other; spans and loss spans are in code points."""
    before, spans, loss = template([]), [], []
    for i, (role, text) in enumerate(turns):
        now = template(turns[: i + 1])
        if not now.startswith(before):
            return Rendered(template(turns), [], [], True)
        spans.append((len(before), len(now)))
        if role == train:
            probes = [template([*turns[:i], (role, mark)]) for mark in ("", "")]
            start = _common(*probes)
            tail = len(probes[0]) - start - 1
            loss.append((start, len(now) - tail))
        before = now
    return Rendered(before, spans, loss, False)


SCHEMA = "conv_id long, formatted string, spans array<struct<lo:long,hi:long>>, loss array<struct<lo:long,hi:long>>, rewrites_history boolean"
_SPAN = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def format_conversations(
    rows: DataFrame, template: Callable[[list[Turn]], str] = chatml, train: str = "assistant"
) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text`` (other columns are dropped).

    Turns are ordered by turn, then role, then text, nulls first; a null role or text counts
    as empty; repeated rows are turns of their own; rows with a null conv_id form one
    conversation. A conversation is the unit of work and must fit in a task's memory. An empty
    table gives an empty result.
    """
    src = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        order = sorted(range(table.num_rows), key=lambda i: (got["turn"][i] is not None, got["turn"][i] or 0, got["role"][i], got["text"][i]))
        out = render([(got["role"][i], got["text"][i]) for i in order], template, train)
        pairs = lambda xs: pa.array([[{"lo": a, "hi": b} for a, b in xs]], _SPAN)
        return pa.table({
            "conv_id": pa.array([got["conv_id"][0]], pa.int64()),
            "formatted": pa.array([out.text], pa.string()),
            "spans": pairs(out.spans),
            "loss": pairs(out.loss),
            "rewrites_history": pa.array([out.rewrites]),
        })

    return src.groupBy("conv_id").applyInArrow(run, SCHEMA)
