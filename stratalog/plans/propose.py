"""The boundary to a template proposer: prompts, replies, votes, refinement."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .parse import Proposer, agree

Chat = Callable[[list[dict[str, str]]], str]

SYSTEM = "You find the template of log lines: the constant text, with placeholders for what varies."
ADVICE = {
    "full": "Put every varying part in braces, such as {user_id}. Keep constant words and punctuation. Lines given together come from one statement.",
    "plain": "Put every varying part in braces.",
}
EXAMPLE = (["Log[1]: `link 7 is up`", "Log[2]: `link 12 is up`"], "LogTemplate[1]: `link {number} is up`\nLogTemplate[2]: `link {number} is up`")


def prompt(logs: list[str], advice: str = "full", examples: bool = True, faulty: list[str] = (), proposal: str = "") -> list[dict[str, str]]:
    """Messages that ask for one template per log, numbered from 1."""
    said = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": ADVICE[advice] + " Answer with one line per log: LogTemplate[n]: `template`"}]
    if examples:
        said += [{"role": "user", "content": "\n".join(EXAMPLE[0])}, {"role": "assistant", "content": EXAMPLE[1]}]
    ask = "\n".join(f"Log[{i}]: `{x}`" for i, x in enumerate(logs, 1))
    if faulty:
        ask = "These templates are known to be wrong: " + "; ".join(faulty) + "\n" + ask
    return [*said, {"role": "user", "content": ask + (f"\nA first proposal: `{proposal}`" if proposal else "")}]


def extract(reply: str) -> dict[int, str]:
    """Templates of a reply by their number; of one number the first counts."""
    out: dict[int, str] = {}
    for n, t in re.findall(r"[Ll]og ?[Tt]emplate(?:\[(\d+)\])?: `?([^`\n]*)`?", reply or ""):
        out.setdefault(int(n or -1), t)
    out.pop(-1, None)
    return out


def filled(logs: list[str], found: dict[int, str]) -> list[str]:
    """One template per log: its own, or that of the lowest number; without any the logs."""
    first = found[min(found)] if found else None
    return [found.get(i, first) if found else x for i, x in enumerate(logs, 1)]


def fill_missing(logs: DataFrame, found: DataFrame) -> DataFrame:
    """The same for tables: ``group, idx, log`` and ``group, idx, template``."""
    first = found.where("idx <> -1").groupBy("group").agg(F.min_by("template", "idx").alias("first"))
    return logs.join(found, ["group", "idx"], "left").join(first, "group", "left").select("group", "idx", F.coalesce("template", "first", "log").alias("template"))


def majority(templates: list[str]) -> str:
    """The commonest valid template; of equals the first."""
    good = [t for t in templates if rules.valid(t)]
    return Counter(good).most_common(1)[0][0] if good else ""


def ask_again(templates: list[str], share: float = 0.8) -> bool:
    """Replies so different that asking again is worth it."""
    return len(set(templates)) / len(templates) >= share if templates else False


def why_not(log: str, template: str) -> str:
    """Empty if the template matches, or what is wrong with it, for a refined question."""
    if rules.matcher(template).match(log):
        return ""
    at = 0
    for i, piece in enumerate(template.split("<*>")):
        found = log.find(piece, at)
        if i == 0 and not log.startswith(piece):
            return f"the log does not start with '{piece}'"
        if found < 0:
            return f"'{piece}' is missing in the log"
        at = found + len(piece)
    return f"the log goes on with '{log[at:]}'"


def from_chat(chat: Chat, tries: int = 3, rounds: int = 3, advice: str = "full") -> Proposer:
    """A proposer over any chat function. Failures count as empty replies; a template that
    doesn't match the first log is refined up to ``rounds`` times, then the agreement is taken."""

    def call(messages):
        for _ in range(tries):
            try:
                return chat(messages) or ""
            except Exception as e:  # noqa: BLE001  a failed request is an empty reply, whatever it raised
                last = e
        del last
        return ""

    def propose(logs: list[str]) -> str:
        messages = prompt(logs, advice)
        for _ in range(1 + rounds):
            reply = call(messages)
            best = majority([rules.post_processed(t)[0] for t in filled(logs, extract(reply))]) if extract(reply) else ""
            wrong = why_not(logs[0], best) if best else "there was no template"
            if not wrong:
                return best
            messages = [*messages, {"role": "assistant", "content": reply}, {"role": "user", "content": f"That is not right: {wrong}. Try again."}]
        return agree(logs)

    return propose


def markdown_tables(text: str) -> list[list[dict[str, str]]]:
    """Rows of every pipe table in a reply."""
    tables, block = [], []
    for line in [*text.splitlines(), ""]:
        if line.strip().startswith("|"):
            block.append([c.strip() for c in line.strip().strip("|").split("|")])
        elif block:
            if len(block) > 1 and all(re.fullmatch("[-: ]+", c) for c in block[1]):
                tables.append([dict(zip(block[0], row)) for row in block[2:]])
            block = []
    return tables
