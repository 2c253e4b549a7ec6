"""Two ways from lines to templates: batch (all DataFrame) and sequential (a loop per length)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.templates import post_processed, valid
from ..functions.text import WILD, mask
from ..operators import assign, cluster, sampling
from .lineage import cut

Proposer = Callable[[list[str]], str]


def batch_templates(clustered: DataFrame) -> DataFrame:
    """``n, cid2, seq, template``: the corrected consensus of every cluster, or its first
    content corrected, or as it is; seq ranks clusters by lines, then number."""
    agreed = assign.consensus(clustered).withColumn("c", post_processed(F.col("template"))).select("cid2", "c")
    firsts = clustered.groupBy("n", "cid2").agg(F.sum("cnt").alias("rows"), F.min_by("content", "first_line").alias("first"))
    firsts = firsts.withColumn("f", post_processed(F.col("first")))
    t = firsts.join(agreed, "cid2").select(
        "n", "cid2", "rows",
        F.when(F.col("c.ok") & valid(F.col("c.template")), F.col("c.template")).when(F.col("f.ok"), F.col("f.template")).otherwise(F.col("first")).alias("template"),
    )
    # order by (rows desc, cid2) as one number, so that no global sort is needed to rank
    return t.select("n", "cid2", F.struct((-F.col("rows")).alias("less"), "cid2").alias("seq"), "template")


def batch(lines: DataFrame, masks: tuple[str, ...] = ()) -> DataFrame:
    """``line_id, content, template`` of ``lines`` (line_id, content): each distinct masked
    content takes the first template of its token count that matches, clusters with most lines
    first; what none matches is its own template, blank lines have the empty one."""
    masked = lines.select("line_id", F.col("content").alias("raw"), mask(F.col("content"), masks).alias("content"))
    clustered = cut(cluster.clusters(masked.select("line_id", "content")).drop("feature"))
    return _assigned(masked, assign.first_match(clustered.select("content", "n"), batch_templates(clustered)))


def _assigned(masked: DataFrame, found: DataFrame) -> DataFrame:
    blank = F.trim(F.regexp_replace("content", r"(?U)[\s\x1c-\x1f]+", " ")) == ""
    return masked.join(found, "content", "left").select(
        "line_id", F.col("raw").alias("content"), F.when(blank, "").otherwise(F.coalesce("template", "content")).alias("template")
    )


def batch_with_trace(lines: DataFrame, masks: tuple[str, ...] = (), samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """What ``batch`` returns, and a trace with a row for every cluster in the order in which
    templates are tried: ``iter, cluster_id, logs_to_query, llm_template, template,
    update_success``. The logs are a diverse sample; ``template`` is null where no content took
    the cluster's template."""
    masked = lines.select("line_id", F.col("content").alias("raw"), mask(F.col("content"), masks).alias("content"))
    clustered = cut(cluster.clusters(masked.select("line_id", "content")).drop("feature"))
    known = cut(batch_templates(clustered))
    found = cut(assign.first_match(clustered.select("content", "n"), known))
    picks = sampling.diverse(clustered.select("cid2", "content", "first_line"), samples)
    logs = picks.groupBy("cid2").agg(F.transform(F.sort_array(F.collect_list(F.struct("pick", "content"))), lambda x: x["content"]).alias("logs_to_query"))
    used = found.select("template").distinct().withColumn("taken", F.lit(True))
    ranks = known.select("cid2", F.row_number().over(Window.orderBy("seq")).alias("iter"))
    trace = known.join(ranks, "cid2").join(logs, "cid2").join(assign.consensus(clustered).select("cid2", F.col("template").alias("llm_template")), "cid2").join(used, "template", "left")
    took = F.coalesce("taken", F.lit(False))
    trace = trace.select("iter", F.col("cid2").alias("cluster_id"), "logs_to_query", "llm_template", F.when(took, F.col("template")).alias("template"), took.alias("update_success"))
    return _assigned(masked, found), trace


def agree(logs: list[str]) -> str:
    """The deterministic proposer: tokens on which all logs agree, wildcards elsewhere."""
    rows = [x.split() for x in logs]
    return " ".join(c[0] if len(set(c)) == 1 else WILD for c in zip(*rows))


def replay(answers: dict[str, str]) -> Proposer:
    """A proposer that gives recorded templates by first log, else agrees."""
    return lambda logs: answers.get(logs[0]) or agree(logs)


def farthest_first(logs: list[str], n: int = 5) -> list[str]:
    picked, left = [logs[0]], logs[1:]
    low = [2.0] * len(left)
    while left and len(picked) < n:
        low = [min(v, rules.jaccard(x, picked[-1])) for v, x in zip(low, left)]
        i = min(range(len(left)), key=low.__getitem__)
        picked.append(left.pop(i))
        low.pop(i)
    return picked


class Known:
    """The templates of one token count; the latest changed is last."""

    def __init__(self):
        self.items: list[str] = []

    def add(self, template: str) -> tuple[str, str | None]:
        """The template to use, and the known one it has replaced."""
        if template == WILD or template in self.items:
            return template, None
        if self.items and " " in template:
            near = max(self.items, key=lambda t: rules.jaccard(t, template, 1e-5))
            new = rules.merged(template, near)
            if new:
                self.items.remove(near)
                self.items.append(new)
                return new, near
        self.items.append(template)
        return template, None


def parse_length(rows: pd.DataFrame, propose: Proposer = agree) -> pd.DataFrame:
    """Templates of the distinct contents of one token count: take the cluster with most open
    lines, sample it, propose, match all open contents, merge with what is known; where a
    proposal fails, the corrected first log and last the log itself are tried."""
    rows = rows.sort_values("first_line")
    content, weight, group = rows["content"].tolist(), rows["cnt"].tolist(), rows["cid2"].tolist()
    template: list[str] = [""] * len(content)
    open_rows, known = set(range(len(content))), Known()
    while open_rows:
        size: dict[int, int] = {}
        for i in open_rows:
            size[group[i]] = size.get(group[i], 0) + weight[i]
        chosen = min(size, key=lambda g: (-size[g], g))
        logs = [content[i] for i in sorted(open_rows) if group[i] == chosen]
        sample = farthest_first(logs)
        for t in (rules.post_processed(propose(sample))[0], rules.post_processed(logs[0])[0], logs[0]):
            if t != logs[0] and not rules.valid(t):
                continue
            like = rules.matcher(t)
            hit = [i for i in open_rows if (content[i] == t if t == logs[0] else like.match(content[i]))]
            if not hit:
                continue
            use, replaced = known.add(t)
            if replaced is not None and use != t:
                wider = rules.matcher(use)
                hit += [i for i in open_rows.difference(hit) if wider.match(content[i])]
            for i in hit:
                template[i] = use
            if replaced is not None:
                template = [use if x == replaced else x for x in template]
            open_rows.difference_update(hit)
            break
    return pd.DataFrame({"content": content, "template": template})


def sequential(lines: DataFrame, masks: tuple[str, ...] = (), propose: Proposer = agree) -> DataFrame:
    """``line_id, content, template`` by the loop of ``parse_length``, one group per token count.
    Counts are independent of each other; distinct contents only are in a group."""
    masked = lines.select("line_id", F.col("content").alias("raw"), mask(F.col("content"), masks).alias("content"))
    c = cluster.clusters(masked.select("line_id", "content")).select("content", "n", "cid2", "cnt", "first_line")
    found = c.groupBy("n").applyInPandas(lambda pdf: parse_length(pdf, propose), "content string, template string")
    return masked.join(found, "content", "left").select("line_id", F.col("raw").alias("content"), F.coalesce("template", F.lit("")).alias("template"))
