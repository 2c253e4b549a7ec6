"""Exact token-length histogram.

Texts are encoded once, lengths are counted, and every question about a context limit is
answered from suffix sums over the histogram, whose rows are distinct lengths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the split pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 4096
_ENCODERS: dict = {}


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The rank file, read on the driver and sent to the executors; refuses over 64 MB."""
    with open(path, "rb") as f:
        data = f.read((64 << 20) + 1)
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is too large to broadcast")
    return data


def encoder(data: bytes, pattern: str = PATTERN):
    key = (hash(data), pattern)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def encoded_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, keep: Iterable[str] = ()) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every row; a null or empty text has 0 tokens.
    Control strings in a text are ordinary text."""
    keep = list(keep)
    src = docs.select(*keep, F.col(text_col).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        encode = encoder(sent.value, pattern).encode_ordinary
        for b in batches:
            n = [len(encode(x)) if (x := v.as_py()) else 0 for v in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    fields = "".join(f"`{c}` {src.schema[c].dataType.simpleString()}, " for c in keep)
    return src.mapInArrow(run, fields + "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, documents`` per distinct length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("documents"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For every length L in the histogram: documents and tokens at or above it, tokens kept
    if texts are cut at L, and the share of documents no longer than L.

    Running sums are taken within blocks of 4096 lengths and carried over from block totals,
    so no task holds more than a block of lengths or the list of blocks.
    """
    h = hist.select("n_tokens", "documents", F.expr(f"n_tokens div {BLOCK}").alias("block"), (F.col("n_tokens") * F.col("documents")).alias("tokens"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    everything = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    carried = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), zero).alias("d_above"),
        F.coalesce(F.sum("t").over(above), zero).alias("t_above"),
        F.sum("d").over(everything).alias("d_all"),
        F.sum("t").over(everything).alias("t_all"),
    )
    here = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(carried, "block").select(
        "n_tokens",
        "documents",
        (F.sum("documents").over(here) + F.col("d_above")).alias("documents_at_least"),
        (F.sum("tokens").over(here) + F.col("t_above")).alias("tokens_at_least"),
        "d_all",
        "t_all",
    )
    below = F.col("d_all") - F.col("documents_at_least")
    return s.select(
        "n_tokens",
        "documents",
        "documents_at_least",
        "tokens_at_least",
        F.col("t_all").alias("total_tokens"),
        (F.col("t_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("documents_at_least")).alias("truncated_tokens"),
        ((below + F.col("documents")) / F.col("d_all")).alias("share_up_to"),
    )


def at_limits(sums: DataFrame, limits: Iterable[int]) -> DataFrame:
    """``context, documents_over, total_tokens, truncated_tokens`` for any context limits: what
    is cut at a limit follows from the next length above it. The limits are a short list."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context long")
    over = sums.select("n_tokens", "documents", "total_tokens")
    return (
        over.join(F.broadcast(asked), F.lit(True))
        .groupBy("context")
        .agg(
            F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("documents")).otherwise(0)).alias("documents_over"),
            F.max("total_tokens").alias("total_tokens"),
            F.sum(F.least("n_tokens", "context") * F.col("documents")).alias("truncated_tokens"),
        )
    )


def quantile(sums: DataFrame, shares: Iterable[float]) -> DataFrame:
    """``share, n_tokens``: the least length that at least this share of documents do not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return sums.join(F.broadcast(asked), F.col("share_up_to") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
