"""Sharding by a two-pass external shuffle.

Pass 1 scatters records into memory-sized buckets: the shard of a record is the one with the
largest seeded hash of (id, shard), and each shard has as many buckets as its bytes need, of
which a second seeded hash, of id and text, picks one, so that rows with one id spread and the
layout of the input doesn't count. Equal rows that would fill a good part of a bucket are few,
known and spread over all buckets. The scatter is one exchange whose files are the buckets. Pass 2 loads a bucket, puts it in a
defined order, shuffles it by Fisher-Yates with a generator seeded by the bucket, and writes
it. Slots follow from the counts of what has been written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

OVERHEAD = 16
BUCKET_BYTES = 64 << 20
MOST_OFFSETS = 1_000_000


def shard_of(key: Column, shards: int, seed: int = 42) -> Column:
    """The shard whose seeded hash with the key is largest. One more shard takes only those
    rows whose hash with it is largest; no row moves between the others. A null key is a key."""
    weighted = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda i: F.struct(F.xxhash64(F.coalesce(key, F.lit(-(2**63) + 1)), i, F.lit(seed)).alias("w"), i.alias("i")),
    )
    return F.array_max(weighted)["i"]


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def write_shards(
    docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, bucket_bytes: int = BUCKET_BYTES
) -> None:
    """Write ``docs`` to ``path`` as Parquet, one file per bucket, all columns kept, with
    ``shard``, ``grown_shard`` (the shard under one more), ``bucket`` within the shard and
    ``place`` within the bucket.

    Law ``key``: id and shard count decide the shard; rows with one id or a null id share a
    shard but spread over its buckets. Null texts have no bytes. An empty table writes no rows.
    Columns of those four names are replaced.

    The result is the same for every layout of the input, unless equal rows hold over a quarter
    of a bucket: their copies go to buckets by their place, as nothing else tells them apart.
    """
    added = ["shard", "grown_shard", "bucket", "place"]
    kept = docs.drop(*added)
    size = size_of(F.col(text_col))
    total = kept.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    record = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    which = record
    if buckets > 1:
        # each holds a quarter of a bucket, so there are at most four times as many as buckets
        heavy = kept.groupBy(record.alias("r")).agg(F.sum(size).alias("s"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("s") > bucket_bytes // 4))
        if heavy := [r["r"] for r in heavy.select("r").collect()]:
            which = F.when(record.isin(heavy), F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))).otherwise(record)
    marked = kept.select(
        "*",
        shard_of(F.col(id_col), shards, seed).cast("int").alias("shard"),
        shard_of(F.col(id_col), shards + 1, seed).cast("int").alias("grown_shard"),
        F.pmod(which, F.lit(buckets)).cast("int").alias("bucket"),
    )
    scattered = marked.repartitionById(shards * buckets, (F.col("shard") * buckets + F.col("bucket")).cast("int"))
    columns = kept.columns
    at = {c: i for i, c in enumerate(columns)}

    def shuffle(batches):
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            keys = np.stack([b.column(len(columns)).to_numpy(zero_copy_only=False), b.column(len(columns) + 2).to_numpy(zero_copy_only=False)])
            if b.num_rows and (keys == keys[:, :1]).all():
                held.setdefault(tuple(map(int, keys[:, 0])), []).append(b)
                continue
            for key in {tuple(map(int, k)) for k in keys.T}:
                held.setdefault(key, []).append(b.filter(pa.array((keys == np.array(key)[:, None]).all(axis=0))))
        for key in sorted(held):
            t = pa.Table.from_batches(held.pop(key))
            # arrival order differs from run to run; ids, then whole texts, define where to start
            ids, texts = t.column(at[id_col]).to_pylist(), t.column(at[text_col])
            order = sorted(range(t.num_rows), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0))
            if len(set(ids)) < len(ids):
                order.sort(key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, texts[i].as_py() or ""))
            rng = np.random.Generator(np.random.PCG64([seed & 0x7FFFFFFF, *key]))
            rng.shuffle(order := np.array(order, np.int64))  # Fisher-Yates
            for lo in range(0, len(order), 2048):
                part = t.take(pa.array(order[lo : lo + 2048])).combine_chunks()
                part = part.append_column("place", pa.array(np.arange(lo, lo + part.num_rows, dtype=np.int64)))
                yield from part.to_batches()

    schema = T.StructType([*scattered.schema.fields, T.StructField("place", T.LongType())])
    scattered.mapInArrow(shuffle, schema).write.mode("errorifexists").parquet(path)


def with_slots(written: DataFrame) -> DataFrame:
    """``written`` with ``slot``, gapless from 0 within each shard: the place in the bucket
    after all rows of the shard's earlier buckets; a column of that name is replaced. Bucket
    counts, not rows, are windowed. They are broadcast if a count has shown them to be at most
    a million. An empty table stays empty."""
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    struct = F.struct(F.col("shard").alias("s"), F.col("bucket").alias("b"))
    offsets = cut(counts.select(struct.alias("_at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))
    if offsets.count() <= MOST_OFFSETS:
        offsets = F.broadcast(offsets)
    rows = written.drop("slot", "_at", "_before").withColumn("_at", struct)
    return rows.join(offsets, "_at").withColumn("slot", F.col("place") + F.col("_before")).drop("_at", "_before")
