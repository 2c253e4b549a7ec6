"""What the corpus operators share: lineage cuts, components, rolling hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let as let
from ..plans.lineage import cut as cut
from ..plans.lineage import release as release
from ..plans.lineage import shared_path as shared_path


class Scratch:
    """Tables of an operator's own in the shared folder: columnar and compressed, where a
    checkpoint keeps whole rows, and dropped as soon as the operator is done with them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = shared_path(self.spark, name), df.schema
        df.write.parquet(path)
        del df
        release(self.spark)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all that are left."""
        jvm = self.spark.sparkContext._jvm
        for key in [id(t) for t in tables] or list(self.paths):
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(key))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has two columns of one orderable type. Returns ``node, label`` for every node
    that has an edge to another node; label is the smallest node reachable. Loops, repeated
    edges and null ends are ignored; no edges give no rows. Every round is a constant number
    of hash aggregates and equi-joins over at most as many edges as before, so neither a hub
    nor a component is ever gathered in one task, and only two numbers reach the driver.
    """
    a, b = edges.columns[:2]
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(e)
    for _ in range(max_rounds if seen[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = mark(e)
        if tuple(now) == tuple(seen):
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substring of a byte array from one prefix sum, modulo 2**64.

    Bytes are first replaced by random 64-bit numbers, so the hash of a substring is the
    same wherever it stands. ``fold_case`` gives A-Z the numbers of a-z.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 42, fold_case: bool = False):
        self.table = np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64)
        if fold_case:
            self.table[65:91] = self.table[97:123]
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 4096, 2 * len(self.up))
            self.up, self.down = np.ones(size, np.uint64), np.ones(size, np.uint64)
            self.up[1:] = np.uint64(self.BASE)
            self.down[1:] = np.uint64(pow(self.BASE, -1, 2**64))
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of data[lo:hi] for arrays of bounds."""
        return (prefix[hi] - prefix[lo]) * self.down[lo]

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of every window of ``width`` bytes."""
        n = len(prefix) - width
        return (prefix[width:] - prefix[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)
