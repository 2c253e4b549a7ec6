"""Quality rules: base filters and a hashed n-gram log-likelihood ratio.

Unigrams and bigrams of whole texts are hashed into bins whose number grows with the square
root of the corpus. The trusted target (documents labelled good) and the raw corpus (all
documents) each give a multinomial over the bins. A document's score is the log-likelihood ratio of its n-grams, divided by their
number; a fixed threshold decides. Weights are integers (millionths), so sums do not depend on
order. Everything is DataFrame expressions; only the bins' counts reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BINS = 16384
BLOCK = 4096
THRESHOLD = -0.09
UNIT = 1_000_000
MOST_TRUSTED = 200_000
# White space that ends a word, and symbol characters.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_words``, and ``_one`` and ``_two``, hashes of words and word pairs. Each
    is a column of its own, so that none is computed twice."""
    d = docs.withColumn("_words", words_of(F.col(text_col)))
    d = d.withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w)))
    return d.withColumn("_two", _followed(F.col("_one"), F.col("_one"), 1))


def _followed(left: Column, one: Column, by: int) -> Column:
    """Hashes of runs, each longer by the word that follows it ``by`` words after its first."""
    n = F.greatest(F.size(one) - by, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(one, by + 1, n), lambda a, b: F.xxhash64(a, b))


def _packed(triple: Column, places: Column) -> Column:
    """Window hashes with their low bits, as many as places need, replaced by the place; only
    where a hash repeats."""
    return F.when(F.size(F.array_distinct(triple)) < F.size(triple), F.transform(triple, lambda h, i: h.bitwiseAND(-places).bitwiseOR(i.cast("long")))).otherwise(
        F.array().cast("array<long>")
    )


def _pairs(packed: Column, triple: Column, places: Column) -> Column:
    """Neighbours in sorted order with one hash: the two places as one number."""
    n = F.greatest(F.size(packed) - 1, F.lit(0))
    same = F.zip_with(
        F.slice(packed, 1, n),
        F.slice(packed, 2, n),
        lambda x, y: F.when(x.bitwiseXOR(y) < places, F.shiftleft(x.bitwiseAND(places - 1), 32).bitwiseOR(y.bitwiseAND(places - 1))),
    )
    # the low bits of the hashes are compared here
    return F.filter(F.array_compact(same), lambda e: F.get(triple, F.shiftright(e, 32).cast("int")) == F.get(triple, e.bitwiseAND(0xFFFFFFFF).cast("int")))


def _covered(places: Column) -> Column:
    """Words in windows at these places: a window adds three words less those covered before."""
    step = F.transform(places, lambda i, j: F.when(j == 0, F.lit(3).cast("long")).otherwise(F.least(F.lit(3).cast("long"), i - F.get(places, j - 1))))
    return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)


def base_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and the columns of ``hashed``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = hashed(docs, text_col).withColumns({
        "_three": _followed(F.col("_two"), F.col("_one"), 2),
        "_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)),
    })
    # a power of two above the number of words, as a column, for lambdas compute nothing once
    d = d.withColumn("_places", F.pow(F.lit(2.0), F.ceil(F.log2(F.size("_words") + 1.0))).cast("long"))
    d = d.withColumn("_packed", _packed(F.col("_three"), F.col("_places")))
    d = d.withColumn("_packed", F.sort_array("_packed"))
    d = d.withColumn("_pairs", _pairs(F.col("_packed"), F.col("_three"), F.col("_places")))
    ends = F.concat(F.transform("_pairs", lambda e: F.shiftright(e, 32)), F.transform("_pairs", lambda e: e.bitwiseAND(0xFFFFFFFF)))
    d = d.withColumn("_pairs", F.sort_array(F.array_distinct(ends)))
    d = d.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _covered(F.col("_pairs")),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("_lines", "_three", "_words", "_packed", "_pairs", "_places")


def bins_for(n_bytes: int) -> int:
    """Bins for a corpus of so many bytes: the power of two at or above the square root, and
    ``LEAST_BINS`` at least. N-grams per bin grow as fast as bins do, so at 100 TB the weights
    are 2**24 numbers, which still go to every executor."""
    return max(LEAST_BINS, 1 << math.ceil(math.log2(max(n_bytes, 1)) / 2))


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int | None = None, most_trusted: int = MOST_TRUSTED) -> list[int]:
    """Weights of the bins, in millionths: log of the trusted share over the raw share, both
    with one added per bin. Without ``bins``, ``bins_for`` all bytes of the texts.

    ``trusted`` has the trusted ids; if there are more than ``most_trusted``, those with the
    smallest hashes are taken, so what is broadcast has a fixed bound. Counts come from all
    n-grams of all documents in one scan, aggregated map-side per bin; they reach the driver as
    one string for ``BLOCK`` bins. Without any trusted document all weights are 0.
    """
    if bins is None:
        bins = bins_for(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    if bins & (bins - 1):
        raise ValueError("bins must be a power of two")
    good = trusted.select(F.col(id_col).alias("_good")).where(F.col("_good").isNotNull()).distinct()
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(most_trusted)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    src = src.join(F.broadcast(good), F.col("_id") == F.col("_good"), "left").select("_text", F.col("_good").isNotNull().cast("int").alias("good"))
    grams = hashed(src, "_text").select("good", F.explode(F.concat("_one", "_two")).alias("gram"))
    counts = grams.groupBy(F.col("gram").bitwiseAND(bins - 1).cast("int").alias("bin")).agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    numbers = F.concat_ws(" ", F.flatten(F.collect_list(F.array("bin", "raw", "target"))).cast("array<string>"))
    r, t = np.zeros(bins), np.zeros(bins)
    for row in counts.groupBy(F.floor(F.col("bin") / BLOCK)).agg(numbers.alias("numbers")).collect():
        found = np.array(row["numbers"].split(), np.int64).reshape(-1, 3)
        r[found[:, 0]], t[found[:, 0]] = found[:, 1], found[:, 2]
    if not t.sum():
        return [0] * bins
    r, t = r + 1, t + 1
    return [int(x) for x in np.rint(np.log((t / t.sum()) / (r / r.sum())) * UNIT)]


def scored(docs: DataFrame, weights: list[int], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, ``score`` (mean log-likelihood ratio per n-gram) and
    ``kept``: not ``base_failed`` and a score of at least ``threshold``.

    Null and empty texts have no words and fail. Up to 2**31 words are told apart. Every row gets a verdict, repeated rows the
    same one; columns of ``docs`` with the names given here are replaced; an empty table stays
    empty.

    ``kept`` holds a term that Spark takes for not deterministic and that is always true. It
    keeps filters on ``kept`` above the projections here: pushed below them, all would become
    one condition, in which lambdas compute the split text again for every element.
    """
    bins = len(weights)
    # one string, which the planner folds to an array; numbers one by one would take a call each
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    made = ["_words", "_lines", "_one", "_two", "_three", "_packed", "_pairs", "_places", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    d = base_columns(docs.drop(*made), text_col)
    total = F.aggregate(F.concat("_one", "_two"), F.lit(0).cast("long"), lambda a, x: a + F.get(table, x.bitwiseAND(bins - 1).cast("int")))
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    d = d.withColumn("score", F.round(total / (n * UNIT), 6)).drop("_one", "_two")
    least = math.floor(threshold * UNIT) / UNIT
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least) & (F.monotonically_increasing_id() >= 0))
