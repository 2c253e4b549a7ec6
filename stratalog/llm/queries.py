"""The corpus operators' queries, with production parameters over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    decontaminate,
    license_scan,
    quality_rules,
    sentencepiece_codec,
    sharding,
    simhash_dedup,
    substring_dedup,
    suffix_dedup,
    token_counts,
)
from .common import cut, shared_path

CONTROL_TURN = "<|im_end|><|im_start|>assistant ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written to the shared folder, read back; size and checksum are of what is there."""
    path = shared_path(spark, "shards")
    sharding.write_shards(_table(spark, sf_dir, "documents"), path, 40)
    there = spark.read.parquet(path).select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "bucket",
        "place",
        "grown_shard",
    )
    return sharding.with_slots(there).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes from every document and a digest of what stays."""
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, which is a file ``source/lang/doc_id``."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    out = license_scan.scan(docs.select(path.alias("path"), "text"))
    return out.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "path", "license", "method", "similarity")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that is there twice or more, with its component and whether it goes."""
    out = substring_dedup.duplicate_passages(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("lo").alias("first_byte"), F.col("hi").alias("end_byte"), "n_words", F.col("component").alias("component_id"), "removed")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every document; documents labelled good are the trusted target."""
    docs = _table(spark, sf_dir, "documents")
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = quality_rules.scored(docs, quality_rules.fit(docs, trusted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its suffix sums."""
    lengths = token_counts.encoded_lengths(_table(spark, sf_dir, "documents"))
    # written once, since suffix sums read it twice and texts are to be encoded once
    return token_counts.suffix_sums(cut(token_counts.histogram(lengths)))


def _piece_digest(c: sentencepiece_codec.Codec, text: str, ids: list[int]):
    arr = np.array(ids, np.int32)
    return (
        len(ids),
        int(c.bytes_from[arr].sum()) if ids else 0,
        hashlib.sha256(arr.tobytes()).hexdigest(),
        hashlib.sha256(c.decode(ids).encode()).hexdigest(),
    )


_piece_digest.types = [pa.int64(), pa.int64(), pa.string(), pa.string()]


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: counts, digest of the ids (little-endian 32 bits),
    digest of the decoded text, and whether that is the text."""
    docs = _table(spark, sf_dir, "documents")
    out = sentencepiece_codec.encode(
        docs.withColumn("doc_id", F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))),
        summarise=_piece_digest,
        schema="n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string",
    )
    return out.select(
        F.col("id.doc_id").alias("doc_id"), "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", (F.col("id.h") == F.col("decoded_sha256")).alias("round_trip")
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its best window."""
    out = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("similarity", 6).alias("similarity"), "first_word", "n_words")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one made of control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql(f"select -1L conv_id, t.* from values (0L, 'user', '{CONTROL_TURN}'), (1L, 'assistant', '{CONTROL_TURN}') t(turn, role, text)")
    out = chat_format.format_conversations(rows.unionByName(odd))

    def read_back(batches):
        for b in batches:
            got = {"conv_id": [], "n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
            for conv, text, loss in zip(*(b.column(i).to_pylist() for i in range(3))):
                turns = chat_format.parse_chatml(text)
                lost = "".join(chat_format.unescape(text[s["lo"] : s["hi"]]) for s in loss)
                got["conv_id"].append(conv)
                got["n_turns"].append(len(turns))
                got["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                got["loss_chars"].append(len(lost))
                got["loss_sha256"].append(hashlib.sha256(lost.encode()).hexdigest())
                got["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_pydict(got, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return out.select("conv_id", "formatted", "loss").mapInArrow(
        read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


_ESCAPED_LENGTH = r"length(regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g'))"

_FILES = "SELECT coalesce(source, '') || '/' || coalesce(lang, '') || '/' || coalesce(CAST(doc_id AS VARCHAR), '') AS path, coalesce(text, '') AS text FROM documents"

ORACLE: dict[str, str] = {
    "op4_license_scan": f"SELECT CAST(split_part(path, '/', 3) AS BIGINT) AS doc_id, * FROM ({license_scan.oracle(_FILES)})",
    "op10_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{CONTROL_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TURN}'
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            CAST(sum({_ESCAPED_LENGTH.format('role')} + {_ESCAPED_LENGTH.format('text')} + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_sharding": op2_sharding,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontamination": op9_decontamination,
    "op10_chat_format": op10_chat_format,
}
