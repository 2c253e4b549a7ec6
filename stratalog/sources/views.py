"""Log lines made from the test tables, which hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The sentences of an event and their templates, as SQL that Spark and DuckDB both take.
EVENT_SQL = """
    SELECT event_id AS line_id,
        CASE event_type
            WHEN 'click' THEN concat('user ', user_id, ' clicked item ', regexp_extract(props, '([0-9]+)', 1), ' on page /p/', regexp_extract(props, '([0-9]+)', 1))
            WHEN 'error' THEN concat('ERROR code=', regexp_extract(props, '([0-9]+)', 1), ' for user ', user_id, ': request failed after ', event_id % 7, ' retries')
            WHEN 'purchase' THEN concat('user ', user_id, ' bought ', regexp_extract(props, '([0-9]+)', 1), ' items')
            WHEN 'signup' THEN concat('new signup user=', user_id, ' plan=basic')
            ELSE concat('user ', user_id, ' viewed item ', regexp_extract(props, '([0-9]+)', 1)) END AS content,
        CASE event_type
            WHEN 'click' THEN 'user <*> clicked item <*> on page /p/<*>'
            WHEN 'error' THEN 'ERROR code=<*> for user <*>: request failed after <*> retries'
            WHEN 'purchase' THEN 'user <*> bought <*> items'
            WHEN 'signup' THEN 'new signup user=<*> plan=basic'
            ELSE 'user <*> viewed item <*>' END AS truth
    FROM events"""


# More lines than a text of 2 GB can hold.
LINES_OF_A_DOCUMENT = 1 << 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_id, content, truth``."""
    return spark.sql(EVENT_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_id, content``: non-blank lines of documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
    return d.where(F.trim("content") != "").select((F.col("doc_id") * LINES_OF_A_DOCUMENT + F.col("pos")).alias("line_id"), "content")


DOC_SQL = f"""
    SELECT doc_id * {LINES_OF_A_DOCUMENT} + pos - 1 AS line_id, content
    FROM (SELECT doc_id, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
    WHERE trim(content) <> ''"""
