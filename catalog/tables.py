"""The driver's tables seen through the library's schemas."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import domain_of

TZ = "Asia/Kolkata"
NOW = datetime(2024, 1, 31)  # just after the last event

# The same two views as SQL, for the oracle queries.
READINGS_SQL = (
    "r AS (SELECT event_id AS id, event_type AS series, ts, value, "
    "'u' || user_id AS source FROM events)"
)
DAILY_SQL = (
    "d AS (SELECT series, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, "
    "arg_max(value, ts) AS value, max(ts) AS ts FROM r GROUP BY 1, 2)"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def readings(spark: SparkSession, folder: str, since: datetime | None = None) -> DataFrame:
    """`since` filters on the stored zone-free column, so that it reaches the scan."""
    raw = table(spark, folder, "events")
    if since is not None:
        raw = raw.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return raw.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("series"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        F.lit("pt").alias("unit"),
        F.concat(F.lit("u"), "user_id").alias("source"),
        F.col("props").alias("extra"),
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as news: the source stands for the domain, the id sets the time."""
    first_seen = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60)
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("domain"),
        "lang",
        F.col("text").alias("title"),
        "text",
        first_seen.alias("first_seen"),
    )


ARTICLES_SQL = (
    "a AS (SELECT doc_id AS id, source AS domain, lang, text AS title, text, "
    "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS first_seen FROM documents)"
)

# A site is the host with the first path part; several pages share one.
SITE = r"^https?://([^/]+/[^/?#]+)"
DOMAIN_SQL = """
CASE WHEN len(labels) >= 3 AND array_to_string(labels[-2:], '.') IN
  ('co.uk','com.au','co.in','co.jp','com.br','co.za','org.uk')
  THEN array_to_string(labels[-3:], '.')
  WHEN len(labels) >= 2 THEN array_to_string(labels[-2:], '.')
  ELSE labels[1] END
"""


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as headlines in feed order."""
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("id"),
        "url",
        domain_of(F.col("url")).alias("domain"),
        F.regexp_extract("url", SITE, 1).alias("site"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 600).alias("first_seen"),
        "html",
    )


PAGES_SQL = f"""
h0 AS (SELECT page_id AS id, url, html,
  string_split(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', ''), '.') AS labels,
  regexp_extract(url, '^https?://([^/]+/[^/?#]+)', 1) AS site,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id * 10) AS first_seen FROM pages),
h AS (SELECT id, url, html, site, title, first_seen, {DOMAIN_SQL} AS domain FROM h0)
"""
