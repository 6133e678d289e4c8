"""Landing-folder scans: raw bodies of feeds become readings, positions or headlines.

Every scan takes many files at once. A row that cannot be read becomes null and is
dropped; a file never fails the scan. The series or feed of a body is the stem of its
file name.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import expiry_date, first_date, first_timestamp
from tidemark.functions.numbers import clean_number
from tidemark.functions.text import domain_of, strip_tags
from tidemark.operators.headlines import dedupe_first
from tidemark.rules import NAV_BAND, RATE_BAND, TONNES_BAND
from tidemark.sources.markup import meeting_dates, release_date, rows_of


def stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def scan_observations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Dated observations; placeholders (`.`, blank) are skipped.

    With `lines`, a file holds one body per line, so that bulk history can be split.
    """
    raw = spark.read.schema("observations array<struct<date:string,value:string>>").json(path, multiLine=not lines)
    return (
        raw.select(stem().alias("series"), F.explode("observations").alias("o"))
        .select("series", F.col("o.date").try_cast("date").alias("day"), clean_number(F.col("o.value")).alias("value"))
        .filter("day IS NOT NULL AND value IS NOT NULL")
    )


def scan_positions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Weekly long, short and open interest; rows without readable positions are dropped."""
    schema = ", ".join(
        f"{c} string"
        for c in (
            "report_date_as_yyyy_mm_dd",
            "cftc_contract_market_code",
            "m_money_positions_long_all",
            "m_money_positions_short_all",
            "open_interest_all",
        )
    )
    raw = spark.read.schema(schema).json(path, multiLine=not lines)
    whole = lambda c: clean_number(F.col(c)).cast("bigint")
    return raw.select(
        F.col("cftc_contract_market_code").alias("series"),
        F.col("report_date_as_yyyy_mm_dd").try_cast("timestamp").cast("date").alias("day"),
        whole("m_money_positions_long_all").alias("long"),
        whole("m_money_positions_short_all").alias("short"),
        whole("open_interest_all").alias("open_interest"),
    ).filter("day IS NOT NULL AND long IS NOT NULL AND short IS NOT NULL")


_CHART = (
    "chart struct<result:array<struct<"
    "meta:struct<symbol:string,chartPreviousClose:double,regularMarketPrice:double>,"
    "timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>"
)


def _charts(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    raw = spark.read.schema(_CHART).json(path, multiLine=not lines)
    return raw.select(stem().alias("file"), F.explode("chart.result").alias("r")).select(
        F.coalesce("r.meta.symbol", "file").alias("series"),
        F.col("r.meta").alias("meta"),
        F.col("r.timestamp").alias("stamps"),
        F.get("r.indicators.quote", F.lit(0))["close"].alias("closes"),
    )


def scan_bars(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per bar with a close."""
    pairs = F.arrays_zip(F.col("stamps").alias("t"), F.col("closes").alias("c"))
    return (
        _charts(spark, path, lines)
        .select("series", F.explode(pairs).alias("bar"))
        .select("series", F.timestamp_seconds("bar.t").alias("ts"), F.col("bar.c").alias("value"))
        .filter("value IS NOT NULL AND ts IS NOT NULL")
    )


def scan_quotes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Last and previous price per chart; the official previous close wins over bars."""
    closes = F.filter("closes", lambda c: c.isNotNull())
    last = F.coalesce(F.try_element_at(closes, F.lit(-1)), F.col("meta.regularMarketPrice"))
    previous = F.coalesce(F.col("meta.chartPreviousClose"), F.try_element_at(closes, F.lit(-2)))
    return (
        _charts(spark, path, lines)
        .select(
            "series",
            F.timestamp_seconds(F.try_element_at("stamps", F.lit(-1))).alias("ts"),
            last.alias("last"),
            previous.alias("previous"),
        )
        .filter("last IS NOT NULL")
        .withColumn("change_pct", (F.try_divide("last", "previous") - 1) * 100)
    )


def scan_articles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Articles with a url and a title; `pos` orders them as their files do."""
    raw = spark.read.schema(
        "articles array<struct<url:string,title:string,seendate:string,domain:string>>"
    ).json(path, multiLine=not lines)
    return (
        raw.select(stem().alias("topic"), _at().alias("at"), F.posexplode("articles").alias("n", "a"))
        .select(
            "topic",
            F.struct("at.file", "at.block", "at.row", "n").alias("pos"),
            F.trim("a.url").alias("url"),
            F.trim("a.title").alias("title"),
            first_timestamp(F.col("a.seendate")).alias("published_at"),
            F.coalesce("a.domain", domain_of(F.trim("a.url"))).alias("outlet"),
        )
        .filter("url <> '' AND title <> ''")
        .withColumn("domain", domain_of(F.col("url")))
    )


def scan_contracts(spark: SparkSession, path: str, symbol: str = "GOLD") -> DataFrame:
    """Contracts of one exact symbol with a plausible price.

    The payload sits under `d` or `data`, as a list or as a JSON text of one. Field
    names vary, so each row is read as a map and the first filled candidate counts.
    """
    body = spark.read.text(path, wholetext=True)
    inner = F.coalesce(
        F.nullif(F.get_json_object("value", "$.d"), F.lit("[]")), F.get_json_object("value", "$.data")
    )
    rows = F.from_json(inner, "array<map<string,string>>")
    first = lambda *names: F.coalesce(*[F.nullif(F.try_element_at(F.col("m"), F.lit(n)), F.lit("")) for n in names])
    out = body.select(F.posexplode(rows).alias("pos", "m")).select(
        F.col("pos").cast("bigint").alias("id"),
        F.upper(F.coalesce(first("Symbol", "symbol"), F.lit(""))).alias("symbol"),
        F.coalesce(first("ExpiryDate", "expiryDate"), F.lit("front-month")).alias("expiry_text"),
        clean_number(first("LTP", "LastTradedPrice", "ltp", "ClosePrice")).alias("price"),
    )
    return (
        out.filter(F.col("symbol") == symbol.upper())
        .filter(F.col("price").between(*map(F.lit, RATE_BAND)))
        .withColumn("expiry", expiry_date(F.col("expiry_text")))
    )


def _at() -> Column:
    """Place of a row: its file, where the split starts, and a number that grows along the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and a position that grows along the file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")
        ).alias("at"),
        "value",
    )


def scan_preamble_csv(
    spark: SparkSession, path: str, date_word: str = "date", value_word: str = "tonne", band: tuple[float, float] = TONNES_BAND
) -> DataFrame:
    """Dated values from CSV files with a preamble and headers that move.

    The header is the first line that names both columns; they are then read by
    position from every line after it. Quoted cells may hold commas.
    """
    cells = F.transform(
        F.split("value", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.trim(F.regexp_replace(c, '"', ""))
    )
    lines = _lines(spark, path).withColumn("cells", cells)
    lowered = F.transform("cells", lambda c: F.lower(c))
    place = lambda word: F.array_position(F.transform(lowered, lambda c: F.contains(c, F.lit(word))), True)
    header = (
        lines.withColumn("d", place(date_word))
        .withColumn("v", place(value_word))
        .filter("d > 0 AND v > 0")
        .groupBy("file")
        .agg(F.min_by(F.struct("at", "d", "v"), "at").alias("h"))
    )
    body = lines.join(header, "file").filter(F.col("at") > F.col("h.at"))
    out = body.select(
        F.regexp_extract("file", r"([^/]*?)(\.[^.]*)?$", 1).alias("series"),
        first_date(F.try_element_at("cells", F.col("h.d").cast("int"))).alias("day"),
        clean_number(F.try_element_at("cells", F.col("h.v").cast("int"))).alias("value"),
    )
    return out.filter("day IS NOT NULL").filter(F.col("value").between(*map(F.lit, band)))


def scan_navs(spark: SparkSession, path: str, band: tuple[float, float] = NAV_BAND) -> DataFrame:
    """Scheme, value and date from semicolon lines; section headers have no six fields."""
    parts = F.transform(F.split("value", ";"), lambda c: F.trim(c))
    f = _lines(spark, path).withColumn("f", parts).filter(F.size("f") >= 6)
    return f.select(
        "at",
        F.get("f", F.lit(3)).alias("scheme"),
        clean_number(F.get("f", F.lit(4))).alias("nav"),
        F.get("f", F.lit(5)).alias("nav_date"),
    ).filter(F.col("nav").between(*map(F.lit, band)))


def _feed_time(text: Column) -> Column:
    """RFC 822 (weekday dropped, since it carries nothing) or ISO stamps."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")),
        bare.try_cast("timestamp"),
    )


def scan_feed_items(spark: SparkSession, path: str, atom: bool = False) -> DataFrame:
    """All items of RSS files, or entries of Atom ones; `pos` orders them as their files do.

    Title and link must be there; the publication time falls back to the update time.
    """
    if atom:
        schema = "title string, link struct<_href:string>, summary string, published string, updated string"
        raw = spark.read.format("xml").schema(schema).option("rowTag", "entry").load(path).withColumn("_at", _at())
        link, summary = F.col("link._href"), F.col("summary")
        stamp = F.coalesce(_feed_time(F.col("published")), _feed_time(F.col("updated")))
    else:
        schema = "title string, link string, description string, pubDate string"
        raw = spark.read.format("xml").schema(schema).option("rowTag", "item").load(path).withColumn("_at", _at())
        link, summary = F.col("link"), F.col("description")
        stamp = _feed_time(F.col("pubDate"))
    items = raw.select(
        stem().alias("feed"),
        F.struct("_at.*", F.lit(0).alias("n")).alias("pos"),
        F.trim("title").alias("title"),
        F.trim(link).alias("url"),
        F.coalesce(F.trim(summary), F.lit("")).alias("summary"),
        stamp.alias("published_at"),
    )
    return items.filter("title <> '' AND url <> ''").withColumn("domain", domain_of(F.col("url")))


def scan_calendar(spark: SparkSession, path: str, today: date, releases: bool) -> DataFrame:
    """Dates on calendar pages: `Month d, yyyy` per row, or the last day of `Month d1-d2`."""
    pages = spark.read.text(path, wholetext=True).select(stem().alias("name"), F.col("value").alias("html"))
    now = F.lit(today)
    if releases:
        rows = F.concat(*[rows_of(F.col("html"), tag) for tag in ("tr", "li", "p")])
        found = pages.select("name", F.explode(rows).alias("row")).select(
            "name", release_date(strip_tags(F.col("row")), now).alias("day")
        )
    else:
        found = pages.select("name", F.explode(meeting_dates(strip_tags(F.col("html")), now)).alias("day"))
    return found.filter("day IS NOT NULL").distinct()


def first_by_topic(articles: DataFrame, topics: Sequence[str]) -> DataFrame:
    """First occurrence of a url in topic order, then list order."""
    rank = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col("topic"))
    return dedupe_first(articles.withColumn("_topic", rank), "url", ["_topic", "pos"]).drop("_topic")
