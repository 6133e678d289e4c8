"""File scans over bodies written from the driver's tables: every row is written in the
shape of a feed, scanned again, and must come back."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog.base import query
from catalog.tables import PAGES_SQL, pages, table
from tidemark.session import shared_folder
from tidemark.sources import files


def _land(df: DataFrame, name: str, per_file: int = 0, by: str | None = None) -> str:
    """Write bodies, one per line, or `per_file` in a file, or a file for each value of `by`."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.select("body", *([by] if by else [])).write.option("maxRecordsPerFile", per_file)
    (writer.partitionBy(by) if by else writer).text(path)
    return path


def _list(rows: DataFrame, by: Column, item: Column) -> DataFrame:
    return rows.groupBy(by.alias("_by")).agg(F.collect_list(item).alias("items"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


@query("scan_observations", "SELECT CAST(ts AS DATE) AS day, value FROM events")
def _observations(spark, folder):
    item = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("value").cast("string").alias("value"))
    # Every seventh body ends with a placeholder, which no row comes from.
    gap = F.struct(F.lit("2024-01-01").alias("date"), F.lit(".").alias("value"))
    e = _list(table(spark, folder, "events"), F.floor(F.col("event_id") / 50), item)
    items = F.when(F.col("_by") % 7 == 0, F.concat("items", F.array(gap))).otherwise(F.col("items"))
    path = _land(e.select(_json(observations=items).alias("body")), "observations")
    return files.scan_observations(spark, path, lines=True).select("day", "value")


@query(
    "scan_positions",
    """SELECT CAST(l_partkey AS VARCHAR) AS series, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS BIGINT) AS long,
      CAST(l_suppkey AS BIGINT) AS short, CAST(l_orderkey AS BIGINT) AS open_interest FROM lineitem""",
)
def _positions(spark, folder):
    body = _json(
        report_date_as_yyyy_mm_dd=F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
        cftc_contract_market_code=F.col("l_partkey").cast("string"),
        m_money_positions_long_all=F.format_number("l_quantity", 0),
        m_money_positions_short_all=F.col("l_suppkey").cast("string"),
        open_interest_all=F.format_number("l_orderkey", 0),
    )
    return files.scan_positions(spark, _land(table(spark, folder, "lineitem").select(body.alias("body")), "positions"), lines=True)


def _charts(spark, folder) -> str:
    e = table(spark, folder, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    bars = _list(e, F.struct("event_type", F.floor(F.col("event_id") / 200).alias("n")), F.struct("event_id", "t", "value"))
    bars = bars.withColumn("items", F.sort_array("items"))
    result = F.struct(
        F.struct(F.col("_by.event_type").alias("symbol")).alias("meta"),
        F.col("items.t").alias("timestamp"),
        F.struct(F.array(F.struct(F.col("items.value").alias("close"))).alias("quote")).alias("indicators"),
    )
    return _land(bars.select(_json(chart=F.struct(F.array(result).alias("result"))).alias("body")), "charts")


@query("scan_bars", "SELECT event_type AS series, date_trunc('second', ts) AS ts, value FROM events")
def _bars(spark, folder):
    return files.scan_bars(spark, _charts(spark, folder), lines=True)


@query(
    "scan_quotes",
    """WITH b AS (SELECT event_type AS series, event_id // 200 AS n, list(value ORDER BY event_id) AS v,
        arg_max(date_trunc('second', ts), event_id) AS ts FROM events GROUP BY 1, 2)
    SELECT series, ts, v[-1] AS last, v[-2] AS previous, round((v[-1] / nullif(v[-2], 0) - 1) * 100, 6) AS change_pct FROM b""",
)
def _quotes(spark, folder):
    out = files.scan_quotes(spark, _charts(spark, folder), lines=True)
    return out.withColumn("change_pct", F.round("change_pct", 6))


@query(
    "scan_articles",
    f"WITH {PAGES_SQL} SELECT url, trim(title) AS title, domain, first_seen AS published_at FROM h WHERE trim(title) <> ''",
)
def _articles(spark, folder):
    p = pages(spark, folder)
    item = F.struct("url", "title", F.date_format("first_seen", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"))
    path = _land(_list(p, F.floor(F.col("id") / 10), item).select(_json(articles=F.col("items")).alias("body")), "articles")
    return files.scan_articles(spark, path, lines=True).select("url", "title", "domain", "published_at")


@query(
    "scan_contracts",
    """SELECT 'GOLD' AS symbol, upper(strftime(l_shipdate, '%d%b%Y')) AS expiry_text, l_extendedprice AS price,
      CAST(l_shipdate AS DATE) AS expiry FROM lineitem WHERE l_partkey % 3 = 0 AND l_extendedprice BETWEEN 40000 AND 400000""",
)
def _contracts(spark, folder):
    item = F.struct(
        F.when(F.col("l_partkey") % 3 == 0, "Gold").otherwise("SILVER").alias("Symbol"),
        F.upper(F.date_format("l_shipdate", "ddMMMyyyy")).alias("ExpiryDate"),
        F.col("l_extendedprice").cast("string").alias("LTP"),
    )
    # A body is read whole, so each is a file of its own.
    bodies = _list(table(spark, folder, "lineitem"), F.floor(F.col("l_orderkey") / 2000), item)
    path = _land(bodies.select(_json(d=F.col("items")).alias("body")), "contracts", per_file=1)
    return files.scan_contracts(spark, path).select("symbol", "expiry_text", "price", "expiry")


PER_ARCHIVE = 500  # keys in a file


@query(
    "scan_preamble_csv",
    """SELECT DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS day, p_retailprice AS value FROM part
    WHERE p_retailprice BETWEEN 200 AND 2000""",
)
def _preamble(spark, folder):
    p = table(spark, folder, "part")
    day = F.date_format(F.date_add(F.lit(date(2020, 1, 1)), (F.col("p_partkey") % 1000).cast("int")), "dd-MMM-yyyy")
    part = F.floor(F.col("p_partkey") / PER_ARCHIVE).alias("part")
    rows = p.select(
        part,
        F.lit(1).alias("n"),
        F.concat(day, F.lit(',"'), F.regexp_replace("p_name", '"', ""), F.lit('",x,"'), F.format_number("p_retailprice", 6), F.lit('"')).alias("body"),
    )
    # Every range of keys is a file, with a header of its own before its rows.
    head = ["Daily, archive 1,000", "", "As of date,Name,Ounces,Tonnes in trust"]
    heads = p.select(part).distinct().select("part", F.lit(0).alias("n"), F.explode(F.array(*map(F.lit, head))).alias("body"))
    ordered = heads.unionByName(rows).repartition("part").sortWithinPartitions("part", "n")
    return files.scan_preamble_csv(spark, _land(ordered, "archive", by="part")).select("day", "value")


@query(
    "scan_navs",
    """SELECT p_name AS scheme, p_retailprice AS nav, strftime(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER), '%d-%b-%Y') AS nav_date
    FROM part WHERE p_retailprice BETWEEN 5 AND 2000""",
)
def _navs(spark, folder):
    day = F.date_format(F.date_add(F.lit(date(2020, 1, 1)), (F.col("p_partkey") % 1000).cast("int")), "dd-MMM-yyyy")
    line = F.concat_ws(";", F.col("p_partkey").cast("string"), "p_brand", F.lit("-"), "p_name", F.col("p_retailprice").cast("string"), day)
    rows = table(spark, folder, "part").select(line.alias("body"))
    heads = table(spark, folder, "part").select(F.concat(F.lit("Schemes of "), "p_type").alias("body")).distinct()
    return files.scan_navs(spark, _land(rows.unionByName(heads), "navs")).select("scheme", "nav", "nav_date")


FEED_SQL = f"WITH {PAGES_SQL} SELECT url, trim(title) AS title, trim(html) AS summary, domain, first_seen AS published_at FROM h WHERE trim(title) <> ''"


def _escaped(c: str) -> Column:
    out = F.col(c)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def _element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def _feeds(p: DataFrame, item: Column, head: str, tail: str) -> str:
    """A file for each fifty pages."""
    bodies = _list(p, F.floor(F.col("id") / 50), item)
    return _land(bodies.select(F.concat(F.lit(head), F.array_join("items", ""), F.lit(tail)).alias("body")), "feed", per_file=1)


@query("scan_feed_items", FEED_SQL)
def _feed(spark, folder):
    stamp = F.concat(F.date_format("first_seen", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    body = _element("item", F.concat(
        _element("title", _escaped("title")), _element("link", _escaped("url")), _element("description", _escaped("html")),
        _element("pubDate", stamp),
    ))
    path = _feeds(pages(spark, folder), body, "<rss><channel><title>all</title>", "</channel></rss>")
    return files.scan_feed_items(spark, path).select("url", "title", "summary", "domain", "published_at")


@query("scan_atom_items", FEED_SQL)
def _atom(spark, folder):
    stamp = F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    link = F.concat(F.lit('<link href="'), _escaped("url"), F.lit('"/>'))
    body = _element("entry", F.concat(
        _element("title", _escaped("title")), link, _element("summary", _escaped("html")), _element("updated", stamp)
    ))
    path = _feeds(pages(spark, folder), body, "<feed>", "</feed>")
    return files.scan_feed_items(spark, path, atom=True).select("url", "title", "summary", "domain", "published_at")


@query("scan_calendar", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < DATE '1996-03-01' + 201")
def _calendar(spark, folder):
    row = F.concat(F.lit("<tr><td>x</td><td>"), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("</td></tr>"))
    o = _list(table(spark, folder, "orders"), F.floor(F.col("o_orderkey") / 5000), row)
    body = F.concat(F.lit("<table>"), F.array_join("items", ""), F.lit("</table>"))
    path = _land(o.select(body.alias("body")), "calendar", per_file=1)
    return files.scan_calendar(spark, path, date(1996, 3, 1), releases=True).select("day").distinct()
