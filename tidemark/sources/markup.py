"""Extraction from HTML text with expressions only; no document tree is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import MONTHS, month_number, safe_date
from tidemark.functions.numbers import clean_number
from tidemark.functions.text import any_term, strip_tags

_TOKEN = r"(\d[\d,]*\.?\d*)"


def rows_of(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?s)(<{tag}[ >].*?</{tag}>)"), 1)


def html_rate(pages: DataFrame, markers: Sequence[str], band: tuple[float, float], tag: str = "tr") -> DataFrame:
    """First plausible number in a row that holds a marker; markers in order of preference.

    One result per page: the first row, for the first marker that gives one. The
    marker itself is not taken for a price.
    """
    rows = pages.select("id", F.posexplode(rows_of(F.col("html"), tag)).alias("row_no", "row")).withColumn(
        "text", strip_tags(F.col("row"))
    )
    tokens = rows.select(
        "id",
        "row_no",
        "text",
        F.posexplode(F.regexp_extract_all("text", F.lit(_TOKEN), 1)).alias("tok_no", "token"),
    ).withColumn("value", clean_number(F.col("token")))
    plausible = tokens.filter(F.col("value").between(*map(F.lit, band)))
    bare = F.regexp_replace("token", ",", "")
    found = [
        F.min(F.when(F.contains("text", F.lit(m)) & (bare != m), F.struct("row_no", "tok_no", "value"))).alias(f"m{i}")
        for i, m in enumerate(markers)
    ]
    best = plausible.groupBy("id").agg(*found)
    value = F.coalesce(*[F.col(f"m{i}.value") for i in range(len(markers))])
    marker = F.coalesce(*[F.when(F.col(f"m{i}").isNotNull(), F.lit(m)) for i, m in enumerate(markers)])
    return best.select("id", value.alias("value"), marker.alias("marker")).filter("value IS NOT NULL")


def links(pages: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Anchors whose text has a term, with hrefs from the site root made absolute."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?s)(<a[ >].*?</a>)"), 1)
    a = pages.select("id", "url", F.posexplode(anchors).alias("pos", "anchor")).withColumns(
        {
            "text": strip_tags(F.col("anchor")),
            "href": F.regexp_extract("anchor", r'href="([^"]*)"', 1),
        }
    )
    root = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    target = (
        F.when(F.col("href").startswith("/"), F.concat(root, F.col("href")))
        .when(F.col("href") == "", F.col("url"))
        .otherwise(F.col("href"))
    )
    return a.filter((F.col("text") != "") & any_term(F.col("text"), terms)).select(
        "id", "pos", "text", target.alias("target")
    )


def meeting_dates(text: Column, today: Column, span_days: int = 400) -> Column:
    """Array of decision days: `Month d1-d2` takes d2 in the first year that fits."""
    # Fixed value: how calendar pages write a meeting.
    pattern = r"(?i)((?:" + "|".join(MONTHS) + r")\s+\d{1,2}\s*[-–]\s*\d{1,2})"
    parts = r"^(\w+)\s+\d{1,2}\s*[-–]\s*(\d{1,2})$"

    def day(fragment: Column) -> Column:
        month = month_number(F.regexp_extract(fragment, parts, 1))
        last = F.regexp_extract(fragment, parts, 2).try_cast("int")
        years = [safe_date(F.year(today) + k, month, last) for k in (0, 1)]
        return F.coalesce(
            *[F.when((d >= today) & (d <= F.date_add(today, span_days)), d) for d in years]
        )

    return F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), day), lambda d: d.isNotNull()
    )


def release_date(row_text: Column, today: Column, span_days: int = 200) -> Column:
    """`Month d, yyyy` in a row of text, if it is near enough."""
    pattern = r"(?i)(" + "|".join(MONTHS) + r")\s+(\d{1,2}),?\s+(\d{4})"
    day = safe_date(
        F.regexp_extract(row_text, pattern, 3).try_cast("int"),
        month_number(F.regexp_extract(row_text, pattern, 1)),
        F.regexp_extract(row_text, pattern, 2).try_cast("int"),
    )
    return F.when((day >= today) & (day <= F.date_add(today, span_days)), day)
