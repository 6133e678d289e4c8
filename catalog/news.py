"""Headline and text queries over pages, documents and orders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.base import query
from catalog.tables import ARTICLES_SQL, PAGES_SQL, articles, pages, table
from tidemark.functions.dates import first_date
from tidemark.functions.numbers import clean_number
from tidemark.functions.text import word_count
from tidemark.operators import filters, headlines
from tidemark.rules import small_table
from tidemark.sources import markup

TERMS_A = ("license", "copyright", "tion of", "password")
TERMS_B = ("the", "und", "que")
WORDS = ("the", "and", "les", "der", "und", "que", "of the", "license")


@query(
    "relevance_any",
    f"""WITH {ARTICLES_SQL} SELECT id, lang FROM a
    WHERE regexp_matches(lower(text), '{"|".join(TERMS_A)}')""",
)
def _any(spark, folder):
    return filters.relevant_any(articles(spark, folder), F.col("text"), TERMS_A).select("id", "lang")


@query(
    "relevance_and",
    f"""WITH {ARTICLES_SQL} SELECT id, lang FROM a WHERE regexp_matches(lower(text), '{"|".join(TERMS_A)}')
    AND regexp_matches(lower(text), '{"|".join(TERMS_B)}')""",
)
def _both(spark, folder):
    return filters.relevant_both(articles(spark, folder), F.col("text"), TERMS_A, TERMS_B).select("id", "lang")


@query(
    "scheme_filter",
    """SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'ring|bolt')
    AND NOT regexp_matches(lower(p_name), 'small|old') AND regexp_matches(lower(p_name), 'red|hot')""",
)
def _scheme(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    return filters.scheme_filter(part, "p_name", ("ring", "bolt"), ("small", "old"), ("red", "hot"))


@query(
    "plausible_band",
    """WITH b(series, lo, hi) AS (VALUES ('click', 10.0, 90.0), ('view', 5.0, 200.0), ('error', 40.0, 60.0))
    SELECT event_id AS id, event_type AS series, value FROM events LEFT JOIN b ON b.series = event_type
    WHERE b.series IS NULL OR value BETWEEN lo AND hi""",
)
def _band(spark, folder):
    bands = small_table(
        spark, [("click", 10.0, 90.0), ("view", 5.0, 200.0), ("error", 40.0, 60.0)], "series string, lo double, hi double"
    )
    e = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("series"), "value")
    return filters.plausible_by_series(e, bands).select("id", "series", "value")


@query(
    "term_signals",
    f"""WITH {ARTICLES_SQL}, f AS (SELECT domain, regexp_matches(lower(text), 'license|password') AS s,
      regexp_matches(lower(text), 'permission|granted') AS o, regexp_matches(lower(text), 'secret|token') AS p FROM a),
    g AS (SELECT domain, count(*) FILTER (s) AS mentions, bool_or(s AND o) AS o, bool_or(s AND p) AS p FROM f GROUP BY 1)
    SELECT domain, mentions, CASE WHEN mentions = 0 THEN 'none' WHEN o AND p THEN 'both' WHEN o THEN 'issuance'
      WHEN p THEN 'pause' ELSE 'unclear' END AS signal FROM g""",
)
def _signals(spark, folder):
    return headlines.term_signals(
        articles(spark, folder), F.col("text"), ("license", "password"), ("permission", "granted"),
        ("secret", "token"), "domain",
    )


@query(
    "flag_terms",
    f"""WITH {ARTICLES_SQL} SELECT domain, id, title, CAST(row_number() OVER (PARTITION BY domain ORDER BY id)
      AS INTEGER) AS rank FROM a WHERE regexp_matches(lower(text), 'license|copyright') QUALIFY rank <= 4""",
)
def _flags(spark, folder):
    out = headlines.flagged(articles(spark, folder), F.col("text"), ("license", "copyright"), ["domain"], ["id"])
    return out.select("domain", "id", "title", "rank")


@query(
    "keyword_tags",
    f"""WITH {ARTICLES_SQL}, k(kw, pat) AS (VALUES {", ".join(
        f"('{w}', '{w}')" if " " in w else f"('{w}', '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])')" for w in WORDS)})
    SELECT lang, kw AS keyword, count(*) AS n FROM a, k WHERE regexp_matches(lower(text), pat) GROUP BY 1, 2""",
)
def _tags(spark, folder):
    return headlines.keyword_counts(articles(spark, folder), F.col("text"), WORDS, ["lang"])


@query("domain_rollup", f"WITH {PAGES_SQL} SELECT domain, count(*) AS pages, min(id) AS first_id FROM h GROUP BY 1")
def _domains(spark, folder):
    return pages(spark, folder).groupBy("domain").agg(F.count("*").alias("pages"), F.min("id").alias("first_id"))


@query(
    "dedupe_first",
    f"""WITH {PAGES_SQL} SELECT site, id, url, title FROM h
    QUALIFY row_number() OVER (PARTITION BY site ORDER BY id % 3, id) = 1""",
)
def _dedupe(spark, folder):
    p = pages(spark, folder).select("site", "id", "url", "title", (F.col("id") % 3).alias("topic"))
    return headlines.dedupe_first(p, "site", ["topic", "id"]).drop("topic")


@query(
    "headline_novelty",
    f"""WITH {PAGES_SQL} SELECT id, site FROM h n WHERE id % 2 = 1
    AND NOT EXISTS (SELECT 1 FROM h o WHERE o.id % 2 = 0 AND o.site = n.site)""",
)
def _novelty(spark, folder):
    p = pages(spark, folder).select("id", "site")
    return headlines.unseen(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"), "site").select("id", "site")


@query(
    "topk_headlines",
    f"""WITH {PAGES_SQL}, m AS (SELECT id, domain, title, NOT EXISTS (SELECT 1 FROM h o WHERE o.id % 2 = 0
      AND o.site = n.site) AS is_new FROM h n WHERE id % 2 = 1)
    SELECT id, domain, title, is_new, CAST(row_number() OVER (PARTITION BY domain, is_new ORDER BY id) AS INTEGER) AS rank
    FROM m QUALIFY rank <= CASE WHEN is_new THEN 25 ELSE 10 END""",
)
def _topk(spark, folder):
    p = pages(spark, folder).select("id", "site", "domain", "title")
    marked = headlines.mark_new(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"), "site")
    return headlines.capped(marked, by=["domain"]).select("id", "domain", "title", "is_new", "rank")


@query(
    "recent_headlines",
    f"""WITH {PAGES_SQL} SELECT id, url, first_seen FROM h WHERE first_seen >= TIMESTAMP '2024-01-02 00:00:00'""",
)
def _recent(spark, folder):
    out = headlines.recent(pages(spark, folder), datetime(2024, 1, 4), 48)
    return out.select("id", "url", "first_seen")


@query(
    "over_length",
    """WITH w AS (SELECT doc_id AS id, len(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+'))
      AS words FROM documents) SELECT id, CAST(words AS INTEGER) AS words FROM w WHERE words > 450 * 1.15""",
)
def _over(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), word_count(F.col("text")).alias("words"))
    return d.filter(F.col("words") > 450 * 1.15)


NUMBER = r"[$₹]?[0-9][^\s]*( [a-z]+)?"


@query(
    "clean_numbers",
    f"""WITH t AS (SELECT doc_id AS id, regexp_extract(text, '{NUMBER}') AS raw FROM documents),
    c AS (SELECT *, regexp_extract(trim(regexp_replace(raw, '[,₹$% ]', '', 'g')), '^(\\S*)', 1) AS tok FROM t WHERE raw <> '')
    SELECT id, raw, CASE WHEN regexp_full_match(tok, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')
      THEN try_cast(tok AS DOUBLE) END AS value FROM c""",
)
def _clean(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract("text", NUMBER, 0).alias("raw"))
    return d.filter("raw <> ''").withColumn("value", clean_number(F.col("raw")))


@query(
    "parse_dates",
    """WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d-%b-%Y')
        WHEN 1 THEN strftime(o_orderdate, '%d-%b-%y') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
        WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y')
        ELSE 'week ' || strftime(o_orderdate, '%d') END AS raw FROM orders)
    SELECT id, raw, CAST(try_strptime(raw, ['%d-%b-%y', '%d-%b-%Y', '%m/%d/%Y', '%Y-%m-%d', '%d/%m/%Y']) AS DATE)
      AS day FROM t""",
)
def _dates(spark, folder):
    kinds = ["dd-MMM-yyyy", "dd-MMM-yy", "MM/dd/yyyy", "yyyy-MM-dd", "dd/MM/yyyy"]
    raw = F.concat(F.lit("week "), F.date_format("o_orderdate", "dd"))
    for i, kind in enumerate(kinds):
        raw = F.when(F.col("o_orderkey") % 6 == i, F.date_format("o_orderdate", kind)).otherwise(raw)
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))
    return o.withColumn("day", first_date(F.col("raw")))


@query(
    "scan_html_rows",
    """WITH x AS (SELECT page_id AS id, unnest(regexp_extract_all(html, '(<p[ >].*?</p>)', 1, 's')) AS r,
        generate_subscripts(regexp_extract_all(html, '(<p[ >].*?</p>)', 1, 's'), 1) AS row_no FROM pages),
    t AS (SELECT id, row_no, trim(regexp_replace(regexp_replace(r, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM x),
    k AS (SELECT id, row_no, text, unnest(regexp_extract_all(text, '(\\d[\\d,]*\\.?\\d*)', 1)) AS token,
        generate_subscripts(regexp_extract_all(text, '(\\d[\\d,]*\\.?\\d*)', 1), 1) AS tok_no FROM t),
    v AS (SELECT *, try_cast(replace(token, ',', '') AS DOUBLE) AS value FROM k),
    m AS (SELECT v.id, mk.marker, mk.p, value, row_number() OVER (PARTITION BY id ORDER BY p, row_no, tok_no) AS n
      FROM v, (VALUES ('555', 1), ('the', 2), ('a', 3)) mk(marker, p)
      WHERE contains(text, marker) AND replace(token, ',', '') <> marker AND value BETWEEN 10 AND 100000)
    SELECT id, value, marker FROM m WHERE n = 1""",
)
def _html_rows(spark, folder):
    return markup.html_rate(pages(spark, folder), ("555", "the", "a"), (10.0, 100_000.0), tag="p")


@query(
    "scan_links",
    """WITH x AS (SELECT page_id AS id, url, unnest(regexp_extract_all(html, '(<a[ >].*?</a>)', 1, 's')) AS r,
        generate_subscripts(regexp_extract_all(html, '(<a[ >].*?</a>)', 1, 's'), 1) AS n FROM pages),
    t AS (SELECT id, url, CAST(n - 1 AS INTEGER) AS pos, regexp_extract(r, 'href="([^"]*)"', 1) AS href,
        trim(regexp_replace(regexp_replace(r, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM x)
    SELECT id, pos, text, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href
      WHEN href = '' THEN url ELSE href END AS target FROM t WHERE regexp_matches(lower(text), 'th|un|en')""",
)
def _links(spark, folder):
    return markup.links(pages(spark, folder), ("th", "un", "en"))
