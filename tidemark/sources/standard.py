"""The standard sources: sixteen jobs from landing folders to readings and headlines.

Each reads `landing/<folder>`; a missing folder or an unreadable body is that source's
error row and nobody else's. The order of registration is the priority when two sources
give the same series.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.money import divergence_pct
from tidemark.functions.numbers import in_band
from tidemark.functions.text import any_term, keyword_hits
from tidemark.operators.filters import relevant_any, relevant_both, scheme_filter
from tidemark.operators.headlines import dedupe_first, flagged, term_signals
from tidemark.operators.series import basis_point_change, exact_median, flow_delta, front_month, net_position
from tidemark.plans.derived import cross_note, implied_odds
from tidemark.sources import files, markup
from tidemark.sources.registry import Registry
from tidemark.sources.sinks import exists

# --- Fixed values: symbols and series of the market feeds, with their units ----
QUOTES = {
    "spot": (("XAUUSD=X", "gold_usd_oz", "USD/oz"), ("GC=F", "gold_future_usd_oz", "USD/oz")),
    "fx": (("USDINR=X", "usdinr", "INR per USD"),),
    "dollar": (("DX-Y.NYB", "dxy", "index"),),
    "silver": (("SI=F", "silver_usd_oz", "USD/oz"),),
}
RATE_FUTURE = "ZQ=F"
EFFECTIVE_RATE = "FEDFUNDS"
YIELDS = {
    "DFII10": "real_yield_10y",
    "DGS10": "nominal_yield_10y",
    "T10YIE": "breakeven_inflation_10y",
    "FEDFUNDS": "fed_funds_rate",
}
CATEGORIES = {
    "spot": "price", "physical": "price", "fx": "fx", "dollar": "fx", "silver": "price", "yields": "macro",
    "calendar": "macro", "holdings": "etf_flows", "positions": "cot", "official_sector": "central_bank",
    "articles": "news", "feeds": "news", "policy": "news", "fund_navs": "price", "bonds": "india",
    "rate_futures": "macro",
}
# --- End of fixed values --------------------------------------------------------


def _readings(df: DataFrame, series: Column, value: Column, unit: str, ts: Column, extra: Sequence[str] = ()) -> DataFrame:
    note = F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")
    return df.select(
        series.alias("series"),
        ts.cast("timestamp").alias("ts"),
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        note.alias("extra"),
    )


def _headlines(df: DataFrame, keywords: Column | None = None) -> DataFrame:
    has = set(df.columns)
    text = lambda c: F.col(c) if c in has else F.lit("")
    return df.select(
        "url",
        "title",
        "domain",
        text("summary").alias("summary"),
        "published_at",
        (F.array().cast("array<string>") if keywords is None else keywords).alias("keywords"),
    )


def _newest(df: DataFrame) -> DataFrame:
    """Newest day of each series, by a maximum rather than a sort."""
    row = F.max_by(F.struct(*[F.col(c) for c in df.columns]), "day")
    return df.groupBy(F.col("series").alias("_s")).agg(row.alias("r")).select("r.*")


def _news(spark: SparkSession, landing: str, name: str) -> DataFrame:
    """Articles and feed items of one source, first occurrence of a url."""
    a = files.scan_articles(spark, f"{landing}/{name}_articles").select(
        "url", "title", "domain", F.lit("").alias("summary"), "published_at", F.lit(0).alias("kind"), "topic", "pos"
    )
    f = files.scan_feed_items(spark, f"{landing}/{name}_feeds").select(
        "url", "title", "domain", "summary", "published_at", F.lit(1).alias("kind"), F.col("feed").alias("topic"), "pos"
    )
    return dedupe_first(a.unionByName(f), "url", ["kind", "topic", "pos"])


def _both_legs(quotes: DataFrame) -> DataFrame:
    """One row: the last price of spot and of the future, null for a leg that is not there."""
    leg = lambda k: F.max_by(F.when(F.col("series") == QUOTES["spot"][k][0], F.col("last")), F.when(F.col("series") == QUOTES["spot"][k][0], F.col("ts")))
    return quotes.agg(leg(0).alias("spot"), leg(1).alias("future"), F.max("ts").alias("ts"))


def _divergence(quotes: DataFrame) -> DataFrame:
    """How far the future is from spot, if both legs are there; wide gaps say so."""
    gap = _both_legs(quotes).withColumn("gap", divergence_pct(F.col("spot"), F.col("future"))).filter("gap IS NOT NULL")
    wide = gap.withColumn("uncertain", F.col("gap") > rules.CROSS_CHECK_PCT)
    return _readings(wide, F.lit("gold_spot_future_divergence_pct"), F.col("gap"), "%", F.col("ts"), ["uncertain"])


def cross_check_notes(spark: SparkSession, landing: str) -> DataFrame:
    """(note): legs that lie too far apart, or the one leg that came."""
    quotes = files.scan_quotes(spark, f"{landing}/charts")
    both = _both_legs(quotes.filter(F.col("series").isin(*[s for s, _m, _u in QUOTES["spot"]])))
    return both.select(cross_note(F.col("spot"), F.col("future")).alias("note"))


def _text() -> Column:
    return F.concat_ws(" ", "title", "summary")


def standard_sources(today: date, purity: int = 995) -> Registry:
    reg = Registry()

    def quote_job(name: str):  # noqa: ANN202 - a source job
        def job(spark: SparkSession, landing: str) -> DataFrame:
            quotes = files.scan_quotes(spark, f"{landing}/charts")
            named = F.create_map(*[F.lit(x) for s, metric, _u in QUOTES[name] for x in (s, metric)])
            kept = quotes.filter(F.col("series").isin(*[s for s, _m, _u in QUOTES[name]]))
            out = _readings(
                kept, F.try_element_at(named, F.col("series")), F.col("last"), QUOTES[name][0][2], F.col("ts"),
                ["previous", "change_pct"],
            )
            return out.unionByName(_divergence(kept)) if name == "spot" else out

        return job

    def physical(spark: SparkSession, landing: str) -> DataFrame:
        order = [str(p) for p in dict.fromkeys((purity, *rules.PURITIES))]
        pages = spark.read.text(f"{landing}/rates", wholetext=True).select(
            F.col("_metadata.file_path").alias("id"), F.col("value").alias("html"),
            F.col("_metadata.file_modification_time").alias("at"),
        )
        rate = markup.html_rate(pages, order, rules.RATE_BAND).join(pages.select("id", "at"), "id")
        quoted = _readings(rate, F.lit("ibja_inr_per_10g"), F.col("value"), "INR/10g", F.col("at"), ["marker"])
        contract = front_month(files.scan_contracts(spark, f"{landing}/contracts"))
        future = _readings(
            contract, F.lit("mcx_gold_inr_per_10g"), F.col("price"), "INR/10g", F.lit(today), ["expiry_text"]
        )
        return quoted.unionByName(future)

    def yields(spark: SparkSession, landing: str) -> DataFrame:
        changed = _newest(basis_point_change(files.scan_observations(spark, f"{landing}/observations")))
        named = F.create_map(*[F.lit(x) for pair in YIELDS.items() for x in pair])
        out = changed.filter(F.col("series").isin(*YIELDS))
        return _readings(out, F.try_element_at(named, F.col("series")), F.col("value"), "%", F.col("day"), ["change_bp"])

    def calendar(spark: SparkSession, landing: str) -> DataFrame:
        meetings = files.scan_calendar(spark, f"{landing}/meetings", today, releases=False)
        releases = files.scan_calendar(spark, f"{landing}/releases", today, releases=True)
        near = meetings.unionByName(releases).filter(F.col("day") <= F.date_add(F.lit(today), 7))
        away = F.date_diff("day", F.lit(today))
        return _readings(near.withColumn("days_away", away), F.lit("us_event"), away, "days away", F.col("day"), ["name", "days_away"])

    def holdings(spark: SparkSession, landing: str) -> DataFrame:
        last = _newest(flow_delta(files.scan_preamble_csv(spark, f"{landing}/fund_archive")))
        level = _readings(last, F.lit("gld_tonnes"), F.col("value"), "tonnes", F.col("day"), ["delta", "delta_5"])
        delta = _readings(
            last.filter("delta IS NOT NULL"), F.lit("gld_tonnes_delta"), F.col("delta"), "tonnes", F.col("day"), ["days_between"]
        )
        return level.unionByName(delta)

    def positions(spark: SparkSession, landing: str) -> DataFrame:
        last = _newest(net_position(files.scan_positions(spark, f"{landing}/positions")))
        return _readings(
            last, F.lit("cot_managed_money_net_long"), F.col("net"), "contracts", F.col("day"),
            ["week_change", "percentile_in_window"],
        )

    def official_sector(spark: SparkSession, landing: str) -> DataFrame:
        news = _news(spark, landing, "official")
        # Feeds of the body itself pass whole; the wider sweep needs a term.
        return _headlines(news.filter((F.col("kind") == 1) | any_term(F.col("title"), rules.CENTRAL_BANK_TERMS)))

    def articles(spark: SparkSession, landing: str) -> DataFrame:
        first = dedupe_first(files.scan_articles(spark, f"{landing}/articles"), "url", ["topic", "pos"])
        return _headlines(first, keyword_hits(F.col("title"), rules.CONFLICT_KEYWORDS))

    def feeds(spark: SparkSession, landing: str) -> DataFrame:
        items = files.scan_feed_items(spark, f"{landing}/feeds")
        kept = relevant_any(items, _text(), rules.NEWS_TERMS)
        return _headlines(dedupe_first(kept, "url", ["feed", "pos"]), keyword_hits(_text(), rules.CONFLICT_KEYWORDS))

    def policy(spark: SparkSession, landing: str) -> DataFrame:
        news = _news(spark, landing, "policy")
        # Policy words are kept apart from conflict keywords: rule sets tag for themselves.
        return _headlines(relevant_both(news, F.col("title"), rules.GOLD_TERMS, rules.POLICY_TERMS))

    def fund_navs(spark: SparkSession, landing: str) -> DataFrame:
        navs = scheme_filter(
            files.scan_navs(spark, f"{landing}/navs"), "scheme", rules.SCHEME_INCLUDE, rules.SCHEME_EXCLUDE, rules.SCHEME_REQUIRE
        )
        return _readings(
            exact_median(navs, "nav"), F.lit("india_gold_etf_median_nav"), F.round("median_value", 4), "INR/unit",
            F.lit(today), ["n", "min_value", "max_value"],
        )

    def bonds(spark: SparkSession, landing: str) -> DataFrame:
        found = relevant_any(files.scan_articles(spark, f"{landing}/bond_articles"), F.col("title"), rules.BOND_TERMS)
        return _headlines(dedupe_first(found, "url", ["topic", "pos"]))

    def rate_futures(spark: SparkSession, landing: str) -> DataFrame:
        price = files.scan_quotes(spark, f"{landing}/charts").filter(F.col("series") == RATE_FUTURE)
        kept = price.filter(in_band(F.col("last"), rules.FUTURES_BAND))
        rate = _readings(kept, F.lit("implied_policy_rate"), F.round(100.0 - F.col("last"), 4), "%", F.col("ts"), ["last"])
        observed = f"{landing}/observations"
        if not exists(spark, observed):
            return rate
        # The effective rate in force; without one there is no share of a cut.
        prints = files.scan_observations(spark, observed).filter(F.col("series") == EFFECTIVE_RATE)
        effective = _newest(prints).select(F.col("value").alias("effective"))
        legs = kept.select(F.col("last").alias("price"), "ts", F.lit(1).alias("_k")).join(effective.withColumn("_k", F.lit(1)), "_k")
        odds = implied_odds(legs)
        share = _readings(
            odds, F.lit("implied_cut_probability_pct"), F.col("cut_probability"), "%", F.col("ts"), ["expected_cut_bp", "effective"]
        )
        return rate.unionByName(share)

    jobs = {
        "spot": quote_job("spot"), "physical": physical, "fx": quote_job("fx"), "dollar": quote_job("dollar"),
        "silver": quote_job("silver"), "yields": yields, "calendar": calendar, "holdings": holdings,
        "positions": positions, "official_sector": official_sector, "articles": articles, "feeds": feeds,
        "policy": policy, "fund_navs": fund_navs, "bonds": bonds, "rate_futures": rate_futures,
    }
    news = {"official_sector", "articles", "feeds", "policy", "bonds"}
    quiet = {
        "calendar": "no release in the next seven days",
        "physical": "no physical reference this run",
        "official_sector": "nothing new",
        "articles": "no matching articles",
        "feeds": "no relevant items",
        "policy": "no policy items",
        "bonds": "no mentions found",
    }
    for name, job in jobs.items():
        reg.source(name, CATEGORIES[name], "headlines" if name in news else "readings", quiet.get(name))(job)
    return reg


def standard_notes(spark: SparkSession, landing: str) -> DataFrame:
    """(source, note): how the two price legs agree, what the bond mentions say, and the policy
    titles that name a duty.

    A landing folder that is missing has no notes.
    """
    out = spark.createDataFrame([], "source string, note string")
    if exists(spark, f"{landing}/charts"):
        legs = cross_check_notes(spark, landing).filter("note IS NOT NULL")
        out = out.unionByName(legs.select(F.lit("spot").alias("source"), "note"))
    if exists(spark, f"{landing}/bond_articles"):
        found = files.scan_articles(spark, f"{landing}/bond_articles").withColumn("source", F.lit("bonds"))
        said = term_signals(found, F.col("title"), rules.BOND_TERMS, rules.ISSUANCE_TERMS, rules.PAUSE_TERMS, "source")
        line = F.concat(F.lit("bond mentions: "), F.col("mentions").cast("string"), F.lit(", signal: "), "signal")
        out = out.unionByName(said.select("source", line.alias("note")))
    if exists(spark, f"{landing}/policy_articles") and exists(spark, f"{landing}/policy_feeds"):
        found = _news(spark, landing, "policy").withColumn("source", F.lit("policy"))
        duty = flagged(found, F.col("title"), rules.DUTY_TERMS, ["source"], ["kind", "topic", "pos"])
        out = out.unionByName(duty.select("source", F.concat(F.lit("duty named: "), "title").alias("note")))
    return out
