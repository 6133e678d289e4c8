"""Column expressions on worked examples."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, money, numbers, text
from tidemark.plans.derived import derive_columns, implied_odds, season_flags
from tidemark.rules import SEASONS, TaxStack, small_table


def one(spark, column, **values):
    rows = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return rows.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("1,06,850", 106850.0), ("₹1,06,850", 106850.0), ("905.82 tonnes", 905.82), ("1.78%", 1.78),
        ("$3401.20 USD", 3401.2), ("12d", None), ("NaN", None), ("", None), (".", None), (None, None), ("-4.5", -4.5),
        ("1 234", 1234.0),
    ],
)
def test_clean_number(spark, raw, want):
    assert one(spark, numbers.clean_number(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://feeds.reuters.com/x", "reuters.com"), ("https://www.bbc.co.uk/news/x", "bbc.co.uk"),
        ("not a url", ""), ("", ""), ("http://localhost/x", "localhost"), ("https://WWW.Ft.com", "ft.com"),
    ],
)
def test_domain(spark, url, want):
    assert one(spark, text.domain_of(F.lit(url))) == want


def test_keywords(spark):
    hits = lambda t, k: one(spark, text.keyword_hits(F.lit(t), k))
    assert hits("An airstrike was reported", ["strike"]) == []
    assert hits("Strike! A STRIKE and martial law.", ["martial law", "strike", "strike"]) == ["martial law", "strike"]
    assert hits("été strikeé", ["strike"]) == []


def test_relevance(spark):
    both = text.any_term(F.lit("India raises import duty on steel"), ("gold",)) & text.any_term(
        F.lit("India raises import duty on steel"), ("import duty",)
    )
    assert one(spark, both) is False
    assert one(spark, text.any_term(F.lit("a.b"), ("a.b",))) is True
    assert one(spark, text.any_term(F.lit("axb"), ("a.b",))) is False


@pytest.mark.parametrize(("raw", "want"), [("4h", 4.0), ("90m", 1.5), ("2", 2.0), ("1.5h", 1.5), ("soon", None), ("", None)])
def test_duration(spark, raw, want):
    assert one(spark, dates.duration_hours(F.lit(raw))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("15-Aug-2026", date(2026, 8, 15)), ("15-Aug-98", date(1998, 8, 15)), ("08/15/2026", date(2026, 8, 15)),
        ("2026-08-15", date(2026, 8, 15)), ("15/08/2026", date(2026, 8, 15)), ("next week", None),
    ],
)
def test_file_dates(spark, raw, want):
    assert one(spark, dates.first_date(F.lit(raw))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("05DEC2026", date(2026, 12, 5)), ("05-Dec-2026", date(2026, 12, 5)), ("05 dec 2026", date(2026, 12, 5)),
        ("2026-12-05", date(2026, 12, 5)), ("31FEB2026", None), ("front-month", None),
    ],
)
def test_expiry(spark, raw, want):
    assert one(spark, dates.expiry_date(F.lit(raw))) == want


def test_seen_stamps(spark):
    want = datetime(2026, 8, 17, 6, 30)
    for raw in ("20260817T063000Z", "20260817063000", "2026-08-17T06:30:00Z"):
        assert one(spark, dates.first_timestamp(F.lit(raw)).cast("timestamp_ntz")) == want


@pytest.mark.parametrize(("hour", "want"), [(23, True), (1, True), (3, False), (6, True)])
def test_window_wraps_midnight(spark, hour, want):
    assert one(spark, dates.in_daily_window(F.lit(hour * 60), 360, 120)) is want


def test_age_text(spark):
    assert [one(spark, dates.age_text(F.lit(h))) for h in (0.5, 47.4, 72.0)] == ["30m", "47h", "3d"]


def test_tax_stack_and_landed_cost(spark):
    tax = TaxStack()
    assert tax.landed == pytest.approx(1.1433)
    assert tax.effective_pct == pytest.approx(14.33)
    got = one(spark, money.landed_cost(F.lit(3400.0), F.lit(87.5), tax))
    assert got == pytest.approx(3400 * 87.5 / 31.1034768 * 10 * 1.11 * 1.03)


def test_derived_figures(spark):
    legs = spark.createDataFrame(
        [
            (1, 3400.0, None, 40.0, 87.5, 1.09 * 3400 * 87.5 / 31.1034768 * 10 * 1.11, -0.40, 0.65),
            (2, 0.0, 3430.0, 40.0, 87.5, None, 1.0, 1.0),
            (3, 3400.0, 3403.0, 0.0, None, None, None, 1.0),
            (4, 3400.0, 3430.0, 40.0, 87.5, None, None, None),
        ],
        "ts int, spot double, future double, silver double, fx double, quote double, spot_change double, fx_change double",
    )
    r = {x["ts"]: x for x in derive_columns(legs, TaxStack()).collect()}
    assert r[1]["ratio"] == 85.0 and r[1]["premium"] == 9.0 and r[1]["premium_wide"]
    assert r[1]["diverging"] is True
    assert r[2]["gold"] == 3430.0 and r[2]["inr_change"] == 2.01 and r[2]["diverging"] is False
    assert r[3]["landed"] is None and r[3]["ratio"] is None and r[3]["diverging"] is None
    assert r[3]["cross"] == pytest.approx(0.0882) and not r[3]["cross_wide"]
    assert r[4]["cross"] == pytest.approx(0.8824) and r[4]["cross_wide"]


def test_implied_odds(spark):
    legs = spark.createDataFrame([(96.25, 3.875), (95.0, 3.0), (50.0, 3.0)], "price double, effective double")
    got = [tuple(r)[2:] for r in implied_odds(legs).collect()]
    assert got == [(3.75, 12.5, 50.0), (5.0, -200.0, 0.0)]


def test_seasons(spark):
    days = spark.createDataFrame([(date(2026, 10, 20),), (date(2026, 11, 9),), (date(2026, 9, 1),)], "day date")
    rows = [(s.name, s.start, s.end, s.point) for s in SEASONS]
    seasons = small_table(spark, rows, "name string, start date, end date, point boolean")
    got = {(r["day"].isoformat(), r["name"]): (r["state"], r["days_ahead"]) for r in season_flags(days, seasons).collect()}
    assert got[("2026-10-20", "Dhanteras")] == ("ahead", 18)
    assert got[("2026-10-20", "wedding season (peak)")] == ("active", None)
    assert got[("2026-11-09", "Diwali")] == ("ahead", 0)
    assert not [k for k in got if k[0] == "2026-09-01"]


def test_round_levels(spark):
    assert one(spark, numbers.round_levels(F.lit(3401.0), 50)) == [3250.0, 3300.0, 3350.0, 3400.0, 3450.0, 3500.0, 3550.0]
    assert one(spark, numbers.round_levels(F.lit(75.0), 50)) == [50.0, 100.0, 150.0, 200.0, 250.0]  # half to even: 100


def test_token_and_call_price(spark):
    from tidemark.rules import Prices

    assert one(spark, money.token_estimate(F.lit(7000))) == 2000
    usd = money.cached_call_usd(F.lit(1000), F.lit(100), F.lit(1000), F.lit(1000), Prices())
    assert one(spark, usd) == pytest.approx((1000 * 3 + 100 * 15 + 1000 * 0.3 + 1000 * 3.75) / 1e6)


def test_large_rule_tables_have_no_hint(spark):
    hinted = lambda n: "broadcast" in small_table(spark, [(i,) for i in range(n)], "i int")._jdf.queryExecution().logical().toString().lower()
    assert hinted(10) and not hinted(10_001)
