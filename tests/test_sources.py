"""Landing-folder scans on small bodies, the registry, and the sinks."""

from __future__ import annotations

import json
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.filters import scheme_filter
from tidemark.operators.series import exact_median, flow_delta, front_month, net_position
from tidemark.rules import SCHEME_EXCLUDE, SCHEME_INCLUDE, SCHEME_REQUIRE
from tidemark.sources import files, markup, sinks
from tidemark.sources.registry import Registry


def put(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")
    return str(path)


def test_observations_skip_placeholders(spark, tmp_path):
    put(tmp_path, "real.json", {"count": 3, "observations": [
        {"date": "2027-02-12", "value": "2.31"}, {"date": "2027-02-11", "value": "2.45"}, {"date": "2027-02-10", "value": "2.47"}]})
    put(tmp_path, "gaps.json", {"observations": [
        {"date": "2027-02-13", "value": "."}, {"date": "2027-02-12", "value": ""}, {"date": "2027-02-11", "value": "2.05"},
        {"date": "bad", "value": "9"}, {"date": "2027-02-10", "value": "2.14"}]})
    got = {(r["series"], r["day"].isoformat()): r["value"] for r in files.scan_observations(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and got[("real", "2027-02-10")] == 2.47 and got[("gaps", "2027-02-11")] == 2.05


def test_positions(spark, tmp_path):
    row = lambda d, lo, sh: {"report_date_as_yyyy_mm_dd": d, "cftc_contract_market_code": "700001",
                             "m_money_positions_long_all": lo, "m_money_positions_short_all": sh, "open_interest_all": "640,900"}
    put(tmp_path, "p.json", [row("2027-02-09T00:00:00.000", "301250", "71040"), row("2027-02-02T00:00:00.000", "287400", "80150"), row("2027-01-26", "n/a", "1")])
    df = files.scan_positions(spark, str(tmp_path))
    assert df.count() == 2 and df.first()["open_interest"] == 640900
    last = net_position(df).orderBy(F.desc("day")).first()
    assert (last["net"], last["week_change"]) == (230210, 22960)


def chart(symbol, closes, stamps, **meta):
    return {"chart": {"result": [{"meta": {"symbol": symbol, **meta}, "timestamp": stamps, "indicators": {"quote": [{"close": closes}]}}]}}


def test_bars_and_quotes(spark, tmp_path):
    put(tmp_path, "a.json", chart("A", [2510.0, None, 2535.1, None], [100, 200, 300, 400], chartPreviousClose=2510.0))
    put(tmp_path, "b.json", chart("B", [10.0, None, 12.0], [100, 200, 300]))
    put(tmp_path, "c.json", chart("C", [], [], regularMarketPrice=7.0))
    assert files.scan_bars(spark, str(tmp_path)).count() == 4
    q = {r["series"]: r for r in files.scan_quotes(spark, str(tmp_path)).collect()}
    assert q["A"]["last"] == 2535.1 and q["A"]["change_pct"] == pytest.approx(1.0, abs=1e-9)
    assert q["A"]["ts"].replace(tzinfo=UTC).timestamp() == 400
    assert (q["B"]["last"], q["B"]["previous"]) == (12.0, 10.0)
    assert (q["C"]["last"], q["C"]["previous"], q["C"]["change_pct"]) == (7.0, None, None)


def test_articles(spark, tmp_path):
    put(tmp_path, "one.json", {"articles": [
        {"url": "https://www.reuters.com/a", "title": "A", "seendate": "20270212T041500Z", "domain": "reuters.com"},
        {"url": "", "title": "no url"}, {"url": "https://x.com/b", "title": " "},
        {"url": "https://feeds.bbc.co.uk/c", "title": "C", "seendate": "soon"}]})
    put(tmp_path, "two.json", {"articles": [{"url": "https://www.reuters.com/a", "title": "A again"}]})
    df = files.scan_articles(spark, str(tmp_path))
    first = {r["url"]: r for r in files.first_by_topic(df, ["two", "one"]).collect()}
    assert len(first) == 2 and first["https://www.reuters.com/a"]["title"] == "A again"
    assert first["https://feeds.bbc.co.uk/c"]["domain"] == "bbc.co.uk" and first["https://feeds.bbc.co.uk/c"]["published_at"] is None


ROWS = [
    {"Symbol": "GOLD", "ExpiryDate": "11DEC2027", "LTP": "92350.00"}, {"Symbol": "gold", "ExpiryDate": "09OCT2027", "LTP": "", "ClosePrice": "91,740.50"},
    {"Symbol": "SILVER", "ExpiryDate": "09OCT2027", "LTP": "77120"}, {"Symbol": "GOLDM", "ExpiryDate": "09OCT2027", "LTP": "91700"},
    {"symbol": "GOLD", "expiryDate": "09SEP2027", "ltp": "12"},
]


@pytest.mark.parametrize("body", [{"d": ROWS}, {"d": json.dumps(ROWS)}, {"data": ROWS}, {"d": [], "data": ROWS}])
def test_contracts(spark, tmp_path, body):
    put(tmp_path, "m.json", body)
    got = front_month(files.scan_contracts(spark, str(tmp_path))).collect()
    assert [(r["expiry_text"], r["price"]) for r in got] == [("09OCT2027", 91740.5)]


def test_preamble_csv(spark, tmp_path):
    put(tmp_path, "fund.csv", "Archive of a fund\nReport 19-May-2027,x,y,999\n\n"
        "Date,Value,Ounces,Tonnes held\n20-May-2027,4711.00,12.5,712.40\n"
        '19-May-2027,"4,690.00",12.4,711.15\nHoliday,,,\n18-May-2027,1,1,709.00\n17-May-2027,1,1,708.20\n'
        "14-May-2027,1,1,707.75\n13-May-2027,1,1,704.10\n12-May-2027,1,1,5\n")
    put(tmp_path, "other.csv", "Tonnes,Ounces,As of date\n455.25,1,05/20/2027\n")
    df = files.scan_preamble_csv(spark, str(tmp_path))
    assert df.groupBy("series").count().orderBy("series").collect() == [("fund", 6), ("other", 1)]
    last = flow_delta(df.filter("series = 'fund'")).orderBy(F.desc("day")).first()
    assert (last["delta"], last["delta_5"], last["days_between"]) == (1.25, 8.3, 1)


def test_navs(spark, tmp_path):
    put(tmp_path, "nav.txt", "Scheme Code;ISIN;ISIN2;Scheme Name;Net Asset Value;Date\n\nOpen Ended Schemes(Gold ETF)\n\n"
        "1;a;-;Alder ETF Gold Units;61.2504;20-May-2027\n2;a;-;Birch Gold Exchange Traded Fund;63.1042;20-May-2027\n"
        "3;a;-;Cedar Gold ETF;64.9;20-May-2027\n4;a;-;Dogwood Gold Exchange Traded Fund;60.08;20-May-2027\n"
        "5;a;-;Gold Savings Fund of Fund ETF;17.2;20-May-2027\n6;a;Silver ETF;1;2\n7;a;-;Elm Silver ETF;44.1;20-May-2027\n8;a;-;X Gold ETF;N.A.;d\n")
    kept = scheme_filter(files.scan_navs(spark, str(tmp_path)), "scheme", SCHEME_INCLUDE, SCHEME_EXCLUDE, SCHEME_REQUIRE)
    got = exact_median(kept, "nav").first()
    assert got["n"] == 4 and got["median_value"] == pytest.approx((61.2504 + 63.1042) / 2)


def test_feeds(spark, tmp_path):
    items = "".join(f"<item><title>T{i}</title><link>https://www.reuters.com/{i}</link><description>{'d' * 500}</description>"
                    f"<pubDate>Fri, 12 Feb 2027 04:15:00 GMT</pubDate></item>" for i in range(30))
    put(tmp_path, "news.xml", f'<?xml version="1.0"?><rss version="2.0"><channel><title>N</title>{items}<item><title/><link>https://x.com</link></item></channel></rss>')
    got = files.scan_feed_items(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["title"] for r in got] == [f"T{i}" for i in range(30)]
    assert len(got[0]["summary"]) == 500 and got[0]["published_at"].replace(tzinfo=UTC) == datetime(2027, 2, 12, 4, 15, tzinfo=UTC)
    atom = tmp_path / "atom"
    atom.mkdir()
    put(atom, "a.xml", '<feed><entry><title>E</title><link href="https://ft.com/e"/><updated>2027-02-12T04:15:00Z</updated></entry></feed>')
    entry = files.scan_feed_items(spark, str(atom), atom=True).first()
    assert (entry["url"], entry["domain"]) == ("https://ft.com/e", "ft.com") and entry["published_at"] is not None


def test_html_rates(spark):
    rate = lambda html, markers=("995", "999"): markup.html_rate(
        spark.createDataFrame([(1, html)], "id bigint, html string"), markers, (40_000.0, 400_000.0)).collect()
    page = "<table><tr><th>Purity</th></tr><tr><td>Gold 999</td><td>81,350</td></tr><tr><td>Gold 995</td>\n<td>80,990</td></tr></table>"
    assert [(r["value"], r["marker"]) for r in rate(page)] == [(80990.0, "995")]
    assert [(r["value"], r["marker"]) for r in rate(page, ("750", "999"))] == [(81350.0, "999")]
    assert rate("<div>no rates today</div>") == []


def test_calendars(spark, tmp_path):
    put(tmp_path, "cpi.html", "<table><tr><th>Month</th></tr><tr><td>January 2027</td><td>March 12, 2027</td></tr><tr><td>x</td><td>February 31, 2028</td></tr>"
        "<tr><td>February 2027</td><td>April 14, 2027</td></tr><tr><td>December 2026</td><td>February 10, 2027</td></tr></table>")
    today = date(2027, 3, 8)
    got = {r["day"] for r in files.scan_calendar(spark, str(tmp_path), today, True).collect()}
    assert got == {date(2027, 3, 12), date(2027, 4, 14)}
    meet = tmp_path / "meet"
    meet.mkdir()
    put(meet, "m.html", "<div>February</div><div>2-3</div><div>March</div>\n<div>16-17</div><div>April</div><div>27–28</div>")
    got = {r["day"] for r in files.scan_calendar(spark, str(meet), today, False).collect()}
    assert got == {date(2028, 2, 3), date(2027, 3, 17), date(2027, 4, 28)}


def test_registry_isolates_sources(spark, tmp_path):
    reg = Registry()

    @reg.source("good", "price")
    def good(spark, _folder):
        return spark.createDataFrame([("s", datetime(2026, 8, 17), 1.0, "u"), ("s", datetime(2026, 8, 17), None, "u")], "series string, ts timestamp, value double, unit string")

    @reg.source("breaks", "price")
    def breaks(_spark, _folder):
        raise OSError("down")

    @reg.source("late_break", "price")
    def late_break(spark, _folder):
        return good(spark, "").withColumn("value", F.raise_error(F.lit("bad row")).cast("double"))

    @reg.source("silent", "news", "headlines")
    def silent(spark, _folder):
        return spark.createDataFrame([], "url string, title string, domain string")

    @reg.source("nothing_found", "news", "headlines", note_when_empty="nothing new")
    def nothing_found(spark, _folder):
        return silent(spark, "")

    @reg.source("wrong_shape", "fx")
    def wrong_shape(spark, _folder):
        return spark.range(1)

    runs = {r["source"]: r for r in reg.run(spark, "in", str(tmp_path), "r1").collect()}
    assert {k for k, r in runs.items() if r["ok"]} == {"good", "nothing_found"}
    assert runs["good"]["n_readings"] == 1 and runs["nothing_found"]["n_notes"] == 1
    assert runs["silent"]["error"] == "returned nothing" and "missing" in runs["wrong_shape"]["error"]
    assert spark.read.parquet(f"{tmp_path}/readings").select("source_name").distinct().collect() == [("good",)]


def test_upsert_keeps_first_and_overwrites_rest(spark, tmp_path):
    path = f"{tmp_path}/h"
    cols = "url string, domain string, source string, published_at timestamp, first_seen timestamp, title string, summary string, keywords array<string>, pos bigint"
    t = datetime(2026, 8, 17)
    sinks.upsert_headlines(spark, path, spark.createDataFrame([("u1", "d", "s1", t, t, "old", "", ["a"], 0), ("u2", "d", "s1", t, t, "keep", "", [], 1)], cols))
    later = t + timedelta(days=1)
    sinks.upsert_headlines(spark, path, spark.createDataFrame([("u1", "e", "s2", later, later, "new", "x", ["b"], 0), ("u3", "f", "s3", later, later, "n1", "", [], 1), ("u3", "g", "s4", later, later, "n2", "", [], 2)], cols))
    got = {r["url"]: r for r in sinks.headlines(spark, path).collect()}
    assert (got["u1"]["title"], got["u1"]["domain"], got["u1"]["first_seen"], got["u1"]["keywords"]) == ("new", "d", t, ["b"])
    assert got["u2"]["title"] == "keep" and (got["u3"]["title"], got["u3"]["domain"]) == ("n2", "f")


def test_spend_accumulates(spark, tmp_path):
    path = f"{tmp_path}/spend"
    cols = "day date, cost_micro bigint, calls bigint"
    for batch in ([(date(2026, 8, 1), 5, 1), (date(2026, 9, 1), 7, 1)], [(date(2026, 8, 1), 3, 2)]):
        sinks.add_spend(spark, path, spark.createDataFrame(batch, cols))
    got = {r["day"].month: (r["cost_micro"], r["calls"]) for r in spark.read.parquet(path).collect()}
    assert got == {8: (8, 3), 9: (7, 1)}


# The last one lies after every row of its own date.
@pytest.mark.parametrize("cutoff", [datetime(2026, 8, 3), datetime(2026, 8, 3, 12), datetime(2026, 8, 3, 20)])
def test_prune_is_strict(spark, tmp_path, cutoff):
    path = f"{tmp_path}/r"
    stamps = [datetime(2026, 8, d, h) for d in (1, 2, 3, 4) for h in (0, 6, 12, 18)]
    df = spark.createDataFrame([("s", t, 1.0) for t in stamps], "series string, ts timestamp, value double")
    sinks.append_readings(df, path)
    assert sinks.expired(spark.read.parquet(path), cutoff).count() == sum(t < cutoff for t in stamps)
    sinks.prune(spark, path, cutoff)
    assert sorted(r["ts"] for r in spark.read.parquet(path).collect()) == [t for t in stamps if t >= cutoff]
