"""The standard registry on one small landing folder, some of it missing or broken."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F

from tidemark.operators.health import source_health
from tidemark.operators.series import priority_value
from tidemark.sources.standard import standard_notes, standard_sources
from tests.test_sources import ROWS, chart


def test_whole_run(spark, tmp_path):
    land = tmp_path / "landing"

    def put(name, body):
        path = land / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")

    for i, (symbol, last) in enumerate([("XAUUSD=X", 2535.0), ("GC=F", 2537.0), ("USDINR=X", 84.0), ("DX-Y.NYB", 101.5), ("ZQ=F", 95.75)]):
        put(f"charts/{i}.json", chart(symbol, [last * 0.99, last], [100, 200], chartPreviousClose=last * 0.98))
    put("observations/DFII10.json", {"observations": [{"date": "2027-03-12", "value": "2.31"}, {"date": "2027-03-11", "value": "2.45"}]})
    put("observations/FEDFUNDS.json", {"observations": [{"date": "2027-03-10", "value": "4.40"}, {"date": "2027-02-10", "value": "4.50"}]})
    put("rates/r.html", "<table><tr><td>Gold 995</td><td>80,990</td></tr></table>")
    put("contracts/m.json", {"d": ROWS})
    put("fund_archive/f.csv", "Preamble\nDate,Tonnes\n20-May-2027,712.40\n19-May-2027,711.15\n")
    put("meetings/m.html", "<div>March</div><div>16-17</div>")
    put("releases/c.html", "<tr><td>June 2027</td><td>July 19, 2027</td></tr>")
    art = lambda t, u: {"title": t, "url": u, "seendate": "20270212T041500Z"}
    put("articles/a.json", {"articles": [art("Airstrike reported, embargo feared", "https://apnews.com/1"), art("Again", "https://apnews.com/1")]})
    put("policy_articles/p.json", {"articles": [art("Customs duty on gold lifted", "https://x.com/1"), art("Customs duty on timber", "https://x.com/2")]})
    put("policy_feeds/p.xml", "<rss><channel><item><title>Gold scheme</title><link>https://y.com/1</link></item></channel></rss>")
    put("bond_articles/b.json", {"articles": [art("Nothing here", "https://z.com/1")]})
    put("navs/n.txt", "1;a;-;Cedar Gold ETF;64.9;20-May-2027\n2;a;-;Dogwood Gold ETF;60.08;20-May-2027\n")

    runs = standard_sources(date(2027, 3, 15)).run(spark, str(land), str(tmp_path / "out"), "r1")
    ok = {r["source"]: r for r in runs.collect()}
    failed = {n for n, r in ok.items() if not r["ok"]}
    assert failed == {"silver", "positions", "official_sector", "feeds"}, {n: ok[n]["error"] for n in failed}
    assert ok["bonds"]["n_notes"] == 1 and ok["policy"]["n_headlines"] == 2 and ok["articles"]["n_headlines"] == 1
    health = source_health(runs, 6).first()
    assert not health["degraded"] and health["empty"] == "bonds"

    stored = spark.read.parquet(str(tmp_path / "out" / "readings"))
    picked = priority_value(
        stored.withColumn("id", F.monotonically_increasing_id()).withColumnRenamed("source_name", "source")
    )
    values = {r["series"]: r["value"] for r in picked.collect()}
    assert values["gold_usd_oz"] == 2535.0 and values["implied_policy_rate"] == 4.25 and values["us_event"] == 2.0
    assert values["ibja_inr_per_10g"] == 80990.0 and values["mcx_gold_inr_per_10g"] == 91740.5
    assert values["real_yield_10y"] == 2.31 and values["gld_tonnes_delta"] == 1.25
    assert abs(values["india_gold_etf_median_nav"] - (64.9 + 60.08) / 2) < 1e-4
    assert values["implied_cut_probability_pct"] == 60.0
    assert abs(values["gold_spot_future_divergence_pct"] - (2537.0 / 2535.0 - 1) * 100) < 1e-9
    notes = {(r["source"], r["note"]) for r in standard_notes(spark, str(land)).collect()}
    assert notes == {("bonds", "bond mentions: 0, signal: none"), ("policy", "duty named: Customs duty on gold lifted"), ("policy", "duty named: Customs duty on timber")}
    extra = stored.filter("series = 'real_yield_10y'").first()["extra"]
    assert json.loads(extra) == {"change_bp": -14.0}
    # Without the future there is one leg, and no cross-check.
    (land / "charts" / "1.json").unlink()
    alone = {r["note"] for r in standard_notes(spark, str(land)).filter("source = 'spot'").collect()}
    assert alone == {"only the spot resolved: no cross-check"}
    put("charts/1.json", chart("GC=F", [2500.0, 2600.0], [100, 200], chartPreviousClose=2500.0))
    apart = [r["note"] for r in standard_notes(spark, str(land)).filter("source = 'spot'").collect()]
    assert apart == ["DIVERGENCE: spot 2535.00 and future 2600.00 differ by 2.56%, allowed are 0.3%: the price is uncertain"]
    news = spark.read.parquet(str(tmp_path / "out" / "headlines")).filter("source_name = 'articles'").first()
    assert news["keywords"] == ["airstrike", "embargo"] and news["domain"] == "apnews.com"
