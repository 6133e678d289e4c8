"""Sections of the brief, the run decision and the notes in the cases the tables don't hold."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.operators.health import last_brief
from tidemark.plans.brief import brief_facts, headline_facts, now_report, reading_facts
from tidemark.plans.derived import cross_note, derive_columns, derived_notes, season_notes
from tidemark.plans.scan import run_decision
from tidemark.rules import TaxStack

NOW = datetime(2026, 8, 20, 12)


def test_reading_with_every_field(spark):
    latest = spark.createDataFrame([("a", 12_345_678.9, "t", "s"), ("b", 1234.5, "pt", "s")], "series string, value double, unit string, source string")
    changes = spark.createDataFrame(
        [("a", 1.234, -14.0, 1.25, -12345.0, "2026-08-19", "provisional")],
        "series string, change_pct double, change_bp double, delta double, week_change double, observed string, caveat string",
    )
    order = spark.createDataFrame([("b", 1, "Bees")], "series string, place int, label string")
    got = [r["text"] for r in reading_facts(latest, changes, order).orderBy("ord", "key").collect()]
    assert got == [
        "- Bees: 1,234.50 pt, source: s",
        "- a: 12,345,679 t (session +1.23%) (-14.0bp vs prior print) (delta +1.25t) (week -12,345), source: s"
        " [observation date 2026-08-19] [caveat: provisional]",
    ]


def marked(spark, rows):
    return spark.createDataFrame(rows, "id bigint, domain string, title string, url string, is_new boolean")


def test_headlines_count_all_and_show_the_first(spark):
    rows = [(i, "d", f"t{i}", f"u{i}", i % 3 > 0) for i in range(30)]
    got = {(r["section"], r["ord"]): r["text"] for r in headline_facts(marked(spark, rows), 2, 1).collect()}
    assert got == {
        ("headlines_new", 0): "new since the last run: 20", ("headlines_new", 1): "- [d] t1 (u1)",
        ("headlines_new", 2): "- [d] t2 (u2)", ("headlines_known", 0): "seen in an earlier run: 10",
        ("headlines_known", 1): "- [d] t0",
    }
    none = headline_facts(marked(spark, [])).collect()
    assert [(r["section"], r["text"]) for r in none] == [("headlines_new", "new since the last run: none")]


def test_previous_text_with_its_age(spark):
    at = lambda h, m=0: datetime(2026, 8, 20, h, m)
    rows = [
        (1, "morning", at(11, 30), " still flat "), (1, "alert", at(11, 50), "spike"), (2, "evening", datetime(2026, 8, 17), "up"),
        (3, "morning", at(9), None), (4, "morning", at(8), "a"), (4, "evening", at(8), "b"),
    ]
    briefs = spark.createDataFrame(rows, "subscriber bigint, mode string, ts timestamp, text string")
    empty = lambda schema: spark.createDataFrame([], schema)
    calendar = spark.createDataFrame([(date(2026, 8, 22), "prices", "bureau", 2)], "day date, name string, source string, days_away int")
    facts = brief_facts(
        empty("section string, ord int, key string, text string"), empty("series string, rendered string, direction_pct double"),
        empty("section string, ord int, key string, text string"), empty("source string, detail string"),
        last_brief(briefs), calendar, spark.createDataFrame([("bonds", "none named")], "source string, note string"), NOW,
    )
    assert {(r["section"], r["ord"], r["text"]) for r in facts.collect()} == {
        ("previous", 0, "- morning, 30m ago: still flat"), ("previous", 0, "- evening, 4d ago: up"),
        ("previous", 0, "- none on record"), ("previous", 0, "- evening, 4h ago: b"),
        ("calendar", 2, "- prices: 2026-08-22 (in 2d), source: bureau"), ("notes", 0, "- bonds: none named"),
    }


def test_run_decisions(spark):
    day = datetime(2026, 8, 17, 20)  # Monday, and Tuesday in India
    runs = spark.createDataFrame(
        [("r", "morning", day), ("r", "evening", day), ("r", "weekly", day), ("r", "odd", day), ("r", "off", day), ("x", "morning", day)],
        "run_id string, mode string, ts timestamp",
    )
    schedule = spark.createDataFrame(
        [("morning", True, ["tue"], False), ("evening", True, ["tue"], True), ("weekly", True, ["mon"], False), ("off", False, ["tue"], False)],
        "mode string, enabled boolean, days array<string>, only_if_changed boolean",
    )
    health = spark.createDataFrame([("r", 9, False)], "run_id string, data_count bigint, degraded boolean")
    quiet = spark.createDataFrame([("r", "evening", True), ("r", "morning", True)], "run_id string, mode string, quiet boolean")
    got = {(r["run_id"], r["mode"]): r["decision"] for r in run_decision(runs, health, quiet, schedule, "Asia/Kolkata").collect()}
    assert got == {
        ("r", "morning"): "brief", ("r", "evening"): "skip", ("r", "weekly"): "not_scheduled", ("r", "odd"): "off",
        ("r", "off"): "off", ("x", "morning"): "degraded",
    }


def test_cross_notes(spark):
    legs = spark.createDataFrame([(100.0, 100.2), (100.0, 101.0), (100.0, None), (None, 5.0), (0.0, 5.0), (None, None)], "spot double, future double")
    got = [r[0] for r in legs.select(cross_note(F.col("spot"), F.col("future"))).collect()]
    assert got == [
        None, "DIVERGENCE: spot 100.00 and future 101.00 differ by 1.00%, allowed are 0.3%: the price is uncertain",
        "only the spot resolved: no cross-check", "only the future resolved: no cross-check",
        "only the future resolved: no cross-check", None,
    ]


def test_notes_and_now_report(spark):
    rows = [(NOW, 100.0, 101.0, 2.0, 0.0, None, 1.5, -2.0)]
    aligned = spark.createDataFrame(rows, "ts timestamp, spot double, future double, fx double, silver double, quote double, spot_change double, fx_change double")
    wide = derive_columns(aligned, TaxStack())
    seasons = spark.createDataFrame(
        [("fair", date(2026, 8, 1), date(2026, 8, 31), False), ("feast", date(2026, 8, 25), date(2026, 8, 25), True), ("far", date(2026, 12, 1), date(2026, 12, 1), True)],
        "name string, start date, end date, point boolean",
    )
    notes = {r["source"]: r["note"] for r in derived_notes(wide, seasons, "Asia/Kolkata").collect()}
    assert set(notes) == {"cross", "directions", "season"}
    assert notes["season"] == "seasonal demand: fair is active (to 2026-08-31); feast in 5d (2026-08-25)"
    report = {r["leg"]: (r["change_pct"], r["note"] is not None) for r in now_report(wide).collect()}
    assert report == {"gold": (1.5, True), "landed": (None, False), "ex_tax": (None, False), "fx": (-2.0, False)}
    assert now_report(wide.limit(0)).count() == 0 and season_notes(spark.createDataFrame([], "day date"), seasons).count() == 0
