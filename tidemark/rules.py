"""Rules and parameters. Small by construction, so they may be broadcast."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULE_ROWS = 10_000  # a larger rule table has no broadcast hint


@dataclass(frozen=True)
class MoveRule:
    """A rolling-window move: kind is pct, bp, pp or abs."""

    trigger: str
    series: str
    kind: str
    window_hours: float
    threshold: float
    enabled: bool = True


@dataclass(frozen=True)
class ConflictRule:
    window_hours: float = 2.0
    min_sources: int = 3
    min_keywords: int = 2
    max_titles: int = 8
    trigger: str = "conflict_escalation"


@dataclass(frozen=True)
class Gate:
    """Rate limits for one subscriber; minutes are local minutes of the day."""

    tz: str = "Asia/Kolkata"
    tick_minutes: int = 30
    max_per_day: int = 3
    cooldown_hours: float = 6.0
    quiet_from: int = 120
    quiet_to: int = 360
    enabled: bool = True
    cooldowns: dict[str, float] = field(default_factory=dict)

    def cooldown_seconds(self, trigger: str) -> int:
        return round(self.cooldowns.get(trigger, self.cooldown_hours) * 3600)


@dataclass(frozen=True)
class TaxStack:
    """Import duty and cess add; the sales tax compounds on both."""

    duty_pct: float = 6.0
    cess_pct: float = 5.0
    gst_pct: float = 3.0

    @property
    def ex_gst(self) -> float:
        return 1.0 + (self.duty_pct + self.cess_pct) / 100.0

    @property
    def landed(self) -> float:
        return self.ex_gst * (1.0 + self.gst_pct / 100.0)

    @property
    def effective_pct(self) -> float:
        return (self.landed - 1.0) * 100.0


@dataclass(frozen=True)
class Prices:
    """Micro-dollars per token, so that ledger sums are exact integers."""

    input_micro: int = 3
    output_micro: int = 15
    per_run_cap_micro: int = 250_000
    daily_cap_micro: int = 1_500_000
    max_output_tokens: int = 2000


@dataclass(frozen=True)
class Season:
    name: str
    start: date
    end: date
    point: bool


# --- Fixed values -----------------------------------------------------------
# Configuration defaults that results depend on.

TROY_OUNCE_GRAMS = 31.1034768
PREMIUM_LIMIT_PCT = 4.0
REARM_MARGIN_PCT = 0.5
CROSS_CHECK_PCT = 0.3
STANDARD_MOVE_BP = 25.0
MIN_SOURCES_WITH_DATA = 6
RETENTION_DAYS = 400
CHANGE_FLOOR_PCT = 0.25
SEASON_LEAD_DAYS = 21
MUTE_CAP_HOURS = 24.0
LEVEL_BAND = (20_000.0, 1_000_000.0)
RATE_BAND = (40_000.0, 400_000.0)
TONNES_BAND = (200.0, 2_000.0)
NAV_BAND = (5.0, 2_000.0)
FUTURES_BAND = (90.0, 100.5)

DEFAULT_MOVE_RULES = (
    MoveRule("gold_move", "gold_usd_oz", "pct", 4, 1.2),
    MoveRule("dxy_move", "dxy", "pct", 24, 0.6),
    MoveRule("real_yield_move", "real_yield_10y", "bp", 24, 8),
    MoveRule("gold_silver_ratio", "gold_silver_ratio", "abs", 24, 2.0, enabled=False),
    MoveRule("rate_odds_shift", "implied_cut_probability_pct", "pp", 24, 10),
)
DEFAULT_GATE = Gate(
    cooldowns={
        "gold_move": 6,
        "dxy_move": 6,
        "real_yield_move": 12,
        "gold_silver_ratio": 12,
        "conflict_escalation": 6,
        "rate_odds_shift": 6,
        "inr_price_levels": 12,
    }
)
CONFLICT_KEYWORDS = (
    "strike",
    "airstrike",
    "missile",
    "invasion",
    "mobilisation",
    "ceasefire collapse",
    "sanctions",
    "embargo",
    "blockade",
    "nuclear",
    "martial law",
    "state of emergency",
)
INDEPENDENT_DOMAINS = (
    "reuters.com",
    "apnews.com",
    "aljazeera.com",
    "bbc.co.uk",
    "ft.com",
    "bloomberg.com",
    "kitco.com",
)
NEWS_TERMS = (
    "gold", "bullion", "xau", "precious metal", "silver",
    "real yield", "treasury yield", "tips", "breakeven",
    "fed", "fomc", "powell", "rate cut", "rate hike", "inflation", "cpi", "pce",
    "dollar", "dxy", "central bank", "reserves",
    "sanction", "embargo", "war", "strike", "missile", "conflict", "ceasefire",
    "rbi", "import duty", "customs duty", "gst",
)
POLICY_TERMS = (
    "import duty", "customs duty", "excise", "duty", "gst", "cess", "tariff",
    "rbi", "reserve bank", "notification", "hallmark", "budget", "levy",
    "monetisation", "monetization", "smuggling", "policy", "scheme",
)
GOLD_TERMS = ("gold", "bullion", "sgb", "sovereign gold bond")
DUTY_TERMS = ("import duty", "customs duty", "gst", "cess", "tariff")
BOND_TERMS = ("sovereign gold bond", "sgb")
ISSUANCE_TERMS = ("tranche", "subscription", "issue price", "series", "open for subscription")
PAUSE_TERMS = (
    "discontinued", "no further", "halted", "paused", "not issue", "premature redemption",
)
CENTRAL_BANK_TERMS = (
    "central bank", "official sector", "reserves", "demand", "tonne", "purchase",
)
SCHEME_INCLUDE = ("gold",)
SCHEME_EXCLUDE = (
    "fund of fund", "fof", "multi asset", "multi-asset", "silver",
    "equity", "savings", "hybrid", "balanced",
)
SCHEME_REQUIRE = ("etf", "exchange traded")
PURITIES = (995, 999, 916, 750)
TWO_PART_TLDS = ("co.uk", "com.au", "co.in", "co.jp", "com.br", "co.za", "org.uk")
STALENESS_HOURS = {
    "price": 6.0,
    "fx": 6.0,
    "macro": 48.0,
    "etf_flows": 72.0,
    "cot": 240.0,
    "central_bank": 1080.0,
    "news": 12.0,
}
ASOF_LIMIT_DAYS = {"macro": 4, "tonnes": 3, "positions": -1}
PRESENTATION_ORDER = (
    ("real_yield_10y", "US 10Y real yield (TIPS)"),
    ("nominal_yield_10y", "US 10Y nominal yield"),
    ("breakeven_inflation_10y", "10Y breakeven inflation"),
    ("fed_funds_rate", "Effective fed funds rate"),
    ("implied_policy_rate", "Futures-implied policy rate"),
    ("implied_cut_probability_pct", "Implied share of a 25bp cut priced"),
    ("dxy", "US dollar index"),
    ("gold_usd_oz", "Gold spot"),
    ("gold_future_usd_oz", "Gold front-month future"),
    ("gold_spot_future_divergence_pct", "Spot/future divergence"),
    ("gold_inr_per_10g", "Gold INR per 10g (all-in, derived)"),
    ("gold_inr_per_10g_ex_gst", "Gold INR per 10g (ex-GST, derived)"),
    ("ibja_inr_per_10g", "IBJA published rate"),
    ("mcx_gold_inr_per_10g", "MCX gold front-month"),
    ("india_physical_premium_pct", "India physical premium vs derived (ex-GST basis)"),
    ("usdinr", "USD/INR"),
    ("silver_usd_oz", "Silver spot"),
    ("gold_silver_ratio", "Gold/silver ratio"),
    ("cot_managed_money_net_long", "COT managed money net long"),
    ("gld_tonnes", "GLD tonnes held"),
    ("gld_tonnes_delta", "GLD tonnes change"),
    ("india_gold_etf_median_nav", "India gold ETF median NAV"),
)
SEASONS = (
    Season("Akshaya Tritiya", date(2027, 4, 28), date(2027, 4, 28), True),
    Season("Dhanteras", date(2026, 11, 7), date(2026, 11, 7), True),
    Season("Diwali", date(2026, 11, 9), date(2026, 11, 9), True),
    Season("wedding season (peak)", date(2026, 10, 15), date(2027, 3, 15), False),
)
# --- End of fixed values ----------------------------------------------------


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A configuration table, with a broadcast hint if its size allows it.

    The hint stays with the table through projections, so the jobs that join it need
    none of their own; a table that comes from elsewhere is joined as Spark sees fit.
    """
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= MAX_RULE_ROWS else out


def move_rule_table(spark: SparkSession, rules: tuple[MoveRule, ...]) -> DataFrame:
    return small_table(
        spark,
        [
            (r.trigger, r.series, r.kind, float(r.window_hours), float(r.threshold), r.enabled)
            for r in rules
        ],
        "trigger string, series string, kind string, window_hours double, "
        "threshold double, enabled boolean",
    )


def budget_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(STALENESS_HOURS.items()), "category string, budget_hours double")


def limit_table(spark: SparkSession) -> DataFrame:
    """How old an observation of a kind of series may be without being dated in a brief."""
    return small_table(spark, list(ASOF_LIMIT_DAYS.items()), "kind string, limit_days int")


def order_table(spark: SparkSession) -> DataFrame:
    rows = [(series, place, label) for place, (series, label) in enumerate(PRESENTATION_ORDER, 1)]
    return small_table(spark, rows, "series string, place int, label string")


def season_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, [(s.name, s.start, s.end, s.point) for s in SEASONS], "name string, start date, end date, point boolean")
