"""Price and cost column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.rules import STANDARD_MOVE_BP, TROY_OUNCE_GRAMS, Prices, TaxStack


def per_ten_grams(spot: Column, fx: Column) -> Column:
    return spot * fx / F.lit(TROY_OUNCE_GRAMS) * F.lit(10.0)


def ex_tax_cost(spot: Column, fx: Column, tax: TaxStack) -> Column:
    return per_ten_grams(spot, fx) * F.lit(tax.ex_gst)


def landed_cost(spot: Column, fx: Column, tax: TaxStack) -> Column:
    return per_ten_grams(spot, fx) * F.lit(tax.landed)


def stacked_cost(base: Column, duty: Column, cess: Column, tax: Column) -> Column:
    """The same stack with per-row fractional rates: duty and cess add, tax compounds."""
    return base * (1.0 + duty + cess) * (1.0 + tax)


def premium_pct(quote: Column, cost: Column) -> Column:
    return (F.try_divide(quote, cost) - 1.0) * 100.0


def divergence_pct(first: Column, second: Column) -> Column:
    return F.abs(F.try_divide(second, first) - 1.0) * 100.0


def compounded_pct(first: Column, second: Column) -> Column:
    return ((1 + first / 100.0) * (1 + second / 100.0) - 1.0) * 100.0


def directions_differ(first: Column, second: Column) -> Column:
    return (first > 0) != (second > 0)


def implied_rate(price: Column) -> Column:
    return F.lit(100.0) - price


def cut_probability(effective: Column, implied: Column) -> Column:
    """Share of one standard move that is priced in, clamped to 0-100."""
    share = (effective - implied) * 100.0 / F.lit(STANDARD_MOVE_BP) * 100.0
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / F.lit(3.5)).cast("bigint")


def call_micro(input_tokens: Column, output_tokens: Column, prices: Prices) -> Column:
    """Price of a call in whole micro-dollars."""
    return input_tokens * F.lit(prices.input_micro) + output_tokens * F.lit(prices.output_micro)


def cached_call_usd(
    input_tokens: Column,
    output_tokens: Column,
    cache_read: Column,
    cache_write: Column,
    prices: Prices,
) -> Column:
    """Cache reads bill at a tenth of input, writes at five quarters; six decimals."""
    # In twentieths of a micro-dollar all terms are whole, so halves round exactly.
    twentieths = (
        call_micro(input_tokens, output_tokens, prices) * 20
        + cache_read * F.lit(prices.input_micro * 2)
        + cache_write * F.lit(prices.input_micro * 25)
    )
    return F.round(twentieths / F.lit(20.0), 0) / F.lit(1e6)
