"""Ratios, growth and returns as Column expressions; a missing or zero divisor gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presage.functions.buckets import BANDS


def ratio(a: Column, b: Column, digits: int | None = 4) -> Column:
    out = F.try_divide(a, b)
    return out if digits is None else F.round(out, digits)


def cagr(first: Column, last: Column, years: float) -> Column:
    """Yearly growth between two positive values."""
    return F.when((first > 0) & (last > 0), F.pow(last / first, F.lit(1.0 / years)) - 1)


def cagr_from_total_return(percent: Column, years: Column) -> Column:
    """Yearly growth from a total return in percent; null unless years > 0 and the loss is at most whole."""
    return F.when((years > 0) & (percent >= -100), F.pow(1 + percent / 100, 1 / years) - 1)


def backtest_cagr(percent: Column, years: Column) -> Column:
    """As above in percent, years at least 0.5, and 10 where unknown."""
    held = F.greatest(F.coalesce(years, F.lit(10.0)), F.lit(0.5))
    return (F.pow(1 + F.greatest(percent, F.lit(-100.0)) / 100, 1 / held) - 1) * 100


def floored_log_return(percent: Column) -> Column:
    return F.log1p(F.greatest(percent, F.lit(-99.0)) / 100)


def valuation(price: Column, shares: Column, income: Column, equity: Column) -> dict[str, Column]:
    cap = price * shares
    return {
        "market_cap": cap,
        "pe_ratio": F.try_divide(cap, F.nullif(income, F.lit(0.0))),
        "earnings_yield": F.try_divide(income, F.nullif(cap, F.lit(0.0))),
        "pb_ratio": F.when(equity > 0, F.try_divide(cap, equity)),
    }


def full_year(start: Column, end: Column) -> Column:
    """An instant (no start), or a period of 350 to 380 days."""
    return start.isNull() | F.datediff(end, start).between(350, 380)


def range_labels(years: Column) -> dict[str, Column]:
    """For each outcome, its range of total returns over so many years, as text."""

    def total(rate: float) -> Column:
        return F.format_string("%+.0f%%", (F.pow(F.lit(1 + rate), years) - 1) * 100)

    out, below = {}, None
    for _, ceiling, label in BANDS["outcome"][0]:
        out[label] = F.concat(F.lit("< "), total(ceiling)) if below is None else F.concat(total(below), F.lit(" to "), total(ceiling))
        below = ceiling
    return out | {"great": F.concat(F.lit(">= "), total(below))}
