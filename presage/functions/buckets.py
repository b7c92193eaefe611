"""Interpretable bands of numbers, as CASE expressions. Null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def banded(x: Column, bands: list[tuple[str, float, str]], otherwise: str) -> Column:
    """The label of the first band that holds; a band is (operator, bound, label)."""
    tests = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for op, bound, label in bands:
        out = out.when(tests[op](x, F.lit(float(bound))), label)
    return out.otherwise(otherwise)


# The bounds and labels of each band.
BANDS: dict[str, tuple[list[tuple[str, float, str]], str]] = {
    "outcome": ([("<", -0.10, "disaster"), ("<", 0.0, "poor"), ("<", 0.07, "market"), ("<", 0.13, "good")], "great"),
    "momentum": ([(">=", 30, "strong"), ("<=", -10, "weak")], "neutral"),
    "volatility": ([(">=", 40, "high"), ("<=", 22, "low")], "medium"),
    "pe": ([("<", 0, "negative_earnings"), ("<", 15, "cheap"), ("<=", 30, "fair")], "expensive"),
    "growth": ([(">=", 0.15, "high"), ("<=", 0, "shrinking")], "moderate"),
    "leverage": ([("<", 0, "negative_equity"), ("<", 0.5, "low"), ("<=", 1.5, "moderate")], "high"),
    "roe": ([("<", 0, "negative"), (">=", 0.20, "high"), (">=", 0.10, "solid")], "low"),
    "return_20d": ([("<=", -10, "sharp_down"), ("<=", -3, "down"), ("<", 3, "flat"), ("<", 10, "up")], "sharp_up"),
    "reaction_3": ([("<=", -3, "down"), ("<", 3, "flat")], "up"),
    "reaction_1d": ([("<=", -2, "down"), ("<", 2, "flat")], "up"),
    "confidence": ([(">=", 0.50, "HIGH"), (">=", 0.30, "MEDIUM")], "LOW"),
    "gap_1yr": ([(">=", 4, "fundamentals"), ("<=", 1.5, "sentiment")], "mixed"),
}

OUTCOMES = ["disaster", "poor", "market", "good", "great"]


def bucket(name: str, x: Column) -> Column:
    bands, otherwise = BANDS[name]
    return banded(x, bands, otherwise)


def outcome_rank(label: Column) -> Column:
    """0 to 4 from disaster to great; null for anything else."""
    place = F.array_position(F.array(*[F.lit(c) for c in OUTCOMES]), label)
    return F.when(place > 0, (place - 1).cast("int"))


def verdict(gap_1yr: Column, gap_1d: Column, n_up: Column, n_down: Column, least: int = 40) -> Column:
    """What drives a theme, where day one reacts and both cohorts are large enough."""
    return F.when((gap_1d > 0) & (n_up >= least) & (n_down >= least), bucket("gap_1yr", gap_1yr))


def level(x: Column, edges: Column) -> Column:
    """L0, L1, ...: the number of edges at or below x."""
    return F.concat(F.lit("L"), F.size(F.filter(edges, lambda e: e <= x)).cast("string"))


def quantile_bin(x: Column, edges: Column) -> Column:
    """Right-closed bin between quantile edges, the lowest value included: edges strictly below x, from 1."""
    return F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e < x)))


def equal_count_bin(position: Column, n: Column, bins: int = 10) -> Column:
    """Bin from 0 of the position-th (from 1) of n rows: bins of max(1, n // bins), the rest in the last."""
    width = F.greatest(F.lit(1), F.floor(n / bins))
    return F.least(F.lit(bins - 1), F.floor((position - 1) / width)).cast("int")


def equal_width_bin(p: Column, bins: int = 10) -> Column:
    """Bin from 0 of a probability, bins (lo, hi], the first closed at 0."""
    return F.greatest(F.lit(0), F.ceil(p * bins) - 1).cast("int")


# Filled pips of five for each grade.
PIPS = {
    "market_position": {"dominant": 5, "strong": 4, "competitive": 3, "lagging": 1},
    "moat_strength": {"wide": 5, "narrow": 3, "none": 1},
    "market_quality": {"secular_growth": 5, "stable": 4, "cyclical": 3, "declining": 2, "disrupted": 1},
}


def pips(field: str, value: Column, default: int = 3) -> Column:
    """Filled pips of a grade; other values count as the default, null as null."""
    table = F.create_map(*[F.lit(x) for kv in PIPS[field].items() for x in kv])
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(table, value), F.lit(default)))
