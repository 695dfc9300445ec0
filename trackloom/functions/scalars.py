"""Scalar expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    """value held within [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def finite(value: Column) -> Column:
    """value, or null for NaN and infinities."""
    return F.when(F.abs(value) < float("inf"), value)


def seconds(text: Column) -> Column:
    """Seconds of H:M:S, M:S or S; null if it isn't one of these."""
    part = F.split(F.trim(text), ":")
    fine = F.forall(part, lambda p: p.rlike(r"^\s*\d+(\.\d*)?\s*$"))
    number = F.transform(part, lambda p: F.trim(p).cast("double"))
    total = F.when(F.size(part) == 1, F.get(number, F.lit(0))).when(F.size(part) == 2, F.get(number, F.lit(0)) * 60 + F.get(number, F.lit(1))).when(F.size(part) == 3, F.get(number, F.lit(0)) * 3600 + F.get(number, F.lit(1)) * 60 + F.get(number, F.lit(2)))
    return F.when(text.isNotNull() & fine, total)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(value, -30, 30)))


def colour_name(hex_colour: Column) -> Column:
    """A name for '#rrggbb' by simple rules on its channels; 'unknown' for anything else."""
    r, g, b = (F.conv(F.substring(hex_colour, i, 2), 16, 10).cast("int") for i in (2, 4, 6))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    rules = [
        (most < 60, "black"),
        (least > 200, "white"),
        (most - least < 30, "grey"),
        ((r == most) & (g > 150) & (b < 120), "yellow"),
        ((r == most) & (g > 90) & (b < 90), "orange"),
        ((r == most) & (b > 120), "pink"),
        (r == most, "red"),
        (g == most, "green"),
        ((b == most) & (r > 110), "purple"),
        ((b == most) & (g > 150), "sky"),
    ]
    named = reduce(lambda c, rule: F.when(rule[0], rule[1]).otherwise(c), reversed(rules), F.lit("blue"))
    return F.when(hex_colour.rlike("^#[0-9a-fA-F]{6}$"), named).otherwise("unknown")


def run_fields(run_id: Column) -> dict[str, Column]:
    """window, seed and severity of ids such as 0_60s_seed72_moderate."""
    pattern = r"^(.+)_seed(\d+)_(clean|mild|moderate|severe)$"
    part = lambda i: F.nullif(F.regexp_extract(run_id, pattern, i), F.lit(""))
    return {"window": part(1), "seed": part(2).cast("int"), "severity": part(3)}
