"""Names of kit colours by hue, saturation and value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hue (of 180), saturation and value (of 255), both ends included; the first that holds gives the name.
ANY, END = (0, 255), 255
KITS = [
    (ANY, ANY, (0, 41), "Black"),
    (ANY, (0, 31), (195, END), "White"),
    (ANY, (0, 31), (115, 194), "Grey"),
    (ANY, (0, 31), (0, 114), "Black"),
    ((98, 135), ANY, (0, 94), "Navy"),
    ((0, 8), ANY, (0, 89), "Maroon"),
    ((0, 8), ANY, ANY, "Red"),
    ((172, 180), ANY, (0, 89), "Maroon"),
    ((172, 180), ANY, ANY, "Red"),
    ((9, 23), ANY, (110, END), "Orange"),
    ((9, 23), ANY, ANY, "Brown"),
    ((24, 37), (0, 59), (181, END), "Cream"),
    ((24, 37), ANY, ANY, "Yellow"),
    ((38, 45), (121, END), (181, END), "Lime"),
    ((38, 83), ANY, (0, 179), "Green"),
    ((38, 83), ANY, ANY, "Bright Green"),
    ((84, 103), (101, END), (161, END), "Turquoise"),
    ((84, 103), ANY, (151, END), "Sky Blue"),
    ((84, 103), ANY, ANY, "Teal"),
    ((104, 133), (0, 129), (176, END), "Sky Blue"),
    ((104, 133), ANY, (0, 89), "Navy"),
    ((104, 133), (161, END), (131, END), "Royal Blue"),
    ((104, 133), ANY, ANY, "Blue"),
    ((134, 154), ANY, ANY, "Purple"),
    ((155, 171), ANY, ANY, "Pink"),
]
# Names of which two sides are told apart as light and dark blue.
BLUES = ("Blue", "Navy", "Sky Blue")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue from 0 to 179, saturation and value from 0 to 255, as whole numbers, of channels from 0 to 255."""
    r, g, b = (F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c.cast("double")))) for c in (r, g, b))
    most, gap = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    near = lambda v: F.floor(v + 0.5)
    turn = F.when(most == r, (g - b) / F.nullif(gap, F.lit(0))).when(most == g, (b - r) / F.nullif(gap, F.lit(0)) + 2).otherwise((r - g) / F.nullif(gap, F.lit(0)) + 4)
    hue = near(F.coalesce(30.0 * turn, F.lit(0.0)))
    return F.when(hue < 0, hue + 180).otherwise(hue), F.coalesce(near(255.0 * gap / F.nullif(most, F.lit(0))), F.lit(0)), most


def kit_name(r: Column, g: Column, b: Column) -> Column:
    """The name of a kit's colour; null where a channel is."""
    bound = F.transform(F.array(F.struct(*[c.alias(n) for c, n in zip(hsv(r, g, b), "hsv", strict=True)])), _named)  # an array, so that hue and saturation are worked out once
    return F.when(r.isNotNull() & g.isNotNull() & b.isNotNull(), F.get(bound, F.lit(0)))


def _named(c: Column) -> Column:
    holds = lambda rule: reduce(lambda x, y: x & y, (c[n].between(lo, hi) for n, (lo, hi) in zip("hsv", rule[:3], strict=True) if (lo, hi) != ANY))
    return reduce(lambda rest, rule: F.when(holds(rule), rule[3]).otherwise(rest), reversed(KITS), F.lit("Red"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def told_apart(first: Column, second: Column, light: Column) -> tuple[Column, Column]:
    """Names of two sides' colours, made different where they are the same. light: first's luminance less second's."""
    same = first == second
    blue = first.isin(*BLUES)
    shade = lambda own, brighter, lighter: F.when(~same, own).when(blue, F.when(lighter, "Sky Blue").otherwise("Navy")).otherwise(F.concat(F.when(brighter, "Light ").otherwise("Dark "), own))
    return shade(first, light > 0, light >= 0), shade(second, light <= 0, light < 0)
