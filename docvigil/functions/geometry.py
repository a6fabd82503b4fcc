"""Column expressions on boxes (structs of x, y, width, height, and perhaps unit and origin)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docvigil.functions.values import finite

UNITS = ("pt", "px", "mm")


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def clip(b: Column, width: Column, height: Column) -> Column:
    """The part of a box on its page; null if nothing is left."""
    left, top = F.greatest(b["x"], F.lit(0.0)), F.greatest(b["y"], F.lit(0.0))
    right, low = F.least(b["x"] + b["width"], width), F.least(b["y"] + b["height"], height)
    return F.when((right > left) & (low > top), box(left, top, right - left, low - top))


def contains(a: Column, b: Column) -> Column:
    return (b["x"] >= a["x"]) & (b["y"] >= a["y"]) & (b["x"] + b["width"] <= a["x"] + a["width"]) & (b["y"] + b["height"] <= a["y"] + a["height"])


def share_row(a: Column, b: Column) -> Column:
    """Overlapping vertically, with tops within half of the lower height, 4 at least."""
    return overlap_y(a, b) & (F.abs(a["y"] - b["y"]) <= F.greatest(F.lit(4.0), F.least(a["height"], b["height"]) / 2))


def overlap_x(a: Column, b: Column) -> Column:
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"])


def overlap_y(a: Column, b: Column) -> Column:
    return (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def outside(b: Column, width: Column, height: Column) -> Column:
    return (b["x"] < 0) | (b["y"] < 0) | (b["x"] + b["width"] > width) | (b["y"] + b["height"] > height)


def anchor_ok(page: Column, b: Column) -> Column:
    """Whether page and box name a place: page from 1, finite, not negative, not empty."""
    good = (page > 0) & finite(b["x"]) & finite(b["y"]) & finite(b["width"]) & finite(b["height"])
    return F.coalesce(good & (b["x"] >= 0) & (b["y"] >= 0) & (b["width"] > 0) & (b["height"] > 0), F.lit(False))


def flip_origin(b: Column, page_height: Column) -> Column:
    """A box measured from the bottom left, from the top left."""
    return box(b["x"], page_height - b["y"] - b["height"], b["width"], b["height"])
