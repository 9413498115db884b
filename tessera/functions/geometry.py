"""Boxes as structs (x0, y0, x1, y1) and what is computed from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(0.0)


def coverage(a: Column, b: Column) -> Column:
    """The part of ``a`` inside ``b``."""
    return share(intersection(a, b), area(a))


def containment(a: Column, b: Column) -> Column:
    """The intersection over the smaller box."""
    return share(intersection(a, b), F.least(area(a), area(b)))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    return share(both, area(a) + area(b) - both)


def from_points(points: Column) -> Column:
    """The box around an array of [x, y] points."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def to_polygon(b: Column) -> Column:
    return F.array(F.array(b["x0"], b["y0"]), F.array(b["x1"], b["y0"]), F.array(b["x1"], b["y1"]), F.array(b["x0"], b["y1"]))


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    """Pixels to points, or any other change of unit."""
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def extent(b: Column) -> Column:
    """Aggregate: the box around a group's boxes."""
    return box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"]))


def is_page_number(text: Column, b: Column, width: Column, height: Column, margin: float = 0.08, tolerance: float = 0.2) -> Column:
    """A short number in the top or bottom margin, near the middle."""
    t = F.trim(text)
    edge = (b["y1"] <= height * margin) | (b["y0"] >= height * (1 - margin))
    middle = F.abs((b["x0"] + b["x1"]) / 2 - width / 2) <= width * tolerance
    return edge & middle & t.rlike(r"^[\d\s()\[\]C]{1,5}$") & t.rlike(r"\d")


@F.pandas_udf(T.DoubleType())
def union_area(boxes: pd.Series) -> pd.Series:
    """Area covered by an array of boxes, overlaps counted once: strips between all x edges, merged in y."""

    def one(items) -> float:
        rects = [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in (items if items is not None else [])]
        edges, total = sorted({x for r in rects for x in (r[0], r[2])}), 0.0
        for left, right in zip(edges, edges[1:]):
            reached, covered = float("-inf"), 0.0
            for top, bottom in sorted((r[1], r[3]) for r in rects if r[0] < right and r[2] > left):
                covered += max(0.0, bottom - max(top, reached))
                reached = max(reached, bottom)
            total += (right - left) * covered
        return total

    return boxes.map(one)
