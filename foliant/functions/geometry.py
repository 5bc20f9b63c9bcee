"""Box geometry on struct columns with fields x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(box: Column) -> Column:
    return F.greatest(F.lit(0), box["x2"] - box["x1"]) * F.greatest(F.lit(0), box["y2"] - box["y1"])


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if disjoint."""
    shared = intersection(a, b)
    return F.when(shared > 0, shared / (area(a) + area(b) - shared)).otherwise(F.lit(0.0))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return intersection(a, b) / (F.least(area(a), area(b)) + 1e-5)


def contains(box: Column, x: Column, y: Column) -> Column:
    """A point in a box, bounds included."""
    return x.between(box["x1"], box["x2"]) & y.between(box["y1"], box["y2"])


def summary(points: Column) -> Column:
    """The box of a quadrilateral given as array of [x, y]: whole-number bounds, size and halved centre."""
    xs, ys = F.transform(points, lambda p: F.get(p, 0).cast("int")), F.transform(points, lambda p: F.get(p, 1).cast("int"))
    x, y, x2, y2 = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    half = lambda v: F.floor(v / 2).cast("int")
    return F.struct(
        x.alias("x"), y.alias("y"), x2.alias("x2"), y2.alias("y2"), (x2 - x).alias("width"), (y2 - y).alias("height"),
        half(x + x2).alias("center_x"), half(y + y2).alias("center_y"),
    )


def padded(box: Column, pad: int, width: Column, height: Column) -> Column:
    """The box with a margin, kept on the page."""
    return F.struct(
        F.greatest(F.lit(0), box["x1"] - pad).alias("x1"), F.greatest(F.lit(0), box["y1"] - pad).alias("y1"),
        F.least(width, box["x2"] + pad).alias("x2"), F.least(height, box["y2"] + pad).alias("y2"),
    )


def union_coverage(boxes: Column, width: Column, height: Column) -> Column:
    """The share of a page that its boxes cover, each spot once: between neighbouring x bounds, the covered y lengths.

    boxes: an array of box structs, of one page. Bounds are cut to the page.
    """
    cut = lambda v, most: F.greatest(F.lit(0), F.least(v, most))
    xs = F.array_sort(F.array_distinct(F.flatten(F.transform(boxes, lambda b: F.array(cut(b["x1"], width), cut(b["x2"], width))))))
    spans = F.zip_with(F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def covered(span: Column) -> Column:
        over = F.filter(boxes, lambda b: (b["x1"] <= span["a"]) & (b["x2"] >= span["b"]))
        ys = F.array_sort(F.transform(over, lambda b: F.struct(cut(b["y1"], height).alias("y1"), cut(b["y2"], height).alias("y2"))))
        start = F.struct(F.lit(0).cast("double").alias("sum"), F.lit(0).cast("double").alias("to"))
        step = lambda acc, y: F.struct(
            (acc["sum"] + F.greatest(F.lit(0.0), y["y2"] - F.greatest(acc["to"], y["y1"].cast("double")))).alias("sum"), F.greatest(acc["to"], y["y2"].cast("double")).alias("to"),
        )
        return (span["b"] - span["a"]) * F.aggregate(ys, start, step)["sum"]

    return F.aggregate(F.transform(spans, covered), F.lit(0.0), lambda s, x: s + x) / (width * height)
