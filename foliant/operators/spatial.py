"""Positioned tokens, regions and cells: filters, reading order, lines, columns, joins, suppression.

Everything is keyed by page (one or more columns), so work is spread by page; what is collected is what one page holds.
Orders are total (ties go to the token's id), since rows have none of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.text import strip


def keep_tokens(tokens: DataFrame, least: float = 0.30) -> DataFrame:
    """Tokens that are sure enough and whose text is not empty once it is normalized.

    Normalizing replaces what it finds by something visible and else only takes off white space, so asking for that is enough.
    """
    return tokens.where((F.col("confidence") >= least) & (strip(F.col("text")) != ""))


def keep_regions(regions: DataFrame, kinds: tuple[str, ...] = ("title", "plain text", "table", "figure"), score: float = 0.35, side: int = 20, most: float = 0.95) -> DataFrame:
    """Detections of wanted kinds that are sure, large enough, and not the whole page. Needs page_width, page_height."""
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    covered = wide * high / (F.col("page_width") * F.col("page_height"))
    return regions.where(F.lower("type").isin(*kinds) & (F.col("score") >= score) & (wide >= side) & (high >= side) & (covered <= most))


def in_reading_order(regions: DataFrame, page: list[str], pad: int = 15, least: int = 25) -> DataFrame:
    """Adds region_id by (row of 50, x), then pads boxes, and drops those too small; ids keep their gaps."""
    order = Window.partitionBy(*page).orderBy(F.bround(F.col("y1") / 50), "x1", "y1", "x2", "y2")
    box = F.struct("x1", "y1", "x2", "y2")
    numbered = regions.withColumn("region_id", F.row_number().over(order)).withColumn("crop", geometry.padded(box, pad, F.col("page_width"), F.col("page_height")))
    return numbered.where((F.col("crop.x2") - F.col("crop.x1") >= least) & (F.col("crop.y2") - F.col("crop.y1") >= least))


def keep_cells(cells: DataFrame) -> DataFrame:
    """Cell boxes (x, y, w, h) of plausible size and shape. Needs page_area."""
    w, h = F.col("w"), F.col("h")
    thin = (w / h > 30) | (h / w > 30)
    return cells.where((w >= 35) & (h >= 18) & (w * h >= 400) & (w * h <= 0.9 * F.col("page_area")) & ~thin)


def first_tokens(tokens: DataFrame, page: list[str], grid: int = 5) -> DataFrame:
    """One token of those with the same lower-cased text on the same grid square: the first in order of token_id."""
    key = [F.lower(strip(F.col("text"))).alias("_text"), F.bround(F.col("x") / grid).alias("_x"), F.bround(F.col("y") / grid).alias("_y")]
    return tokens.groupBy(*page, *key).agg(F.min_by(F.struct(*tokens.columns), "token_id").alias("_first")).select("_first.*")


def union_tokens(of_regions: DataFrame, of_page: DataFrame, page: list[str]) -> DataFrame:
    """Tokens of regions other than figures, and of the whole page, each once."""
    return first_tokens(of_regions.where(F.coalesce(F.lower("region_type") != "figure", F.lit(True))).drop("region_type").unionByName(of_page), page)


def chained_groups(items: DataFrame, page: list[str], by: str = "y", gap: float = 25, out: str = "line", ties: tuple[str, ...] = ("x", "token_id")) -> DataFrame:
    """Adds out (from 1): a group ends where the gap to the item before exceeds `gap`."""
    order = Window.partitionBy(*page).orderBy(by, *ties)
    apart = F.col(by) - F.lag(by).over(order) > gap
    return items.withColumn(out, F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order) + 1)


def anchored_groups(items: DataFrame, page: list[str], by: str = "y", gap: float = 18, out: str = "line", ties: tuple[str, ...] = ("x", "token_id")) -> DataFrame:
    """Adds out (from 1): a group ends where the gap to the group's first item exceeds `gap`.

    The anchors are folded over the page's distinct values of `by`, in order, then joined back; a page's distinct
    positions are few, however many items lie on them.
    """
    values = items.groupBy(*page).agg(F.sort_array(F.collect_set(by)).alias("_values"))
    start = F.array().cast(f"array<{dict(items.dtypes)[by]}>")
    apart = lambda done, v: F.coalesce(v - F.try_element_at(done, F.lit(-1)) > gap, F.lit(True))
    fold = lambda done, v: F.when(apart(done, v), F.array_append(done, v)).otherwise(done)
    anchors = values.select(*page, F.aggregate("_values", start, fold).alias("_anchors"))
    joined = items.join(anchors, page)
    return joined.withColumn(out, F.size(F.filter("_anchors", lambda a: a <= F.col(by)))).drop("_anchors")


def line_texts(items: DataFrame, page: list[str], line: str = "line") -> DataFrame:
    """A row for each line: its text by x, and its token ids."""
    rows = F.sort_array(F.collect_list(F.struct("x", "token_id", "text")))
    lines = items.groupBy(*page, line).agg(rows.alias("_rows"))
    return lines.select(*page, line, F.array_join(F.transform("_rows", lambda r: r["text"]), " ").alias("text"), F.transform("_rows", lambda r: r["token_id"]).alias("token_ids"))


def page_texts(lines: DataFrame, page: list[str], line: str = "line") -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(line, "text")))
    return lines.groupBy(*page).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def columns_of(items: DataFrame, page: list[str], tolerance: int = 40, order: tuple[str, ...] = ("y", "x", "token_id")) -> DataFrame:
    """Adds column (from 1, left to right): each item joins the first column whose first x is within tolerance.

    An ordered fold over the page's items; what it carries is the columns' first x.
    """
    xs = F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda r: r["x"])
    kind = f"array<{dict(items.dtypes)['x']}>"
    near = lambda done, x: F.exists(done, lambda c: F.abs(c - x) < tolerance)
    fold = lambda done, x: F.when(near(done, x), done).otherwise(F.array_append(done, x))
    found = items.groupBy(*page).agg(F.aggregate(xs, F.array().cast(kind), fold).alias("_columns"))
    joined = items.join(found, page)
    own = F.get(F.filter("_columns", lambda c: F.abs(c - F.col("x")) < tolerance), F.lit(0))
    return joined.withColumn("column", F.array_position(F.array_sort("_columns"), own).cast("int")).drop("_columns")


def suppress(boxes: DataFrame, page: list[str], threshold: float, measure=geometry.iou, order: str = "box_id") -> DataFrame:
    """Boxes that exceed the threshold against none kept before, in order. An ordered fold over a page's boxes."""
    struct = F.struct(order, "x1", "y1", "x2", "y2")
    kind = "array<" + boxes.select(struct.alias("b")).schema["b"].dataType.simpleString() + ">"
    clash = lambda kept, b: F.exists(kept, lambda k: measure(k, b) > threshold)
    fold = lambda kept, b: F.when(clash(kept, b), kept).otherwise(F.array_append(kept, b))
    kept = boxes.groupBy(*page).agg(F.aggregate(F.sort_array(F.collect_list(struct)), F.array().cast(kind), fold).alias("_kept"))
    return kept.select(*page, F.explode("_kept").alias("_box")).select(*page, "_box.*")


def assign_to_cells(tokens: DataFrame, cells: DataFrame, page: list[str]) -> DataFrame:
    """Tokens with each cell that holds their centre, bounds included. The page is an equal key; the rest is its filter."""
    box = F.struct("x1", "y1", "x2", "y2")
    return tokens.join(cells, page).where(geometry.contains(box, F.col("center_x"), F.col("center_y")))


def cell_texts(tokens: DataFrame, cells: DataFrame, page: list[str], grid: int = 5) -> DataFrame:
    """Every cell with its text by (y, x), repeated tokens once, and whether it is empty."""
    key = page + ["cell_id"]
    inside = first_tokens(assign_to_cells(tokens, cells, page), key, grid)
    rows = F.sort_array(F.collect_list(F.struct("y", "x", "token_id", "text")))
    texts = inside.groupBy(*key).agg(F.array_join(F.transform(rows, lambda r: F.trim(r["text"])), " ").alias("text"))
    joined = cells.join(texts, key, "left")
    return joined.withColumns({"text": F.coalesce("text", F.lit("")), "is_empty": F.coalesce(F.col("text") == "", F.lit(True))})


def grid_positions(cells: DataFrame, page: list[str], gap: float = 25) -> DataFrame:
    """Adds row and column, from 0: rows are chained by y1, columns number a row's cells by x1."""
    rows = chained_groups(cells, page, "y1", gap, "row", ("x1", "cell_id"))
    order = Window.partitionBy(*page, "row").orderBy("x1", "cell_id")
    return rows.withColumns({"column": F.row_number().over(order) - 1, "row": F.col("row") - 1})


def mean_confidence(tokens: DataFrame, page: list[str]) -> DataFrame:
    return tokens.groupBy(*page).agg(F.bround(F.avg("confidence"), 3).alias("confidence"))
