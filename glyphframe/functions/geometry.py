"""Boxes as columns (P13-P14, P25-P29). Ends are exclusive, so touching boxes do not overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the recognizer's input.
INPUT_HEIGHT, LEAST_WIDTH, MOST_WIDTH = 48, 16, 1024
SIDES = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{s}") for s in SIDES)  # type: ignore[return-value]


def box_area(a: tuple) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def intersection(a: tuple, b: tuple) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: tuple, b: tuple) -> Column:
    both = intersection(a, b)
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def cover(a: tuple, b: tuple) -> Column:
    """The share of a that lies inside b."""
    return F.when(box_area(a) > 0, intersection(a, b) / box_area(a)).otherwise(0.0)


def meets(a: tuple, b: tuple) -> Column:
    """Positive intersection, as a range predicate."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def natural_width(h: Column, w: Column) -> Column:
    """Width at the recognizer's height, halves to even, at least 1."""
    return F.greatest(F.rint(w * INPUT_HEIGHT / h), F.lit(1.0)).cast("long")


def input_width(h: Column, w: Column) -> Column:
    return F.least(F.greatest(natural_width(h, w), F.lit(LEAST_WIDTH)), F.lit(MOST_WIDTH))


def est_width(aspect: Column) -> Column:
    return F.least(F.greatest(F.rint(aspect * INPUT_HEIGHT), F.lit(float(LEAST_WIDTH))), F.lit(float(MOST_WIDTH))).cast("int")


def clipped(h: Column, w: Column) -> Column:
    return natural_width(h, w) > MOST_WIDTH


def pad_px(height: Column, pixels: int | None = None, share: float | None = None) -> Column:
    """Padding of a crop: so many pixels, or a share of the box height, halves to even."""
    return F.lit(pixels) if pixels is not None else F.rint(height * share).cast("int")


def auto_margin(height: Column) -> Column:
    """A quarter of the print height, 2 to 16 pixels."""
    return F.least(F.greatest(F.rint(height * 0.25), F.lit(2.0)), F.lit(16.0)).cast("int")


def clip_box(a: tuple, width: Column, height: Column) -> dict[str, Column]:
    """The box within its page, the names of clipped edges, and whether 2 pixels are left both ways."""
    x1, y1 = F.greatest(a[0], F.lit(0)), F.greatest(a[1], F.lit(0))
    x2, y2 = F.least(a[2], width), F.least(a[3], height)
    edges = F.array_compact(
        F.array(F.when(a[0] < 0, "left"), F.when(a[1] < 0, "top"), F.when(a[2] > width, "right"), F.when(a[3] > height, "bottom"))
    )
    return {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "clipped_edges": edges, "valid": (x2 - x1 >= 2) & (y2 - y1 >= 2)}


def expand_box(df: DataFrame, k: int, width: str = "width", height: str = "height") -> DataFrame:
    """``df`` with the box grown by ``k`` pixels on all sides and clipped; the requested box is kept."""
    x1, y1, x2, y2 = box()
    asked = {"requested_x1": x1 - k, "requested_y1": y1 - k, "requested_x2": x2 + k, "requested_y2": y2 + k}
    grown = df.withColumns(asked)
    return grown.withColumns(clip_box(box("requested_"), F.col(width), F.col(height)))


def validate_boxes(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, id, violation): one row for each broken rule of boxes (page_id, id, x, y, w, h, line_index,
    column_index), with pages (page_id, width, height) (P27). A page without dimensions breaks "page unknown"."""
    met = boxes.join(pages.select("page_id", F.col("width").alias("_pw"), F.col("height").alias("_ph")), "page_id", "left")
    met = met.withColumn("_n", F.count("*").over(Window.partitionBy("page_id", "id")))
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    rules = {
        "id empty or not stripped": bad((F.col("id") != "") & (F.trim("id") == F.col("id"))),
        "negative corner": bad((F.col("x") >= 0) & (F.col("y") >= 0)),
        "no size": bad((F.col("w") > 0) & (F.col("h") > 0)),
        "negative index": (F.col("line_index") < 0) | (F.col("column_index") < 0),
        "id not unique": F.col("_n") > 1,
        "page unknown": F.col("_pw").isNull(),
        "outside the page": (F.col("x") + F.col("w") > F.col("_pw")) | (F.col("y") + F.col("h") > F.col("_ph")),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return met.select("page_id", "id", F.explode(found).alias("violation"))


def scale_box(a: tuple, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> dict[str, Column]:
    """A box moved from one image size to another: proportional, halves to even, clamped.

    An empty rectangle has null corners.
    """
    ok = (a[2] > a[0]) & (a[3] > a[1])
    at = lambda v, f, t: F.when(ok, F.least(F.greatest(F.rint(v * t / f), F.lit(0.0)), t.cast("double")).cast("long"))
    return {"x1": at(a[0], from_w, to_w), "y1": at(a[1], from_h, to_h), "x2": at(a[2], from_w, to_w), "y2": at(a[3], from_h, to_h)}


def map_affine(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes through their page's 2x3 matrix (m00 m01 m02 m10 m11 m12), at least one pixel, clamped to the page.

    ``pages``: page_id, the matrix, deskew_deg, width, height. Where deskew_deg is 0 the box stays as it is.
    """
    met = boxes.join(pages, "page_id")
    xs = [F.col(x) * F.col("m00") + F.col(y) * F.col("m01") + F.col("m02") for x in ("x1", "x2") for y in ("y1", "y2")]
    ys = [F.col(x) * F.col("m10") + F.col(y) * F.col("m11") + F.col("m12") for x in ("x1", "x2") for y in ("y1", "y2")]
    x1, y1 = F.greatest(F.floor(F.least(*xs)), F.lit(0)), F.greatest(F.floor(F.least(*ys)), F.lit(0))
    x2, y2 = F.least(F.ceil(F.greatest(*xs)), F.col("width")), F.least(F.ceil(F.greatest(*ys)), F.col("height"))
    new = {"x1": x1, "y1": y1, "x2": F.greatest(x1 + 1, x2), "y2": F.greatest(y1 + 1, y2)}
    still = F.col("deskew_deg") == 0
    return met.select(*(F.when(still, F.col(c)).otherwise(new[c]).cast("long").alias(c) if c in new else c for c in boxes.columns))
