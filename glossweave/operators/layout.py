"""Page geometry: boxes as rows, spatial joins by grid cells, clusters and page statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Margins and sizes that results depend on.
LEAST_SIZE = 32
HEADER, FOOTER = 0.05, 0.95
CELL = 128


def _span(lo: str, hi: str) -> Column:
    return F.sequence(F.floor(F.col(lo) / CELL), F.floor(F.col(hi) / CELL))


def in_cells(boxes: DataFrame) -> DataFrame:
    """Each box once for every grid cell it touches."""
    return boxes.withColumn("cx", F.explode(_span("x0", "x1"))).withColumn("cy", F.explode(_span("y0", "y1")))


def area(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    return (F.col(x1) - F.col(x0)) * (F.col(y1) - F.col(y0))


def overlaps(boxes: DataFrame, least: float) -> DataFrame:
    """page, a, b, ratio: ordered pairs of boxes of a page where b covers at least ``least`` of a.

    An equi-join on page and grid cell replaces the all-pairs join; a pair counts in the first cell it shares.
    """
    cells = in_cells(boxes)
    a = cells.select("page", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in ("box", "x0", "y0", "x1", "y1")])
    b = cells.select("page", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in ("box", "x0", "y0", "x1", "y1")])
    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    right, bottom = F.least("a_x1", "b_x1"), F.least("a_y1", "b_y1")
    pairs = a.join(b, ["page", "cx", "cy"]).where((F.col("a_box") != F.col("b_box")) & (left < right) & (top < bottom))
    pairs = pairs.where((F.col("cx") == F.floor(left / CELL)) & (F.col("cy") == F.floor(top / CELL)))
    ratio = (right - left) * (bottom - top) / area("a_x0", "a_y0", "a_x1", "a_y1")
    return pairs.where(ratio >= least).select("page", F.col("a_box").alias("a"), F.col("b_box").alias("b"), F.round(ratio, 6).alias("ratio"))


def region_at(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """page, point and the label of the box painted last over it; ``background`` where there is none."""
    cells = in_cells(boxes).withColumnRenamed("box", "paint")
    at = points.withColumn("cx", F.floor(F.col("x") / CELL)).withColumn("cy", F.floor(F.col("y") / CELL))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    hit = at.join(cells, ["page", "cx", "cy"]).where(inside).groupBy("page", "point").agg(F.max_by("label", "paint").alias("label"))
    return points.select("page", "point").join(hit, ["page", "point"], "left").na.fill("background", ["label"])


def clusters(values: DataFrame, group: str, value: str, gap: float) -> DataFrame:
    """Chains of values whose neighbours are at most ``gap`` apart: cluster, n, mean."""
    w = Window.partitionBy(group).orderBy(value)
    new = (F.col(value) - F.lag(value).over(w) > gap).cast("int")
    chained = values.select(group, value).distinct().withColumn("new", F.coalesce(new, F.lit(0)))
    chained = chained.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return chained.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))


def page_statistics(boxes: DataFrame, height: float, width: float) -> DataFrame:
    """Per page: margins (at least 10), header and footer boxes, noise, and the reading direction by count and by area."""
    y = (F.col("y0") + F.col("y1")) / 2
    tall = (F.col("y1") - F.col("y0")) > 2 * (F.col("x1") - F.col("x0"))
    noise = (F.col("x1") - F.col("x0") < LEAST_SIZE) | (F.col("y1") - F.col("y0") < LEAST_SIZE)
    n, vertical = F.count(F.lit(1)), F.count_if(tall)
    share = F.sum(F.when(tall, area()).otherwise(0)) / F.sum(area())
    return boxes.groupBy("page").agg(
        n.alias("n"),
        F.greatest(F.lit(10), F.min("x0")).cast("double").alias("left"),
        F.greatest(F.lit(10), F.lit(width) - F.max("x1")).cast("double").alias("right"),
        F.greatest(F.lit(10), F.min("y0")).cast("double").alias("top"),
        F.greatest(F.lit(10), F.lit(height) - F.max("y1")).cast("double").alias("bottom"),
        F.count_if(y < HEADER * height).alias("header"),
        F.count_if(y > FOOTER * height).alias("footer"),
        F.count_if(noise).alias("noise"),
        F.when((n >= 3) & (vertical >= 0.7 * n), "right2left").otherwise("top2bottom").alias("direction"),
        F.when(share >= 0.7, "right2left").otherwise("top2bottom").alias("direction_by_area"),
    )
