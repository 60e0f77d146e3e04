"""Tables and images on pages: ruling lines, cells, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfin.operators.timeseries import folded


def merge_lines(lines: DataFrame, gap: float = 3.0) -> DataFrame:
    """Vertical lines (page, x, y0, y1) with those less than gap right of a kept line merged into it: its x stays, its extent grows. A page's lines are folded in order, as a kept x decides on the next."""

    def step(s: dict, row) -> tuple:
        if s["x"] is None or row.x - s["x"] >= gap:
            s["x"], s["n"] = row.x, s["n"] + 1
        return row.page, s["n"], s["x"], row.y0, row.y1

    rows = lines.select(F.col("page").cast("long").alias("page"), *[F.col(c).cast("double").alias(c) for c in ("x", "y0", "y1")])
    kept = folded(rows, ["page"], ["x", "y0", "y1"], lambda: {"x": None, "n": 0}, step, "page long, n long, x double, y0 double, y1 double")
    return kept.groupBy("page", "n").agg(F.min("x").alias("x"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).drop("n")


#: Side of the finest cells, in points, and the level beyond which a rectangle stands for its whole page.
CELL, MOST_LEVEL = 16.0, 40


def points_in_rects(points: DataFrame, rects: DataFrame) -> DataFrame:
    """Points (page, x, y, others) with each rectangle (page, rect_id, rx0, ry0, rx1, ry1) that they lie in, edges included.

    A grid of cells whose sides double from level to level is the join key: a rectangle takes the level whose cells are as long as its longer side, so it
    meets four of them at most; a point lies in one cell of each level in use. The bounds are then checked. Rectangles and points without a page or a bound meet nothing.
    """
    side = F.greatest(F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(CELL)) / CELL)).cast("int"))
    # Nothing is measured against a cell of the whole page.
    level = F.when(side < CELL * 2.0**MOST_LEVEL, F.least(level, F.lit(MOST_LEVEL))).otherwise(-1)
    kept = rects.filter("rx0 <= rx1 and ry0 <= ry1").withColumn("_level", level)
    # At most MOST_LEVEL + 2 numbers.
    levels = sorted(r["_level"] for r in kept.select("_level").distinct().collect())
    cell = lambda v, at: F.when(at < 0, F.lit(0).cast("long")).otherwise(F.floor(v.cast("double") / (CELL * F.pow(F.lit(2.0), at))).cast("long"))
    at = F.col("_level")
    spread = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo), at), cell(F.col(hi), at)))
    r = kept.withColumn("_ix", spread("rx0", "rx1")).withColumn("_iy", spread("ry0", "ry1"))
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_ix", cell(F.col("x"), at)).withColumn("_iy", cell(F.col("y"), at))
    hits = p.join(r, ["page", "_level", "_ix", "_iy"]).filter(F.col("x").between(F.col("rx0"), F.col("rx1")) & F.col("y").between(F.col("ry0"), F.col("ry1")))
    return hits.drop("_level", "_ix", "_iy")


def text_in_rects(lines: DataFrame, rects: DataFrame) -> DataFrame:
    """Text (page, x, y0, y1, n, text) whose start and centre line lie in each rectangle (page, rect_id, rx0, ry0, rx1, ry1), joined in reading order; rectangles without text give ''."""
    points = lines.filter(F.trim("text") != "").select("page", "x", ((F.col("y0") + F.col("y1")) / 2).alias("y"), "n", F.trim("text").alias("t"))
    g = points_in_rects(points, rects).groupBy("page", "rect_id").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("t"))
    every = rects.select("page", "rect_id").distinct().join(g, ["page", "rect_id"], "left")
    return every.select("page", "rect_id", F.coalesce(F.array_join(F.transform("t", lambda x: x["t"]), "\n"), F.lit("")).alias("text"))


def table_grid(columns: DataFrame, rows: DataFrame, lines: DataFrame) -> DataFrame:
    """page, row, cells of the table that column lines (page, x) and row bounds (page, y) cut out, rows without text left out; the first one is the header."""
    bounds = lambda df, c, a, b, n: df.select("page", F.round(c, 1).alias(a)).distinct().withColumn(b, F.lead(a).over(Window.partitionBy("page").orderBy(a))).withColumn(n, F.row_number().over(Window.partitionBy("page").orderBy(a))).filter(F.col(b).isNotNull())
    cells = bounds(columns, "x", "cx0", "cx1", "col").join(bounds(rows, "y", "cy0", "cy1", "row"), "page")
    rect = cells.select("page", F.struct("row", "col").alias("rect_id"), (F.col("cx0") - 1).alias("rx0"), (F.col("cy0") - 1).alias("ry0"), (F.col("cx1") + 1).alias("rx1"), (F.col("cy1") + 1).alias("ry1"))
    t = text_in_rects(lines, rect).select("page", "rect_id.row", "rect_id.col", "text")
    g = t.groupBy("page", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("cells"))
    return g.filter(F.exists("cells", lambda c: c != ""))


def image_context(images: DataFrame, blocks: DataFrame, headers: int = 2, nearby: int = 6) -> DataFrame:
    """page, image_id, context: up to two header-like blocks within 150 points above, then six blocks within 400, else three of the page's first ten; over 1,000 characters the first 150 words.

    images: page, image_id, y0, y1; blocks: page, n, y0, y1, text.
    """
    b = blocks.select("page", "n", ((F.col("y0") + F.col("y1")) / 2).alias("c"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t")).filter(F.length("t") >= 3)
    j = images.select("page", "image_id", "y0", ((F.col("y0") + F.col("y1")) / 2).alias("ic")).join(b, "page").withColumn("d", F.abs(F.col("ic") - F.col("c")))
    above = F.col("c") < F.col("y0")
    first = F.substring("t", 1, 1)
    head = above & (F.col("d") < 150) & (F.length("t") < 200) & ~((first == F.lower(first)) & (first != F.upper(first)))
    # A block counts as up to three kinds. Of each kind an image keeps its first ones, which tasks pick before anything is shuffled; no list of a page's blocks is made.
    most = {"h": headers, "m": nearby, "all": 10}
    kinds = F.array_compact(F.array(F.when(head, F.lit("h")), F.when(F.col("d") <= 400, F.lit("m")), F.lit("all")))
    each = j.select("page", "image_id", "d", "n", "t", F.explode(kinds).alias("kind")).withColumn("d", F.when(F.col("kind") != "all", F.col("d")))
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("page", "image_id", "kind").orderBy("d", "n", "t"))).filter(F.col("place") <= max(most.values()))
    pick = lambda kind: F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("place") <= most[kind]), F.struct("place", "t"))))
    found = each.groupBy("page", "image_id").agg(*[pick(kind).alias(kind) for kind in most])
    none = F.array().cast("array<struct<place:int,t:string>>")
    g = images.select("page", "image_id").distinct().join(found, ["page", "image_id"], "left").select("page", "image_id", *[F.coalesce(kind, none).alias(kind) for kind in most])
    take = lambda c, k: F.transform(F.slice(c, 1, k), lambda x: x["t"])
    near = F.filter(take("m", nearby), lambda t: F.length(t) > 10)
    parts = F.array_distinct(F.concat(take("h", headers), near))
    rest = F.slice(F.filter(take("all", 10), lambda t: F.length(t) > 20), 1, 3)
    text = F.array_join(F.when(F.size(parts) > 0, parts).otherwise(rest), " ")
    return g.select("page", "image_id", F.when(F.length(text) > 1000, F.array_join(F.slice(F.split(text, " "), 1, 150), " ")).otherwise(text).alias("context"))


def image_size(width: Column, height: Column) -> Column:
    """struct(width, height) to scale an image to, null for those too small to keep: the short side up to 512, else the long side down to 2048."""
    lo, hi = F.least(width, height), F.greatest(width, height)
    k = F.when(lo < 512, 512 / lo).when(hi > 2048, 2048 / hi).otherwise(1.0)
    return F.when(lo >= 50, F.struct(F.floor(width * k).cast("int").alias("width"), F.floor(height * k).cast("int").alias("height")))
