"""Positioned elements of pages: reading order, bands, extents, classification and indentation.

A page's lines lie in the page's own row, so order, extents, footnote start, page number and indent clusters are computed
there, in array expressions; the one shuffle drops pages that were delivered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import nested

PAGE = ["env_id", "file_idx", "page_idx"]
#: Widest distance of a position to its indent cluster's mean (exclusive).
INDENT_GAP = 50
WIDE = "０１２３４５６７８９"


def page_lines(envelopes: DataFrame) -> DataFrame:
    """(page keys, has_dim, width, height, lines): each page once, with its lines that have text and a polygon in reading order.

    `page` holds what follows from all lines of the page: its lowest vertex, the last vertex's extents, the rank of the
    first footnote, the number read from it, and the indent clusters.
    """
    p = nested.with_files(envelopes).select("env_id", "file_idx", F.posexplode("pages").alias("page_idx", "p")).where("p is not null")
    raw = F.transform("p.lines", lambda e, i: F.struct(i.cast("int").alias("elem_idx"), e["text"].alias("text"), F.coalesce(e["layout"]["confidence"], F.lit(0.0)).alias("confidence"), e["layout"]["bounding_poly"]["vertices"].alias("vertices")))
    kept = F.coalesce(F.filter(raw, lambda r: (F.size(r["vertices"]) > 0) & (T.strip(r["text"]) != "")), F.array())
    once = p.select(*PAGE, F.col("p.dimension").isNotNull().alias("has_dim"), F.col("p.dimension.width").alias("dim_width"), F.col("p.dimension.height").alias("dim_height"), kept.alias("raw")).distinct()
    v = lambda r, i, k: F.try_element_at(r["vertices"], F.lit(i))[k]

    def line(r: Column, t: Column) -> Column:
        x, y = F.coalesce(v(r, 1, "x"), F.lit(0.0)), F.coalesce(v(r, 1, "y"), F.lit(0.0))
        wide = F.when(F.size(r["vertices"]) > 1, F.coalesce(v(r, 2, "x"), x) - x).otherwise(0.0)
        high = F.when(F.size(r["vertices"]) > 2, F.coalesce(v(r, 3, "y"), y) - y).otherwise(0.0)
        return F.struct(y.alias("y"), x.alias("x"), r["elem_idx"].alias("elem_idx"), t.alias("text"), r["confidence"].alias("confidence"), r["vertices"].alias("vertices"), wide.alias("width"), high.alias("height"))

    texts = T.nfc_each(F.transform("raw", lambda r: r["text"]))
    rows = once.withColumn("texts", texts).select(*PAGE, "has_dim", "dim_width", "dim_height", F.array_sort(F.zip_with("raw", "texts", line)).alias("lines"))
    last = lambda r, k: F.coalesce(F.element_at(r["vertices"], -1)[k], F.lit(0.0))
    lowest = F.greatest(F.lit(0.0), F.array_max(F.flatten(F.transform("lines", lambda r: F.transform(r["vertices"], lambda q: F.coalesce(q["y"], F.lit(0.0)))))))
    rows = rows.withColumn("lowest", lowest)

    def note(r: Column, i: Column) -> Column:
        gap = F.coalesce(F.element_at(r["vertices"], 1)["y"], F.lit(0.0)) - last(F.get("lines", i - 1), "y")
        return F.when((i > 0) & (r["y"] > F.col("lowest") * 0.75) & (gap > 20) & T.is_footnote_marker(r["text"]), i)

    numbers = F.filter(F.transform(F.slice("lines", 1, 10), lambda r: _number(r["text"])), lambda n: n.isNotNull())
    facts = F.struct(
        "lowest", F.array_max(F.transform("lines", lambda r: last(r, "x"))).alias("far_x"), F.array_max(F.transform("lines", lambda r: last(r, "y"))).alias("far_y"),
        F.array_min(F.transform("lines", note)).cast("int").alias("footnote_start"), F.get(numbers, F.lit(0)).alias("page_number"), clusters(F.transform("lines", lambda r: r["x"])).alias("centres"),
    )
    return rows.select(*PAGE, "has_dim", "dim_width", "dim_height", "lines", facts.alias("page"))


def positioned(envelopes: DataFrame) -> DataFrame:
    """Lines with text and a polygon, with position, size, reading rank (by y, x, place in the page) and their page's facts."""
    rows = page_lines(envelopes).select(*PAGE, "page", F.posexplode("lines").alias("reading_rank", "r"))
    return rows.select(*PAGE, *(f"r.{c}" for c in ("elem_idx", "text", "confidence", "vertices", "x", "y", "width", "height")), "reading_rank", "page")


def page_extents(envelopes: DataFrame, default_cm: tuple[float, float] | None = None) -> DataFrame:
    """Pixel and centimetre sizes: the declared dimension, else the largest last vertex, else 1000 × 1400 (or `default_cm`)."""
    return page_lines(envelopes).select(*PAGE, *extents(default_cm))


def extents(default_cm: tuple[float, float] | None = None) -> list[Column]:
    """The sizes of a row of `page_lines`."""
    known = F.col("has_dim") | F.col("page.far_x").isNotNull()

    def px(declared: str, far: str, least: float) -> Column:
        return F.when(F.col("has_dim"), F.coalesce(declared, F.lit(least)).cast("int").cast("double")).otherwise(F.coalesce(far, F.lit(least)))

    w, h = px("dim_width", "page.far_x", 1000.0), px("dim_height", "page.far_y", 1400.0)
    cm = lambda c, i: T.pixels_to_cm(c) if default_cm is None else F.when(known, T.pixels_to_cm(c)).otherwise(F.lit(default_cm[i]))
    return [w.alias("width_px"), h.alias("height_px"), cm(w, 0).alias("width_cm"), cm(h, 1).alias("height_cm")]


def bands(lines: DataFrame) -> DataFrame:
    """Lines in bands of five pixels, in order of band, x and reading rank."""
    b = lines.withColumn("band", T.band(F.col("y")))
    return b.withColumn("band_rank", (F.row_number().over(Window.partitionBy(*PAGE).orderBy("band", "x", "reading_rank")) - 1).cast("int"))


def footnote_starts(lines: DataFrame) -> DataFrame:
    """Per page with footnotes: rank of the first line in the lowest quarter, below a gap of over 20, with a footnote marker."""
    return lines.where("reading_rank = page.footnote_start").select(*PAGE, F.col("page.footnote_start").alias("footnote_start"))


def line_type(text: Column, rank: Column, footnote_start: Column) -> Column:
    """A line's type: page_number, header, reference, footnote or line, the first that holds."""
    t = T.strip(text)
    return (
        F.when((rank == 0) & T.is_digits(t), "page_number")
        .when(T.is_upper(t) & (F.length(t) > 3), "header")
        .when(T.is_reference(t), "reference")
        .when(rank >= footnote_start, "footnote")
        .otherwise("line")
    )


def classified(lines: DataFrame) -> DataFrame:
    """Each line's type."""
    return lines.withColumn("elem_type", line_type(F.col("text"), F.col("reading_rank"), F.col("page.footnote_start")))


def plain_type(line: Column) -> Column:
    """The type of an unpositioned line: header, page_number or line."""
    t = T.strip(line)
    return F.when(T.is_upper(t) & (F.length(line) > 3), "header").when(T.is_digits(t) & (F.length(line) <= 2), "page_number").otherwise("line")


def _number(text: Column) -> Column:
    """The first number of one or two digits in a line, null without one."""
    nums = F.filter(F.regexp_extract_all(T.strip(text), F.lit(r"(?U)\b\d+\b"), F.lit(0)), lambda n: (F.length(n) <= 2) & (F.translate(n, WIDE, "0123456789").try_cast("int") > 0))
    return F.translate(F.get(nums, F.lit(0)), WIDE, "0123456789").try_cast("int")


def detected_page_numbers(lines: DataFrame) -> DataFrame:
    """The page number read from a page: the first number of one or two digits in its first ten lines, else none."""
    return lines.where("reading_rank = 0").select(*PAGE, "page.page_number")


def clusters(values: Column, gap: float = INDENT_GAP) -> Column:
    """Clusters of positions: distinct ones in order join a cluster while nearer than `gap` to its running mean."""
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        joins = (a["n"] > 0) & (F.abs(x - a["s"] / a["n"]) < gap)
        grown = F.struct(a["done"].alias("done"), (a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))
        closed = F.struct(F.when(a["n"] > 0, F.array_append(a["done"], a["s"] / a["n"])).otherwise(a["done"]).alias("done"), x.alias("s"), F.lit(1).alias("n"))
        return F.when(joins, grown).otherwise(closed)

    return F.aggregate(F.array_sort(F.array_distinct(values)), start, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], a["s"] / a["n"])).otherwise(a["done"]))


def indent_centres(lines: DataFrame) -> DataFrame:
    """The indent clusters of each page."""
    return lines.where("reading_rank = 0").select(*PAGE, "page.centres")


def nearest(x: Column, centres: Column) -> Column:
    """The place of the nearest centre, the first on a tie."""
    away = F.transform(centres, lambda c: F.abs(x - c))
    return (F.array_position(away, F.array_min(away)) - 1).cast("int")


def indented(lines: DataFrame) -> DataFrame:
    """Lines with the level of the nearest indent cluster, the first on a tie."""
    return lines.withColumn("indent_level", nearest(F.col("x"), F.col("page.centres")))


def bounding_box(vertices: Column) -> Column:
    """Smallest upright box around the known coordinates as whole pixels; zeros without any."""
    side = lambda f, k: F.coalesce(f(F.filter(F.transform(vertices, lambda v: v[k]), lambda c: c.isNotNull())), F.lit(0.0)).cast("int")
    return F.struct(side(F.array_min, "x").alias("left"), side(F.array_min, "y").alias("top"), side(F.array_max, "x").alias("right"), side(F.array_max, "y").alias("bottom"))


def cropped(lines: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Lines that lie in a page's body region, in the region's coordinates."""
    inside = F.col("x").between(left, right) & F.col("y").between(top, bottom)
    return lines.where(inside).withColumn("x", F.col("x") - left).withColumn("y", F.col("y") - top)


def finest_level(elements: DataFrame) -> DataFrame:
    """Of each page only the elements of its finest level: tokens, else lines, else paragraphs, else blocks."""
    rank = F.expr("case elem_level when 'token' then 0 when 'line' then 1 when 'paragraph' then 2 else 3 end")
    return elements.withColumn("level_rank", rank).withColumn("finest", F.min("level_rank").over(Window.partitionBy(*PAGE))).where("level_rank = finest").drop("level_rank", "finest")


def beside(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """For each left line the nearest right line of the page within `tolerance` in y, the upper one on a tie.

    Both sides are cut into strips of the tolerance, so the join is an equi-join on page and strip.
    """
    strips = F.explode(F.array(*[F.floor(F.col("y") / tolerance) + d for d in (-1, 0, 1)])).alias("strip")
    a = left.select(*PAGE, F.col("elem_idx").alias("left_idx"), F.col("y").alias("left_y"), F.floor(F.col("y") / tolerance).alias("strip"))
    b = right.select(*PAGE, F.col("elem_idx").alias("right_idx"), "y", strips)
    pairs = a.join(b, [*PAGE, "strip"]).withColumn("distance", F.abs(F.col("left_y") - F.col("y"))).where(F.col("distance") <= tolerance)
    return pairs.groupBy(*PAGE, "left_idx").agg(F.min_by("right_idx", F.struct("distance", "y", "right_idx")).alias("right_idx"), F.min("distance").alias("distance"))
