"""Labels, colours and the layout of the chord drawing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Colours for titles by hash, and for communities.
PALETTE = [
    "#1f77b4", "#aec7e8", "#ff7f0e", "#ffbb78", "#4C4A6C", "#98df8a", "#d62728", "#ff9896", "#9467bd", "#c5b0d5",
    "#8c564b", "#c49c94", "#e377c2", "#f7b6d2", "#7f7f7f", "#c7c7c7", "#bcbd22", "#dbdb8d", "#17becf", "#9edae5",
]
CLUSTER_COLORS = ["#4c4a6c", "#3f6f99", "#3f8a82", "#8a5a86", "#b0883e", "#6f5b9c", "#a85f74", "#5f8a5a", "#393751", "#7a8fb0"]
ISOLATE_COLOR = "#d3d3da"
#: Words that carry no meaning in a short title.
SKIP_WORDS = ["a", "an", "the", "of", "in", "on", "to", "for"]
#: Parameters of the layout.
WIDTH_MIN, WIDTH_MAX, WIDTH_FLAT = 0.5, 12.0, 3.0
AREA_MIN, AREA_MAX, NODE_GAP, COMMUNITY_GAP, BOW_BASE, BOW_FALLOFF = 200.0, 4000.0, 0.02, 0.06, 0.55, 0.45


def book_color(book: Column, known: dict[str, str] | None = None) -> Column:
    """A title's colour by its hash; 16 to any power leaves 16 modulo 20, so the digits' sum will do."""
    digits = F.transform(F.split(F.md5(book.cast("binary")), "(?!^)(?!$)"), lambda c: F.conv(c, 16, 10).cast("int"))
    head = F.aggregate(F.slice(digits, 1, 31), F.lit(0), lambda a, x: a + x)
    index = F.pmod(16 * head + F.element_at(digits, -1), F.lit(20))
    out = F.element_at(F.array(*map(F.lit, PALETTE)), index.cast("int") + 1)
    for title, color in (known or {}).items():
        out = F.when(book == title, color).otherwise(out)
    return out


def short_title(book: Column, override: Column | None = None, most: int = 24) -> Column:
    """The given short title, else the title without article, up to a comma, cut to whole words."""
    title = F.regexp_replace(F.trim(book), r"(?i)^(?:the|an|a)\s+", "")
    title = F.when(title.contains(","), F.trim(F.substring_index(title, ",", 1))).otherwise(title)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))

    def step(acc: Column, w: Column) -> Column:
        fits = acc["open"] & (F.length(F.array_join(acc["kept"], " ")) + F.length(w) + 1 <= most)
        return F.struct(F.when(fits, F.array_append(acc["kept"], w)).otherwise(acc["kept"]).alias("kept"), fits.alias("open"))

    kept = F.array_join(F.aggregate(F.split(title, r"\s+"), start, step)["kept"], " ")
    skip = "|".join(SKIP_WORDS)
    kept = F.regexp_replace(kept, rf"(?i)(?:(?:^|\s+)(?:{skip}))+$", "")
    cut = F.when(kept != "", kept).otherwise(F.rtrim(F.substring(title, 1, most)))
    out = F.when(F.length(title) <= most, title).otherwise(F.concat(F.regexp_replace(cut, "[,;:]+$", ""), F.lit("…")))
    return out if override is None else F.when(F.trim(F.coalesce(override, F.lit(""))) != "", F.trim(override)).otherwise(out)


def author_last(author: Column) -> Column:
    """T3."""
    name = F.trim(F.coalesce(author, F.lit("")))
    return F.when(name.contains(","), F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(F.split(name, r"\s+"), -1))


def book_abbr(book: Column, known: dict[str, str] | None = None) -> Column:
    """T4: the given abbreviation, else the initials of the words that carry meaning."""
    words = F.split(F.trim(book), r"\s+")
    telling = F.filter(words, lambda w: ~F.lower(w).isin(SKIP_WORDS))
    letters = F.transform(telling, lambda w: F.when(F.lower(w) == "and", "&").otherwise(F.upper(F.substring(w, 1, 1))))
    out = F.when(F.size(telling) <= 1, book).otherwise(F.array_join(letters, ""))
    for title, short in (known or {}).items():
        out = F.when(book == title, short).otherwise(out)
    return out


def value_range(pairs: DataFrame, measure: str) -> DataFrame:
    """T5: the least, middle and greatest value of a colour scale."""
    low, high = F.coalesce(F.min(measure), F.lit(0.0)), F.coalesce(F.max(measure), F.lit(1.0))
    if measure == "repr":
        return pairs.agg(F.least(low, F.lit(0.999)).alias("vmin"), F.lit(1.0).alias("vcenter"), F.greatest(high, F.lit(1.0001)).alias("vmax"))
    return pairs.agg(F.least(low, F.lit(0.0)).alias("vmin"), F.lit(None).cast("double").alias("vcenter"), F.greatest(high, F.lit(1e-9)).alias("vmax"))


def community_color(community: Column) -> Column:
    """T6."""
    return F.when(community < 0, ISOLATE_COLOR).otherwise(F.element_at(F.array(*map(F.lit, CLUSTER_COLORS)), (F.pmod(community, F.lit(len(CLUSTER_COLORS))) + 1).cast("int")))


def dark_fill(color: Column, most: float = 0.45) -> Column:
    """Struct of red, green and blue in 0 to 1, darkened to a luminance."""
    r, g, b = (F.conv(F.substring(color, k, 2), 16, 10).cast("double") / 255 for k in (2, 4, 6))
    light = 0.2126 * r + 0.7152 * g + 0.0722 * b
    scale = F.when(light > most, most / light).otherwise(1.0)
    return F.struct((r * scale).alias("r"), (g * scale).alias("g"), (b * scale).alias("b"))


def chord_widths(pairs: DataFrame) -> DataFrame:
    """A width for each pair that shares persons, even from the least to the greatest number."""
    some = pairs.where("shared > 0").select("work_a", "work_b", "shared")
    ends = some.agg(F.min("shared").alias("low"), F.max("shared").alias("high"))
    part = (F.col("shared") - F.col("low")) / (F.col("high") - F.col("low"))
    width = F.when(F.col("high") == F.col("low"), WIDTH_FLAT).otherwise(WIDTH_MIN + (WIDTH_MAX - WIDTH_MIN) * part)
    return some.join(F.broadcast(ends)).select("work_a", "work_b", "shared", width.alias("width"))


def node_areas(sizes: DataFrame, font: float = 12.0, glyph: float = 0.62, fill: float = 0.72) -> DataFrame:
    """An area for each work by its number of persons, but large enough for the number."""
    top = sizes.agg(F.max("persons").alias("top"))
    fit = F.pow(font * glyph * F.length(F.format_number("persons", 0)) / F.lit(fill), F.lit(2.0))
    area = F.greatest(AREA_MIN + (AREA_MAX - AREA_MIN) * F.col("persons") / F.col("top"), fit)
    return sizes.join(F.broadcast(top)).select("book", "persons", area.alias("area"))


def ring_layout(ordered: DataFrame) -> DataFrame:
    """Angle and position of each work on a ring; ``ordered`` has book, community, place and area.

    Each work takes a slice by its radius, with gaps between works and wider
    ones between communities; clockwise from the top.
    """
    along = Window.orderBy("place")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = ordered.withColumn("radius", F.sqrt("area"))
    at = at.withColumn("sum", F.sum("radius").over(every)).withColumn("before", F.lag("community").over(along))
    ends = F.first("community").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) != F.last("community").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = F.when(F.col("before").isNull(), 0.0).when(F.col("before") == F.col("community"), NODE_GAP * F.col("sum")).otherwise(COMMUNITY_GAP * F.col("sum"))
    at = at.withColumn("gap", gap).withColumn("wrap", F.when(ends, COMMUNITY_GAP * F.col("sum")).otherwise(0.0))
    at = at.withColumn("end", F.sum(F.col("gap") + F.col("radius")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = F.sum(F.col("gap") + F.col("radius")).over(every) + F.col("wrap")
    angle = math.pi / 2 - 2 * math.pi * (F.col("end") - F.col("radius") / 2) / total
    at = at.withColumn("angle", angle)
    return at.select("book", "community", "place", "radius", "angle", F.cos("angle").alias("x"), F.sin("angle").alias("y"), community_color(F.col("community")).alias("color"))


def shrink_factor(ring: DataFrame, points: float, margin: float = 0.95) -> DataFrame:
    """The factor, 1 at most, by which all works must shrink so that neighbours on the ring do not touch."""
    along = Window.orderBy("place")
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {c: F.coalesce(F.lead(c).over(along), F.first(c).over(every)) for c in ("x", "y", "radius")}
    at = ring.select("x", "y", "radius", *[c.alias(f"n{k}") for k, c in nxt.items()])
    gap = F.sqrt(F.pow(F.col("x") - F.col("nx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("ny"), F.lit(2.0)))
    both = (F.col("radius") + F.col("nradius")) * points / 2
    return at.agg(F.least(F.lit(1.0), F.least(F.lit(1.0), F.min(F.when(both > 0, gap / both))) * margin).alias("factor"))


def chord_curve(ax: Column, ay: Column, bx: Column, by: Column, samples: int = 48) -> Column:
    """Points of a curve between two places on the ring that bows to its middle."""
    apart = F.sqrt(F.pow(ax - bx, F.lit(2.0)) + F.pow(ay - by, F.lit(2.0))) / 2
    bow = (BOW_BASE - BOW_FALLOFF * apart) / 1.5

    def point(k: Column) -> Column:
        t = k / F.lit(float(samples - 1))
        return F.struct(*[((1 - t) * (1 - t) * a + 2 * (1 - t) * t * (a + b) * bow + t * t * b).alias(n) for a, b, n in ((ax, bx, "x"), (ay, by, "y"))])

    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), point)


def is_highlighted(term: str, author: Column, book: Column) -> Column:
    """T12."""
    low = term.strip().lower()
    return F.lit(bool(low)) & (F.lower(author).contains(low) | F.lower(book).contains(low))
