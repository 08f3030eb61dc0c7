"""Titled entries grouped by title, and told apart by who held it when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.operators.numbering import numbered


def holders_in_year(rows: DataFrame, holders: DataFrame) -> DataFrame:
    """``rows`` plus ``holder``, the only one whose term holds the row's year, else null.

    Bounds are inclusive and may be blank. Terms are joined by title, so a row
    meets the holders of its own title only.
    """
    low, high = (F.trim(c).try_cast("int") for c in ("start_year", "end_year"))
    terms = holders.select(F.col("title_key").alias("__t"), F.col("person_name").alias("__p"), F.coalesce(low, F.lit(-(1 << 31))).alias("__lo"), F.coalesce(high, F.lit((1 << 31) - 1)).alias("__hi"))
    year = F.trim(F.col("year").cast("string")).cast("int")
    met = rows.join(terms, (F.col("title_key") == F.col("__t")) & year.between(F.col("__lo"), F.col("__hi")))
    only = met.groupBy(F.col("row_ord").alias("__row")).agg(F.when(F.count(F.lit(1)) == 1, F.first("__p")).alias("holder"))
    return rows.join(only, rows.row_ord == only["__row"], "left").drop("__row")


def _collides(*group: str) -> Column:
    """Whether a group has two rows of one book and edition."""
    over = Window.partitionBy(*group)
    return F.count(F.lit(1)).over(over) != F.size(F.collect_set(F.struct("book", "edition")).over(over))


def match_titles(parsed: DataFrame, holders: DataFrame) -> DataFrame:
    """Groups of two or more titled entries of one title.

    Returns their rows plus ``group_id``, ``match``, ``title_holder`` and
    ``match_tier``. A group without two rows of one edition is accepted (y),
    else left for review. A title with several holders is split by holder where
    that tells rows apart. Numbers follow the titles' order; a title that is
    split uses one for itself.
    """
    titled = parsed.where((F.col("name_type") == "titled") & (F.col("title_key") != ""))
    per_title = Window.partitionBy("title_key")
    many = titled.withColumn("__n", F.count(F.lit(1)).over(per_title)).where("__n >= 2").drop("__n")
    known = holders.groupBy(F.col("title_key").alias("__t")).agg(F.count(F.lit(1)).alias("__terms"))
    at = holders_in_year(many, holders)
    at = at.join(known, at.title_key == known["__t"], "left").drop("__t")
    name = F.coalesce("holder", F.lit("_unresolved_"))
    at = at.withColumn("__part", F.when(F.col("__terms") > 1, name).otherwise(F.lit("")))
    split = (F.col("__terms") > 1) & (F.size(F.collect_set("__part").over(per_title)) > 1)
    at = at.withColumn("__split", F.coalesce(split, F.lit(False)))
    at = at.withColumn("__part", F.when(F.col("__split"), F.col("__part")).otherwise(F.lit("")))
    part = Window.partitionBy("title_key", "__part")
    at = at.withColumn("__size", F.count(F.lit(1)).over(part)).withColumn("__first", F.min("row_ord").over(part)).withColumn("__bad", _collides("title_key", "__part"))
    groups = at.select("title_key", "__split", "__part", "__first", "__size").distinct()
    parents = groups.select("title_key", F.lit(-1).cast("long").alias("__first"), F.lit("").alias("__part"), F.lit(True).alias("__parent")).distinct()
    children = groups.where("__split and __size >= 2").select("title_key", "__first", "__part", F.lit(False).alias("__parent"))
    numbers = numbered(parents.union(children), ["title_key", "__first"], "__number", "title-numbers")
    number = numbers.select(F.col("title_key").alias("__tk"), F.col("__part").alias("__pp"), F.col("__parent").alias("__up"), "__number")
    out = at.where("not __split or __size >= 2").join(number, (F.col("title_key") == F.col("__tk")) & (F.col("__part") == F.col("__pp")) & (F.col("__up") == ~F.col("__split")))
    return out.select(
        *parsed.columns,
        F.format_string("tt_%04d", "__number").alias("group_id"),
        F.when(F.col("__bad"), "").otherwise("y").alias("match"),
        F.coalesce("holder", F.lit("")).alias("title_holder"),
        F.when(F.col("__split"), "title_holder").otherwise("title_same").alias("match_tier"),
    )
