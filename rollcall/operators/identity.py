"""Accepted groups to stable person ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accepted_members(matches: DataFrame) -> DataFrame:
    """Members of groups whose first row is y, without those marked x; groups of two or more.

    ``matches`` has ``file`` (0 titles accepted, 1 titles for review, 2 components
    accepted, 3 components for review), group_id, row_ord, entry_id and match.
    Groups stand in the order of their first row within their file.
    """
    group = Window.partitionBy("file", "group_id")
    said = F.lower(F.trim("match"))
    at = matches.withColumn("lead", F.first(said).over(group.orderBy("row_ord"))).withColumn("group_ord", F.min("row_ord").over(group))
    kept = at.where((F.col("lead") == "y") & (said != "x"))
    kept = kept.withColumn("canonical", F.first("entry_id").over(group.orderBy("row_ord"))).withColumn("size", F.count(F.lit(1)).over(group))
    return kept.where("size >= 2").select("file", "group_id", "group_ord", "row_ord", "entry_id", "canonical")


def person_ids(matches: DataFrame) -> DataFrame:
    """R2: (entry_id, person_id, groups): the first member of the last group that has the entry, and how many have it."""
    order = F.struct("file", "group_ord", "row_ord")
    members = accepted_members(matches)
    return members.groupBy("entry_id").agg(F.max_by("canonical", order).alias("person_id"), F.count_distinct("file", "group_id").alias("groups"))


def collapse(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """``rows`` with the person ids of accepted groups."""
    ids = person_ids(matches).select("entry_id", F.col("person_id").alias("__person"))
    return rows.join(ids, "entry_id", "left").withColumn("person_id", F.coalesce("__person", "person_id")).select(*rows.columns)
