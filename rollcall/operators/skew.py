"""Joins on keys of which one may hold any part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is heavy; so there are fewer heavy keys than that.
HEAVY = 1000
#: Tasks over which the rows of a heavy key are spread.
WAYS = 64


def dealt(by: str, ways) -> Column:
    """Which of ``ways`` parts of its key a row belongs to, by a column."""
    return F.pmod(F.xxhash64(by), F.lit(ways)).cast("int")


def copies(ways) -> Column:
    """One row for each of ``ways`` parts."""
    return F.explode(F.sequence(F.lit(0), F.lit(ways) - 1))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: str, rows: str, total: int, how: str = "inner", heavy: int = HEAVY, ways: int = WAYS) -> DataFrame:
    """``left`` joined with ``right`` on ``on``, the rows of heavy keys spread over ``ways`` tasks.

    ``right`` tells in ``rows`` how many rows of ``left`` have its key, and
    ``total`` is the number of all rows of ``left``. Keys with more than one in
    ``heavy`` of them, of which there are fewer than ``heavy`` whatever the size,
    are broadcast; rows of ``left`` that have one are dealt by column ``by``
    and meet copies of the rows of ``right``. Returns the columns of both, less
    ``rows``.
    """
    much = F.col(rows) * heavy > total
    keys = F.broadcast(right.where(much).select(*on, F.lit(ways).alias("salts")).distinct())
    salted = left.join(keys, on, "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(dealt(by, ways)).cast("int")).drop("salts")
    right = right.withColumn("salt", copies(F.when(much, ways).otherwise(1))).drop(rows)
    return salted.join(right, [*on, "salt"], how).drop("salt")
