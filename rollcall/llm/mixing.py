"""Mix sources to target weights by repeating and thinning documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import PLAIN_WORD, others, quoted, saved

WEIGHTS = (3, 1, 2)
#: Sources, the largest ones, whose targets are broadcast; documents of all others meet theirs by a shuffle.
BROADCAST_SOURCES = 50_000
FRESH = ("size", "source_size", "target", "copies")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights=WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """Rows (source, source_size, target): the words each source should give.

    Sources by code point, null last, have ``weights`` in turn and share
    ``percent`` of all words; a target stops at ``most`` times its source's
    size, and what is over goes to the others by weight until none is above.
    The water level is found exactly, in whole numbers.
    """
    sizes = docs.groupBy("source").agg(F.sum(n_tokens(F.col("text"))).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long").alias("weight"))
    cap = most * F.col("source_size")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    on = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = weighed.select(
        "source", "source_size", "weight", cap.alias("cap"),
        (percent * F.sum("source_size").over(every) - 100 * F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(on).alias("heavy"),
        F.row_number().over(by_ratio).alias("place"),
    )
    fits = F.col("left") * F.col("weight") <= 100 * F.col("cap") * F.col("heavy")
    level = F.min(F.when(fits, F.struct("place", "left", "heavy"))).over(every)
    filled = filled.withColumn("level", level)
    share = (F.col("level.left") * F.col("weight")).cast("double") / (100 * F.col("level.heavy")).cast("double")
    capped = F.col("level").isNull() | (F.col("place") < F.col("level.place"))
    return filled.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the document only."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mixing_plan(docs: DataFrame, weights=WEIGHTS, percent: int = 150, most: int = 2, seed: str = "mix-1:") -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target`` and ``copies``, one row per row.

    Each document is to be given floor(rate) times, rate being its source's
    target over its source's size, and once more if its draw is below the
    fraction. ``docs`` has ``doc_id``, ``text`` and ``source``; of other columns
    those named like the new ones, in whatever case, are replaced.

    A null or empty text has size 0; a source of such texts only has target 0
    and gives no copies. Null is a source of its own. Repeated rows are drawn
    alike; rows without doc_id are drawn by their text. An empty table gives an
    empty result.
    """
    kept = others(docs.columns, FRESH)
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in kept]).alias("doc"), "doc_id", "text", F.col("source").alias("of"))
    return _planned(rows, docs, weights, percent, most, seed).select("doc.*", *FRESH)


def _planned(rows: DataFrame, docs: DataFrame, weights, percent: int, most: int, seed: str) -> DataFrame:
    """``rows`` (doc, doc_id, text, of) of ``docs`` with the plan's columns, those of sources beyond the largest ones by a shuffle."""
    targets = saved(source_targets(docs, weights, percent, most), "mixing-targets").withColumnRenamed("source", "its")
    same = F.col("of").eqNullSafe(F.col("its"))
    largest = targets.orderBy(F.desc("source_size"), "its").limit(BROADCAST_SOURCES)
    rest = targets.join(largest.select(F.col("its").alias("of")), same, "left_anti")
    near = rows.join(F.broadcast(largest), same)
    far = rows.join(F.broadcast(largest.select("its")), same, "left_anti").join(rest, same)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    again = (draw(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate)).cast("long")
    copies = (F.floor(rate) + again).alias("copies")
    return near.unionByName(far).select("doc", n_tokens(F.col("text")).alias("size"), "source_size", "target", copies)


def mix(docs: DataFrame, weights=WEIGHTS, percent: int = 150, most: int = 2, seed: str = "mix-1:") -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as ``mixing_plan`` says, with the columns of ``docs``.

    Rows of size 0 have no part in any target but are drawn like others of
    their source. An empty table gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "text", F.col("source").alias("of"))
    plan = _planned(rows, docs, weights, percent, most, seed).where("copies > 0")
    return plan.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")
