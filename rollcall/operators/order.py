"""Whether a list has first or last names first."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.text import let, tokens

FIRST_LAST, LAST_FIRST = "first-last", "last-first"
#: Tokens that are no part of a name.
TITLE_TOKENS = [
    "mr.", "mrs.", "ms.", "miss", "rev.", "dr.", "capt.", "col.", "lt.", "adm.", "sgt.", "prof.", "hon.", "sir",
    "dame", "mme.", "messrs.", "gen.", "alderman", "major", "maj.", "right", "the",
]
POST_TOKENS = [
    "esq.", "esq", "bart.", "bart", "bt.", "jun.", "jun", "sen.", "sen", "m.d.", "m.p.", "d.d.", "f.r.s.", "ll.d.",
    "w.s.", "d.f.",
]
#: Weights of votes and limits of the decision.
STRONG, WEAK, ENOUGH, MOST, LEAST, GAP, SORTED = 2, 1, 5, 0.6, 0.4, 0.15, 0.9


def core_tokens(name: Column) -> Column:
    """F1."""
    return F.filter(tokens(name), lambda t: ~F.lower(t).isin(TITLE_TOKENS + POST_TOKENS) & ~t.rlike("^[-–—]+$"))


def plain_token(t: Column) -> Column:
    """F2."""
    return F.btrim(F.lower(t), F.lit(".,;:"))


def vote(core: Column, given: Iterable[str]) -> Column:
    """weight of an entry's vote, above 0 for first-last and below for last-first."""
    names = F.array(*map(F.lit, sorted(set(given)) or [""]))

    def of(t: Column) -> Column:
        known = F.array_position(F.transform(t, lambda x: F.array_contains(names, plain_token(x))), True)
        ahead, behind = F.get(t, F.lit(0)).rlike(r"^[A-Z]\.?$"), F.element_at(t, -1).rlike(r"^[A-Z]\.?$")
        return (
            F.when(F.size(t) < 2, 0).when(known == 1, STRONG).when(known > 1, -STRONG)
            .when(ahead & ~behind, WEAK).when(behind & ~ahead, -WEAK).otherwise(0)
        )

    return let(core, of)


def list_key() -> Column:
    return F.concat_ws("|", "author", "book", "edition")


def entry_votes(rows: DataFrame, given: Iterable[str], name: str = "normalized_name") -> DataFrame:
    """Rows (list_key, row_ord, vote, lead, trail); lead and trail are null with fewer than two tokens."""
    at = rows.select(list_key().alias("list_key"), "row_ord", core_tokens(F.col(name)).alias("core"))
    two = F.size("core") >= 2
    return at.select("list_key", "row_ord", vote(F.col("core"), given).alias("vote"),
                     F.when(two, plain_token(F.get("core", F.lit(0)))).alias("lead"), F.when(two, plain_token(F.element_at("core", -1))).alias("trail"))


def sorted_fractions(votes: DataFrame) -> DataFrame:
    """for each list, the share of neighbouring tokens that do not descend, at either end of the names."""
    along = Window.partitionBy("list_key").orderBy("row_ord")
    told = votes.where(F.col("lead").isNotNull())
    for c in ("lead", "trail"):
        before = F.lag(c).over(along)
        told = told.withColumn(f"up_{c}", F.when((before != "") & (F.col(c) != ""), (before <= F.col(c)).cast("double")))
    return told.groupBy("list_key").agg(F.coalesce(F.avg("up_lead"), F.lit(0.0)).alias("alpha_lead"), F.coalesce(F.avg("up_trail"), F.lit(0.0)).alias("alpha_trail"))


def detect_orders(rows: DataFrame, given: Iterable[str], overrides: DataFrame | None = None, name: str = "normalized_name") -> DataFrame:
    """the order of each list, how sure it is, why, and the tallies."""
    votes = entry_votes(rows, given, name)
    tally = votes.groupBy("list_key").agg(F.sum(F.greatest("vote", F.lit(0))).alias("fl"), F.sum(F.greatest(-F.col("vote"), F.lit(0))).alias("lf"))
    at = tally.join(sorted_fractions(votes), "list_key", "left").na.fill(0.0, ["alpha_lead", "alpha_trail"]).withColumn("n_votes", F.col("fl") + F.col("lf"))
    lf, gap = F.col("lf") / F.greatest("n_votes", F.lit(1)), F.col("alpha_lead") - F.col("alpha_trail")

    def told(order: str, sure: str, why: str) -> Column:
        return F.struct(F.lit(order).alias("order"), F.lit(sure).alias("confidence"), F.lit(why).alias("source"))

    many = (
        F.when(lf >= MOST, told(LAST_FIRST, "high", "votes")).when(lf <= LEAST, told(FIRST_LAST, "high", "votes"))
        .when(gap >= GAP, told(LAST_FIRST, "low", "alphabetization")).when(-gap >= GAP, told(FIRST_LAST, "low", "alphabetization"))
    )
    few = F.when((F.col("alpha_lead") >= SORTED) & (gap >= GAP), told(LAST_FIRST, "low", "alphabetization")).when(
        (F.col("alpha_trail") >= SORTED) & (-gap >= GAP), told(FIRST_LAST, "low", "alphabetization")
    )
    found = F.coalesce(F.when(F.col("n_votes") >= ENOUGH, many).otherwise(few), told(FIRST_LAST, "low", "default"))
    at = at.withColumn("found", found)
    if overrides is not None:
        said = overrides.select(F.trim("list_key").alias("list_key"), F.lower(F.trim("order")).alias("said"))
        said = said.where(F.col("said").isin(FIRST_LAST, LAST_FIRST)).dropDuplicates(["list_key"])
        forced = F.struct(F.col("said").alias("order"), F.lit("high").alias("confidence"), F.lit("override").alias("source"))
        at = at.join(said, "list_key", "left").withColumn("found", F.when(F.col("said").isNotNull(), forced).otherwise(F.col("found")))
    return at.select("list_key", "found.order", "found.confidence", "found.source", "n_votes", "fl", "lf", "alpha_lead", "alpha_trail")


def with_order(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """rows plus ``name_order`` of their list."""
    return rows.withColumn("__key", list_key()).join(orders.select(F.col("list_key").alias("__key"), F.col("order").alias("name_order")), "__key").drop("__key")
