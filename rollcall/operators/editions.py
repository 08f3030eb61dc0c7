"""Who left and who came between editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.compat import last_name_score, pair_scores

SUMMARY = ["parsed_title", "parsed_first", "parsed_last", "parsed_postnominals", "parsed_location"]


def label(e) -> Column:
    """S3: title and name, with postnominals and place behind; ``e`` gives a column by name."""
    def said(*names: str) -> Column:
        return F.filter(F.array(*[F.trim(e(n)) for n in names]), lambda x: x != "")

    more = F.array_join(said("parsed_postnominals", "parsed_location"), ", ")
    name = F.array_join(said("parsed_title", "parsed_first", "parsed_last"), " ")
    return F.when(more != "", F.concat(name, F.lit(" ("), more, F.lit(")"))).otherwise(name)


def persons(rows: DataFrame) -> DataFrame:
    """A row for each person: first and last edition, all of them, the fullest row's fields, label and entries.

    Rows whose edition is no whole number are left out.
    """
    at = rows.withColumn("ed", F.trim(F.col("edition").cast("string")).try_cast("int")).where("ed is not null")
    rich = sum(((F.trim(c) != "").cast("int") for c in SUMMARY), F.lit(0))
    fullest = F.max_by(F.struct(*[F.trim(c).alias(c) for c in SUMMARY]), F.struct(rich.alias("rich"), (-F.col("row_ord")).alias("ord")))
    longest = F.max_by(label(F.col), F.struct(F.length("normalized_name").alias("n"), (-F.col("row_ord")).alias("ord")))
    return at.groupBy("person_id").agg(
        F.min("ed").alias("first_ed"), F.max("ed").alias("last_ed"), F.array_sort(F.collect_set("ed")).alias("editions"),
        fullest.alias("s"), longest.alias("label"), F.array_sort(F.collect_list("entry_id")).alias("entries"),
    ).select("person_id", "first_ed", "last_ed", F.array_join(F.col("editions").cast("array<string>"), ",").alias("editions"), "s.*", "label", F.array_join("entries", "|").alias("entry_ids"))


def _like_last_names(dep: DataFrame, arr: DataFrame) -> DataFrame:
    """Rows (dep_last_ed, __dl, arr_first_ed, __al): pairs of last names that score, once for each two editions."""
    size = F.length("__dl")
    sizes = F.sequence(F.ceil(size * 0.55 - 1e-6).cast("int"), F.floor(size / 0.55 + 1e-6).cast("int"))
    left = dep.where("__dl <> ''").select("dep_last_ed", "__dl").distinct()
    left = left.select("*", (F.col("dep_last_ed") + 1).alias("arr_first_ed"), F.explode(sizes).alias("__size"))
    right = arr.where("__al <> ''").select("arr_first_ed", "__al", F.length("__al").alias("__size")).distinct()
    return left.join(right, ["arr_first_ed", "__size"]).where(last_name_score(F.col("__dl"), F.col("__al")) > 0).drop("__size")


def missed_matches(rows: DataFrame, min_score: float = 2.5) -> DataFrame:
    """Departures of an edition with like arrivals of the next, best first.

    Distinct last names of two editions are compared first, those whose lengths
    let them be like each other; persons are joined by edition and by pairs of
    last names that score. Without a like last name the score is 0, so where
    ``min_score`` lets such pairs through, all persons of two editions meet.
    """
    every = persons(rows)
    dep = every.select(*[F.col(c).alias(f"dep_{c}") for c in every.columns], F.lower("parsed_last").alias("__dl"))
    arr = every.select(*[F.col(c).alias(f"arr_{c}") for c in every.columns], F.lower("parsed_last").alias("__al"))
    if min_score > 0:
        met = dep.join(_like_last_names(dep, arr), ["dep_last_ed", "__dl"]).join(arr, ["arr_first_ed", "__al"])
    else:
        met = dep.join(arr, F.col("dep_last_ed") + 1 == F.col("arr_first_ed"))
    parts = pair_scores(lambda n: F.col(f"dep_{n}"), lambda n: F.col(f"arr_{n}"))
    out = met.select(
        parts["score"].alias("score"), F.concat_ws("→", F.col("dep_last_ed").cast("string"), F.col("arr_first_ed").cast("string")).alias("edition_boundary"),
        *[F.col(f"{side}_{old}").alias(f"{side}_{new}") for old, new in (("label", "label"), ("parsed_last", "last"), ("parsed_title", "title"), ("parsed_first", "first"), ("parsed_location", "location"), ("parsed_postnominals", "postnominals"), ("editions", "editions"), ("person_id", "pid"), ("entry_ids", "entry_ids")) for side in ("dep", "arr")],
        *[parts[p].alias(f"detail_{p}") for p in ("s_last", "s_title", "s_first", "s_loc", "s_post")],
    )
    return out.where(F.col("score") >= min_score).orderBy(F.desc("score"), "dep_pid", "arr_pid")


def edition_overview(rows: DataFrame) -> DataFrame:
    """For each edition how many persons it has, how many are new, stayed or left since the one before it."""
    at = rows.withColumn("ed", F.trim(F.col("edition").cast("string")).try_cast("int")).where("ed is not null").select("person_id", "ed").distinct()
    eds = at.select("ed").distinct()
    before = eds.alias("x").join(eds.alias("y"), F.col("y.ed") < F.col("x.ed"), "left").groupBy(F.col("x.ed").alias("ed")).agg(F.max("y.ed").alias("prev"))
    total = at.groupBy("ed").agg(F.count(F.lit(1)).alias("total"))
    stayed = at.join(before, "ed").join(at.select("person_id", F.col("ed").alias("prev")), ["person_id", "prev"]).groupBy("ed").agg(F.count(F.lit(1)).alias("continued"))
    out = total.join(before, "ed").join(stayed, "ed", "left").join(total.select(F.col("ed").alias("prev"), F.col("total").alias("prev_total")), "prev", "left")
    continued, known = F.coalesce("continued", F.lit(0)), F.coalesce("prev_total", F.lit(0))
    return out.select(F.col("ed").alias("edition"), "total", (F.col("total") - continued).alias("new"), continued.alias("continued"), (known - continued).alias("departed")).orderBy("edition")
