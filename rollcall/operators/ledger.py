"""Review decisions as pairs: harvested from reviewed groups and applied to fresh ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.operators.components import connected_components
from rollcall.sources.shared import saved
from rollcall.sources.tables import LEDGER


def pair_key(a: Column, b: Column) -> list[Column]:
    """P1."""
    return [F.least(a, b).alias("entry_a"), F.greatest(a, b).alias("entry_b")]


def group_pairs(candidates: DataFrame) -> DataFrame:
    """The decisions that reviewed groups state, in order.

    A group whose first row is y accepts all pairs of rows that are not x, and
    rejects each x row with each of those; one whose first row is n rejects all
    pairs. ``candidates`` has group_id, row_ord, entry_id, match,
    normalized_name, book and edition.
    """
    along = Window.partitionBy("group_id").orderBy("row_ord")
    said = F.lower(F.trim("match"))
    at = candidates.select("group_id", "row_ord", "entry_id", F.col("normalized_name").alias("name"), F.concat_ws("|", "book", "edition").alias("context"),
                           said.alias("said"), F.first(said).over(along).alias("lead"), F.min("row_ord").over(Window.partitionBy("group_id")).alias("group_ord"))
    at = at.where(F.col("lead").isin("y", "n"))
    a, b = at.alias("a"), at.alias("b")
    met = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.row_ord") < F.col("b.row_ord")))
    ax, bx = F.col("a.said") == "x", F.col("b.said") == "x"
    verdict = F.when(F.col("a.lead") == "n", "n").when(ax & bx, None).when(ax | bx, "n").otherwise("y")
    first = F.col("a.entry_id") <= F.col("b.entry_id")

    def pick(field: str, one: bool) -> Column:
        x, y = F.col(f"a.{field}"), F.col(f"b.{field}")
        return F.when(first, x if one else y).otherwise(y if one else x)

    return met.where(verdict.isNotNull()).select(
        pick("entry_id", True).alias("entry_a"), pick("entry_id", False).alias("entry_b"), verdict.alias("verdict"),
        pick("name", True).alias("name_a"), pick("name", False).alias("name_b"),
        pick("context", True).alias("context_a"), pick("context", False).alias("context_b"),
        F.struct(F.col("a.group_ord"), (ax | bx).cast("int"), F.when(bx & ~ax, F.col("b.row_ord")).otherwise(F.col("a.row_ord")), F.when(bx & ~ax, F.col("a.row_ord")).otherwise(F.col("b.row_ord"))).alias("ord"),
    )


def harvest(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger with the decisions of ``candidates``; a changed verdict is noted."""
    rest = [F.col(c) for c in LEDGER[3:7]]
    steps = group_pairs(candidates).groupBy("entry_a", "entry_b").agg(F.array_sort(F.collect_list(F.struct("ord", "verdict", *rest))).alias("steps"))
    old = ledger.select("entry_a", "entry_b", F.col("verdict").alias("old"), F.col("note").alias("old_note"), *[F.col(c).alias(f"old_{c}") for c in LEDGER[3:7]])
    met = steps.join(old, ["entry_a", "entry_b"], "full")
    start = F.struct(F.col("old").alias("verdict"), F.coalesce("old_note", F.lit("")).alias("note"), *[F.col(f"old_{c}").alias(c) for c in LEDGER[3:7]])

    def step(acc: Column, x: Column) -> Column:
        changed = F.trim(F.concat(acc["note"], F.lit(" [was "), acc["verdict"], F.lit(", now "), x["verdict"], F.lit("]")))
        fresh = lambda note: F.struct(x["verdict"].alias("verdict"), note.alias("note"), *[x[c].alias(c) for c in LEDGER[3:7]])
        return F.when(acc["verdict"].isNull(), fresh(F.lit(""))).when(acc["verdict"] != x["verdict"], fresh(changed)).otherwise(acc)

    done = met.select("entry_a", "entry_b", F.aggregate(F.coalesce("steps", F.expr("array()").cast(steps.schema["steps"].dataType)), start, step).alias("x"))
    return done.select("entry_a", "entry_b", "x.verdict", *[f"x.{c}" for c in LEDGER[3:7]], "x.note")


def _groups_in_question(candidates: DataFrame) -> DataFrame:
    """Rows (node, group_id, entry_id, lead, rows, entries): each entry of a group once, with the group's first entry and sizes."""
    slim = candidates.select("group_id", "row_ord", "entry_id")
    heads = slim.groupBy("group_id").agg(F.min_by("entry_id", "row_ord").alias("lead"), F.count(F.lit(1)).alias("rows"), F.count_distinct("entry_id").alias("entries"))
    each = slim.select("group_id", "entry_id").distinct().join(heads, "group_id")
    return each.withColumn("node", F.struct("group_id", "entry_id"))


def _verdicts(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows (group_id, entry_a, entry_b, verdict): what the ledger says of two entries of one group."""
    one = entries.select("group_id", F.col("entry_id").alias("entry_a"))
    other = entries.select("group_id", F.col("entry_id").alias("entry_b"))
    said = ledger.select("entry_a", "entry_b", "verdict")
    return one.join(said, "entry_a").join(other, ["group_id", "entry_b"])


def apply_ledger(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """``candidates`` with ``match`` filled in for the groups that the ledger decides.

    The part of a group that pairs of verdict y tie to its first entry is
    accepted, and all others are marked x, if no two of the part are told apart
    by an n and each other entry is told apart from one of the part. Where
    nothing is tied to the first entry, the group is rejected if every pair of
    it is an n. All other groups stay as they are.
    """
    entries = saved(_groups_in_question(candidates), "ledger-entries")
    known = saved(_verdicts(entries, ledger), "ledger-known")
    ends = {side: F.struct("group_id", F.col(f"entry_{side}").alias("entry_id")) for side in "ab"}
    tied = connected_components(known.where("verdict = 'y'").select(ends["a"].alias("u"), ends["b"].alias("v")), "ledger-tied")
    part = F.coalesce("component", "node")
    parts = entries.join(tied, "node", "left").select("node", "group_id", "entry_id", "lead", part.alias("part"))
    leads = parts.where(F.col("entry_id") == F.col("lead")).select("group_id", F.col("part").alias("lead_part"))
    placed = parts.join(leads, "group_id").select("group_id", "entry_id", (F.col("part") == F.col("lead_part")).alias("tied"))
    placed = saved(placed, "ledger-placed")

    apart = known.where("verdict = 'n'")
    for side in "ab":
        apart = apart.join(placed.select("group_id", F.col("entry_id").alias(f"entry_{side}"), F.col("tied").alias(f"tied_{side}")), ["group_id", f"entry_{side}"])
    outsider = F.when(F.col("tied_a") != F.col("tied_b"), F.when(F.col("tied_a"), F.col("entry_b")).otherwise(F.col("entry_a")))
    split = apart.groupBy("group_id").agg(F.count(F.lit(1)).alias("apart"), F.bool_or(F.col("tied_a") & F.col("tied_b")).alias("torn"), F.count_distinct(outsider).alias("refused"))
    sizes = placed.groupBy("group_id").agg(F.count_if("tied").alias("inside"), F.count(F.lit(1)).alias("all"))
    told = sizes.join(entries.select("group_id", "rows", "entries").distinct(), "group_id").join(split, "group_id", "left").na.fill(0, ["apart", "refused"]).na.fill(False, ["torn"])
    n = F.col("entries")
    rejected = (F.col("inside") == 1) & (n >= 2) & (F.col("rows") == n) & (2 * F.col("apart") == n * (n - 1))
    accepted = (F.col("inside") > 1) & ~F.col("torn") & (F.col("refused") == F.col("all") - F.col("inside"))
    decided = told.where(rejected | accepted).select("group_id", rejected.alias("rejected")).join(placed, "group_id")
    verdict = F.when(F.col("rejected"), "n").when(F.col("tied"), "y").otherwise("x")
    out = candidates.join(decided.select("group_id", "entry_id", verdict.alias("decided")), ["group_id", "entry_id"], "left")
    return out.withColumn("match", F.coalesce("decided", "match")).select(*candidates.columns)


def apply_review(candidates: DataFrame, actions: DataFrame) -> DataFrame:
    """``candidates`` after review actions (seq, group_id, action, position): y, n, or x for one row of a group.

    Later actions see what earlier ones left: y fills all rows but those marked
    x, n marks the first row.
    """
    at = candidates.withColumn("__k", F.row_number().over(Window.partitionBy("group_id").orderBy("row_ord")))
    steps = actions.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "position"))).alias("__steps"))

    def step(acc: Column, s: Column) -> Column:
        return (
            F.when((s["action"] == "x") & (s["position"] == F.col("__k")), F.lit("x")).when((s["action"] == "y") & (acc != "x"), F.lit("y"))
            .when((s["action"] == "n") & (F.col("__k") == 1), F.lit("n")).otherwise(acc)
        )

    out = at.join(steps, "group_id", "left")
    done = F.when(F.col("__steps").isNull(), F.col("match")).otherwise(F.aggregate("__steps", F.col("match"), step))
    return out.withColumn("match", done).select(*candidates.columns)


def pending_groups(candidates: DataFrame, rule: str = "") -> DataFrame:
    """Groups whose first row is neither y nor n, and whose first rule has ``rule`` in it."""
    along = Window.partitionBy("group_id").orderBy("row_ord")
    first = candidates.withColumn("__k", F.row_number().over(along)).where("__k = 1")
    open_ = first.where(~F.lower(F.trim("match")).isin("y", "n") & F.col("match_rule").contains(rule))
    return open_.select("group_id", "row_ord", "match_rule").orderBy("row_ord")


def display_groups(candidates: DataFrame, width: int = 24) -> DataFrame:
    """Cells cut to a width, with an ellipsis."""
    def cell(c: str) -> Column:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.rpad(F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text), width, " ").alias(c)

    return candidates.orderBy("group_id", "row_ord").select(*[cell(c) for c in candidates.columns if c != "row_ord"])
