"""From lists to consolidated rows: ids, numbers, filters, compound entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.text import tokens

ARTICLES = ["a", "an", "the"]
#: Titles that tell that a compound entry names two persons, and words before them.
COMPOUND_TITLES = [
    "Mr.", "Mrs.", "Ms.", "Miss", "Messrs.", "Dr.", "Rev.", "Capt.", "Col.", "Lt.", "Adm.", "Sgt.", "Prof.",
    "Mister", "Reverend", "Captain", "Colonel", "Lieutenant", "Admiral", "Doctor", "Professor", "Sir", "Dame",
    "Lord", "Lady", "Duke", "Duchess", "Earl", "Countess", "Marquess", "Marquis", "Marchioness", "Viscount",
    "Viscountess", "Visc.", "Baron", "Baroness",
]
COMPOUND_MODIFIERS = ["Dowager", "Right", "Most"]


def entry_id(author: Column, book: Column, edition: Column, number: Column) -> Column:
    """Surname, first word of the book, edition and the number in four digits or more."""
    words = F.split(F.trim(book), r"\s+")
    first = F.coalesce(F.get(F.filter(words, lambda w: ~F.lower(w).isin(ARTICLES)), F.lit(0)), F.get(words, F.lit(0)))
    surname = F.regexp_replace(F.get(F.split(F.trim(author), r"\s+"), F.lit(0)), ",+$", "")
    return F.concat_ws("-", surname, first, edition, F.format_string("%04d", number.cast("int")))


def drop_blank(rows: DataFrame, columns=("author", "book", "edition", "listed as")) -> DataFrame:
    """Rows in which none of the columns is blank."""
    for c in columns:
        rows = rows.where(F.trim(F.col(f"`{c}`")) != "")
    return rows


def number_rows(rows: DataFrame, number: str = "no.", file: str = "file", order: str = "row_ord") -> DataFrame:
    """Blank numbers count on from the largest of their file and edition, in row order.

    The largest is taken over all rows, also those that are left out for blank
    fields. Returns the rows that are kept plus ``number``.
    """
    said = F.trim(F.col(f"`{number}`"))
    value = said.try_cast("int")
    top = F.coalesce(F.max(value).over(Window.partitionBy(file, "edition")), F.lit(0))
    kept = drop_blank(rows.withColumn("__top", top).withColumn("__blank", said == ""))
    turn = F.row_number().over(Window.partitionBy(file, "edition", "__blank").orderBy(order))
    return kept.withColumn("number", F.when(F.col("__blank"), F.col("__top") + turn).otherwise(value)).drop("__top", "__blank")


def duplicate_ids(rows: DataFrame, file: str = "file") -> DataFrame:
    """C4: ids that a file has more than once."""
    return rows.groupBy(file, "entry_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def refined(rows: DataFrame) -> Column:
    """The refined listing where there is one."""
    if "refined listing" not in rows.columns:
        return F.col("`listed as`")
    return F.when(F.trim(F.col("`refined listing`")) != "", F.col("`refined listing`")).otherwise(F.col("`listed as`"))


def consolidate(rows: DataFrame) -> DataFrame:
    """Rows of ``scan_lists`` as consolidated rows; an error if a file repeats an id."""
    at = number_rows(rows).withColumn("normalization input", refined(rows))
    at = at.withColumn("entry_id", entry_id(F.col("author"), F.col("book"), F.col("edition"), F.col("number")))
    if repeated := duplicate_ids(at).limit(5).collect():
        raise ValueError(f"numbers repeat within a file and edition: {[r['entry_id'] for r in repeated]}")
    leading = ["entry_id", "person_id", "normalization input", "listed as", "book", "author", "edition", "year"]
    extra = [c for c in rows.columns if c not in (*leading, "no.", "refined listing", "file", "row_ord")]
    return at.withColumn("person_id", F.col("entry_id")).select(*[F.col(f"`{c}`") for c in (*leading, *extra, "row_ord")])


def _any(values) -> str:
    return "|".join(v.replace(".", r"\.") for v in values)


_TITLED = rf"^((?:(?:{_any(COMPOUND_MODIFIERS)}) )?(?:{_any(COMPOUND_TITLES)}))(?: (.*))?$"


def split_compound(name: Column) -> Column:
    """One or two names; the first gets what follows the second one's title."""
    at = F.instr(name, " and ")
    left = F.trim(F.substring(name, F.lit(1), at - 1))
    right = F.trim(F.substring(name, at + 5, F.length(name)))
    words = F.array_join(tokens(right), " ")
    shared = F.trim(F.regexp_extract(words, _TITLED, 2))
    titled = F.arrays_overlap(tokens(left), F.array(*map(F.lit, COMPOUND_TITLES)))
    first = F.when(shared != "", F.concat_ws(" ", left, shared)).otherwise(left)
    return F.when((at > 0) & words.rlike(_TITLED) & titled, F.array(first, right)).otherwise(F.array(name))


def split_compounds(rows: DataFrame, name: str = "normalization input") -> DataFrame:
    """A row for each person; ids of split rows end in a and b, ``source_entry_id`` has the old one."""
    parts = rows.select("*", F.posexplode(split_compound(F.col(f"`{name}`"))).alias("__k", "__part"), F.size(split_compound(F.col(f"`{name}`"))).alias("__n"))
    new = F.when(F.col("__n") > 1, F.concat("entry_id", F.element_at(F.array(F.lit("a"), F.lit("b")), F.col("__k") + 1))).otherwise(F.col("entry_id"))
    changed = {"entry_id": new, "person_id": F.when(F.col("__n") > 1, new).otherwise(F.col("person_id")), name: F.col("__part")}
    out = []
    for c in rows.columns:
        out.append(changed.get(c, F.col(f"`{c}`")).alias(c))
        if c == "entry_id":
            out.append(F.col("entry_id").alias("source_entry_id"))
    return parts.select(*out, F.col("__k").alias("part"))
