"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollcall.sources.shared import discard, saved, shared_dir

__all__ = ["discard", "extended", "let", "others", "row_key", "saved", "shared_dir", "sieve", "table"]

#: Words of 64 bits that a sieve has at most; they are all that is broadcast, however many keys there are.
SIEVE_WORDS = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
def _no_sign_of(*ranges: tuple[int, int]) -> str:
    """Pattern of runs of other signs than those of the ranges, each written out: Java looks single signs up in one step."""
    return "[^" + "".join(rf"\x{code:02X}" for low, high in ranges for code in range(low, high + 1)) + "]+"


#: Words that licence, benchmark and similar scans compare, in texts with lowered capitals and in others.
ALNUM_WORD = _no_sign_of((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
ANY_CASE_WORD = _no_sign_of((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Words between ASCII white space.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> list[Column]:
    """Two 64-bit hashes, ``k1`` and ``k2``, that stand for a row's doc_id and text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text")
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), text, doc_id).alias("k2")]


def sieve(rows: DataFrame, keys: DataFrame, on: str = "k1") -> tuple[DataFrame, DataFrame]:
    """Split ``rows`` by the 64-bit hash ``on`` into (those that may be among ``keys``, those that are not).

    One bit for each key is set in a table of at most ``SIEVE_WORDS`` words,
    which is broadcast. With many keys more rows are let through for nothing,
    none are lost: an exact join of the first part has to follow.
    """
    place = F.pmod(F.col(on), F.lit(SIEVE_WORDS)).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright({on}, 32), 64) as int))")
    words = keys.groupBy(place.alias("sieve_place")).agg(F.bit_or(bit).alias("sieve_word"))
    marked = rows.join(F.broadcast(words), place == F.col("sieve_place"), "left")
    hit = F.coalesce(F.col("sieve_word").bitwiseAND(bit) != 0, F.lit(False))
    return tuple(marked.where(x).drop("sieve_place", "sieve_word") for x in (hit, ~hit))


def others(columns: list[str], taken) -> list[str]:
    """The columns but those named like one of ``taken``, in whatever case."""
    names = {t.lower() for t in taken}
    return [c for c in columns if c.lower() not in names]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``, however often and in whatever lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def extended(schema: StructType, fields: str) -> StructType:
    """``schema`` with the fields of a DDL string after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(fields).fields])
