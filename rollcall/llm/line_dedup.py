"""Drop lines that recur across documents, keeping them in one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import BLANKS, ascii_lower, discard, let, others, quoted, row_key, saved, sieve
from rollcall.operators.skew import spread_join


def line_key(line: Column) -> Column:
    """What lines are compared by: stripped of ASCII white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _without(lines: Column, dropped: Column) -> Column:
    """The lines at all positions but ``dropped``, joined again; linear in the number of lines."""
    return let(
        lines,
        lambda x: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), dropped), lambda i: F.get(x, i)), "\n"
        ),
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Remove lines whose key stands in at least ``min_docs`` documents, but from the largest doc_id that has it.

    ``docs`` has ``doc_id`` and ``text``; other columns are kept as they are.
    Keys shorter than ``min_chars`` code points are never dropped. Returns the
    columns of ``docs`` with ``text`` replaced, plus ``n_lines`` (before) and
    ``n_dropped``; columns that are named like these, in whatever case, go.

    A null or empty text is one empty line and comes back as an empty text.
    Rows that share a doc_id count as one document; rows without doc_id are one
    document, smaller than any other. Repeated rows are treated alike. A line
    that recurs within one document counts once, and all its places go or stay
    together. An empty table gives an empty result. Lines and rows are told
    apart by 128 bits of hash. Only texts that lose lines are shuffled, and the
    places of a line that very many documents hold are spread over tasks.
    """
    doc_id = F.col("doc_id").alias("doc_id")
    lines = docs.select(doc_id, *row_key(), F.posexplode(_split(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "k1", "k2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    keyed = saved(keyed.select("doc_id", "k1", "k2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines-keyed")
    held = keyed.groupBy("h1", "h2").agg(
        F.countDistinct(F.struct("doc_id")).alias("holders"), F.max("doc_id").alias("keeper"), F.count(F.lit(1)).alias("rows")
    )
    common = saved(held.where(F.col("holders") >= min_docs).select("h1", "h2", "keeper", "rows"), "lines-common")
    gone = spread_join(keyed, common, ["h1", "h2"], "k1", "rows", keyed.count()).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = saved(gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias("dropped")), "lines-dropped")
    discard(keyed, common)

    kept = others(docs.columns, ("text", "n_lines", "n_dropped"))
    wide = docs.select(F.struct(F.lit(0).alias("none"), *[F.col(quoted(c)) for c in kept]).alias("doc"), *row_key(), F.coalesce("text", F.lit("")).alias("text"))
    may, clear = sieve(wide, drops)
    may = may.join(drops, ["k1", "k2"], "left")
    places, n_lines = F.col("dropped"), F.size(_split(F.col("text"))).cast("long").alias("n_lines")
    shortened = F.when(places.isNull(), F.col("text")).otherwise(_without(_split(F.col("text")), places))
    some = may.select("doc", shortened.alias("text"), n_lines, F.coalesce(F.when(places.isNotNull(), F.size(places)), F.lit(0)).cast("long").alias("n_dropped"))
    out = clear.select("doc", "text", n_lines, F.lit(0).cast("long").alias("n_dropped")).union(some)
    return out.select(*[F.col(f"doc.{quoted(c)}") for c in kept], "text", "n_lines", "n_dropped")
