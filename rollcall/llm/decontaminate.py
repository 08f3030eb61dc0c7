"""Find benchmark passages in documents by winnowing, with DataFrame functions only.

Of every window of ``window`` words the least hash of its ``gram``-word runs is
the window's fingerprint. Neighbouring windows mostly share theirs, so that a
document gives one row (fingerprint, first window, last window) for each run of
equal ones. Equal windows have equal fingerprints: joining the fingerprints of
documents and benchmark finds every shared window. Each hit is then extended to
the whole windows of its run, which are held against those of the items. An item
shorter than a window is a window of its own length, whose fingerprint is the
hash of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import ALNUM_WORD, ANY_CASE_WORD, ascii_lower, discard, let, row_key, saved, sieve
from rollcall.operators.skew import spread_join


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long")


def _ints(first, last) -> Column:
    """The integers from ``first`` to ``last``; none if last is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _runs(hashes: Column, window: int, gram: int) -> Column:
    """Array of (print, lo, hi, length): the fingerprint that all windows starting at words ``lo`` to ``hi`` have."""
    each = window - gram + 1

    def of_least(least: Column) -> Column:
        starts = F.filter(_ints(F.lit(1), F.size(least)), lambda i: (i == 1) | (F.get(least, i - 1) != F.get(least, i - 2)))
        run = lambda s, lo, k: F.struct(F.get(least, lo - 1).alias("print"), lo.alias("lo"), F.coalesce(F.get(s, k + 1) - 1, F.size(least)).alias("hi"), F.lit(window).alias("length"))
        return let(starts, lambda s: F.transform(s, lambda lo, k: run(s, lo, k)))

    grams = F.transform(_ints(F.lit(1), F.size(hashes) - gram + 1), lambda i: F.xxhash64(F.slice(hashes, i, gram)))
    return let(grams, lambda g: let(F.transform(_ints(F.lit(1), F.size(g) - each + 1), lambda i: F.array_min(F.slice(g, i, each))), of_least))


def _short_runs(hashes: Column, length: int) -> Column:
    """The same of the windows of ``length`` words, each with the hash of all of them."""
    at = lambda i: F.struct(F.xxhash64(F.slice(hashes, i, length)).alias("print"), i.alias("lo"), i.alias("hi"), F.lit(length).alias("length"))
    return F.transform(_ints(F.lit(1), F.size(hashes) - length + 1), at)


def fingerprints(found: Column, window: int, gram: int, lengths: list[int]) -> Column:
    """Runs of fingerprints of an array of words, with those of the shorter windows of ``lengths``."""
    return let(F.transform(found, lambda x: F.xxhash64(x)), lambda h: F.concat(_runs(h, window, gram), *[_short_runs(h, m) for m in lengths]))


def _window_id(window: Column) -> list[Column]:
    return [F.xxhash64(window).alias("h1"), F.xxhash64(F.lit(1), window).alias("h2")]


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """Rows (h1, h2, length, item_id), each once: the windows of the items."""
    n = F.size("words")
    length = F.least(n, F.lit(window))
    at = items.where(n > 0).select("item_id", "words", length.alias("length"), F.explode(_ints(F.lit(1), n - length + 1)).alias("i"))
    cut = at.select("item_id", "length", F.slice("words", F.col("i"), F.col("length")).alias("cut"))
    return cut.select(*_window_id(F.col("cut")), "length", "item_id").distinct()


def _with_rows(right: DataFrame, left: DataFrame, on: list[str]) -> DataFrame:
    """``right`` with the number of rows of ``left`` that have its key; keys that ``left`` has not are left out."""
    return right.join(left.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")), on)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (k1, k2, n_words, n_hit, items) of the documents (k1, k2, text) with a hit, each once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    items = saved(items.where(F.size("words") > 0), "decontaminate-items")
    short = [r.m for r in items.where(F.size("words") < window).select(F.size("words").alias("m")).distinct().collect()]  # less than ``window`` numbers
    windows = saved(_item_windows(items, window), "decontaminate-windows")
    lengths = F.when(F.size("words") < window, F.filter(F.array(*map(F.lit, short)), lambda m: m == F.size("words"))) if short else F.lit(None)
    own = fingerprints(F.col("words"), window, gram, short)
    own = F.filter(own, lambda x: (x["length"] == window) | F.coalesce(F.array_contains(lengths, x["length"]), F.lit(False))) if short else own
    prints = saved(items.select(F.explode(own).alias("x")).select("x.print", "x.length").distinct(), "decontaminate-prints")

    on = ["print", "length"]
    each = docs.select("k1", "k2", F.explode(fingerprints(words(F.col("text")), window, gram, sorted(short))).alias("x")).select("k1", "k2", "x.*")
    touched = saved(sieve(each, prints, "print")[0], "decontaminate-touched")
    hits = spread_join(touched, _with_rows(prints, touched, on), on, "k1", "rows", touched.count())
    hits = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi", "length")).alias("hits"))
    hits = saved(hits, "decontaminate-hits")

    may = sieve(docs, hits)[0].join(hits, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    may = may.select("k1", "k2", "hits", words(F.col("text")).alias("words"))
    cut = lambda w, i, m: F.struct(i.alias("i"), m.alias("length"), F.slice(w, i, m).alias("cut"))
    starts = F.flatten(F.transform("hits", lambda x: F.transform(_ints(x["lo"], x["hi"]), lambda i: F.struct(i.alias("i"), x["length"].alias("m")))))
    ids = F.transform(starts, lambda x: cut(F.col("words"), x["i"], x["m"]))
    ids = F.transform(ids, lambda x: F.struct(x["i"].alias("i"), x["length"].alias("length"), *_window_id(x["cut"])))
    at = may.select("k1", "k2", F.size("words").cast("long").alias("n_words"), F.explode(ids).alias("x")).select("k1", "k2", "n_words", "x.*")
    at = saved(at, "decontaminate-at")
    discard(touched, prints, items)

    on = ["h1", "h2", "length"]
    met = spread_join(at, _with_rows(windows, at, on), on, "k1", "rows", at.count())
    spans = F.array_sort(F.collect_set(F.struct(F.col("i").alias("lo"), (F.col("i") + F.col("length")).alias("hi"))))
    per_doc = met.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))
    grow = lambda acc, x: F.struct(
        (acc["sum"] + F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], acc["end"]))).alias("sum"), F.greatest(acc["end"], x["hi"]).alias("end")
    )
    return per_doc.select("k1", "k2", "n_words", F.aggregate("spans", start, grow)["sum"].alias("n_hit"), "items")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 9) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item.

    A window is ``window`` consecutive words of an item; an item with fewer
    words, but not none, is one window. ``docs`` has ``doc_id`` and ``text``,
    ``benchmark`` has ``item_id`` and ``text``; other columns are ignored.
    Returns one row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``
    (words in some occurrence of a window) and ``items`` (sorted ids, as
    strings, of the items with an occurring window).

    Null and empty texts have no words and no hits. Repeated documents come
    back as often as they came; repeated items count once; an item without id
    makes hits but is not listed. Empty tables give no hits or no rows. Rows are
    told apart by 128 bits of hash of doc_id and text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text")
    found = _found(docs.select("k1", "k2", "text"), benchmark, window, gram)
    every = docs.select("doc_id", "k1", "k2", n_words(F.col("text")).alias("n_words"))
    none = F.array().cast("array<string>")
    out = every.join(found.drop("n_words"), ["k1", "k2"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def is_contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """A document is contaminated if one word in ``share`` or more is hit."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 9, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns; see ``benchmark_hits``.

    Null and empty texts stay, repeated rows stay or go together, and an empty
    table of either kind changes nothing. Only rows that may have to go are
    shuffled with their texts.
    """
    keyed = docs.select(F.struct("*").alias("doc"), *row_key(), "text")
    found = _found(keyed.select("k1", "k2", "text"), benchmark, window, gram)
    bad = saved(found.where(is_contaminated(F.col("n_hit"), F.col("n_words"), share)).select("k1", "k2"), "decontaminate-bad")
    may, clear = sieve(keyed.select("doc", "k1", "k2"), bad)
    return clear.select("doc.*").union(may.join(bad, ["k1", "k2"], "left_anti").select("doc.*"))
