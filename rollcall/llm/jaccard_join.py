"""Exact Jaccard self-join of word n-gram sets by vertical partitioning.

The n-grams' global order is cut into fragments. The overlap of two documents is
counted for each fragment on its own, from the parts of both sets that lie in
it, and the partial overlaps are summed per pair.

Which pairs are counted follows from the sets. Equal sets are one class. A class
whose first stretch in the order of the hashes shares too few n-grams with any
other links with none; the whole sets of the rest give their shared n-grams from
the rarest on, and linked sets have one of the first few of these in common. The
list of classes under such an n-gram is not paired off. In each round some of
its members, the pivots, meet the others, but for those of their own group of
links and those whose sketches differ in more bits than linked sets can: a
sketch holds the parity of the n-grams by a hash of 512 values, so that it
differs in no more bits than the sets do in n-grams. Pivots are the members
with the smallest random ids, 8 of a list in the first round and 4 times as
many in each further one, so that a list of any length is done after a few
rounds: every pair has met, or was linked through others, or cannot be linked.
What is left of the lists is paired off in one round once that takes few pairs,
and few links become components in one task, as each round costs the driver
dozens of jobs however few rows it is about.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import discard, row_key, saved, sieve
from rollcall.llm.shingles import mix, shingle_sets
from rollcall.operators.components import connected_components
from rollcall.operators.skew import copies, dealt, spread_join

#: Fragments of the n-gram order are told by so many leading bits of the hash.
FRAGMENT_BITS = 2
#: Pivots of a list in the first round, and how many times more there are in each further round.
PIVOTS, MORE_PIVOTS = 8, 4
#: Pairs that one last round may have to look at, and links that one task may turn into components; more go in rounds.
LAST_PAIRS, TOGETHER = 1 << 18, 100_000
#: Words of a sketch, 64 bits each.
SKETCH = tuple(f"s{k}" for k in range(8))
#: Members of a list that meet its pivots in one task, and tasks over which the members of a group are spread.
LIST_ROWS, GROUP_WAYS = 512, 16
#: Texts that are hashed at once.
BATCH_CHARS = 1_500_000


def overlap_needed(n: int, percent: int) -> int:
    """The least overlap that a set of ``n`` has with any set it is linked with."""
    return -(-percent * n // 100)


def stretch(n: int, percent: int) -> int:
    """Length of the first stretch that a set of ``n`` keeps: linked sets share a tenth of ``n`` in it, or one n-gram."""
    return min(n, n - overlap_needed(n, percent) + max(1, -(-n // 10)))


def spare(n: Column, percent: int) -> Column:
    """N-grams that linked sets share within their kept stretches, at least: from the smaller set's view a tenth of what is needed."""
    needed = F.floor((n * percent + 99) / 100)
    return F.greatest(F.lit(1), F.floor((needed + 9) / 10))


def _chunks(texts: list):
    """Slices of ``texts`` of about ``BATCH_CHARS`` characters."""
    lo = size = 0
    for k, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= BATCH_CHARS:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _class_id(grams: np.ndarray) -> bytes:
    """128-bit digest of a set; equal sets have equal digests."""
    first = mix(grams).sum(dtype=np.uint64, keepdims=True) * np.uint64(2 * len(grams) + 1)
    second = mix(grams ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64, keepdims=True)
    return first.tobytes() + second.tobytes()


def _profile(width: int, percent: int):
    fields = [("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("cid", pa.binary()), ("half", pa.int64()), ("grams", pa.list_(pa.int64()))]
    schema = pa.schema(fields)
    none = np.empty(0, np.uint64)

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for lo, hi in _chunks(texts):
                ns, cids, kept = [], [], []
                for grams in shingle_sets(texts[lo:hi], width):
                    n = len(grams)
                    cid = _class_id(grams)
                    fresh = n > 0 and cid not in seen  # copies in one task are profiled once
                    if fresh:
                        seen.add(cid)
                    ns.append(n)
                    cids.append(cid)
                    kept.append(grams[: stretch(n, percent)] if fresh else none)
                cuts = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                grams_col = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(kept).view(np.int64)))
                halves = np.frombuffer(b"".join(cids), np.int64)[::2]
                columns = [*(batch.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(ns, pa.int64()), pa.array(cids, pa.binary()), pa.array(halves), grams_col]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def sketches(grams: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The words for each of the non-empty sets that begin at ``starts``: bit by bit, whether an odd number of n-grams falls on it."""
    bits = np.uint64(1) << (grams & np.uint64(63))
    word = (grams >> np.uint64(6)) % np.uint64(len(SKETCH))
    return [np.bitwise_xor.reduceat(np.where(word == w, bits, np.uint64(0)), starts).view(np.int64) for w in range(len(SKETCH))]


def _sets(width: int):
    """Whole sets of the documents that are candidates, none of which is empty, and their sketches."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _chunks(texts):
                sets = shingle_sets(texts[lo:hi], width)
                cuts = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                every = np.concatenate(sets)
                columns = [batch.column("node").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cuts), pa.array(every.view(np.int64)))]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sketches(every, cuts[:-1]))], names=["node", "grams", *SKETCH])

    return run


def _scattered(number: Column) -> Column:
    """Another number for each number: shifts and exclusive ors that can be undone, so that no two become one."""
    for _ in range(3):
        number = number.bitwiseXOR(F.shiftleft(number, 13))
        number = number.bitwiseXOR(F.shiftrightunsigned(number, 7))
        number = number.bitwiseXOR(F.shiftleft(number, 17))
    return number


def _shared(grams: DataFrame, by: str) -> DataFrame:
    """Rows (by, gram) of n-grams that more than one ``by`` has, with ``df``, their number of rows; ``grams`` is shuffled once."""
    dealt = grams.where(F.col("gram").isNotNull() & F.col(by).isNotNull()).repartition("gram")  # said here, so that both uses are one plan
    held = dealt.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min(by).alias("lo"), F.max(by).alias("hi"))
    return dealt.join(held.where("lo < hi").select("gram", "df"), "gram")


def _picked(profile: DataFrame, percent: int) -> DataFrame:
    """Rows (node, cid, n, k1, k2): the classes that share enough of their stretch to link at all, each with one row's key.

    Nodes are numbered at random, each with a number of its own.
    """
    grams = profile.where("size(grams) > 0").select("half", F.explode("grams").alias("gram"))
    shared = _shared(grams, "half").groupBy("half").agg(F.count(F.lit(1)).alias("shared"))
    key = F.min(F.struct("k1", "k2")).alias("key")
    classes = profile.where("n > 0").groupBy("cid", "half", "n").agg(key).join(shared, "half").where(F.col("shared") >= spare(F.col("n"), percent))
    return saved(classes.select(_scattered(F.monotonically_increasing_id() + 1).alias("node"), "cid", "n", "key.k1", "key.k2"), "jaccard-picked")


def _ranked(docs: DataFrame, picked: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (node, n, take, shared, sketch): n-grams that others have too, the rarest first, and how many of them make candidates."""
    may, _ = sieve(docs.select("k1", "k2", "text"), picked.select("k1"))
    texts = may.join(picked.select("node", "k1", "k2"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("node", "text")
    sets = saved(texts.mapInArrow(_sets(width), f"node bigint, grams array<bigint>, {', '.join(f'{w} bigint' for w in SKETCH)}"), "jaccard-sets")
    shared = _shared(sets.select("node", F.explode("grams").alias("gram")), "node")
    shared = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("ranked"))
    n = F.col("n")
    take = F.size("ranked") - F.floor((n * percent + 99) / 100) + 1  # single n-grams come first in the order of rarity
    ranked = shared.join(picked.select("node", "n"), "node").withColumn("take", take.cast("int")).where("take > 0")
    ranked = ranked.select("node", "n", "take", F.col("ranked.gram").alias("shared"))
    out = saved(ranked.join(sets.select("node", *SKETCH), "node"), "jaccard-ranked")
    discard(sets)
    return out


def _lists(ranked: DataFrame) -> DataFrame:
    """Rows (gram, node, n, comp, sketch, size): the members of each n-gram's list, each a group of its own, and the list's size."""
    members = ranked.select(F.explode(F.slice("shared", 1, F.col("take"))).alias("gram"), "node", "n", F.col("node").alias("comp"), *SKETCH)
    sizes = members.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return members.join(sizes, "gram")


def _ways() -> Column:
    """Tasks over which a list is spread; every member knows the list's size."""
    return F.ceil(F.col("size") / LIST_ROWS).cast("int")


def _pairs(lists: DataFrame, done: float, pivots: float, percent: int) -> DataFrame:
    """Rows (p, np, cp, x, nx, cx): pivots with members of other groups, where sizes and sketches allow a link."""
    chance = F.col("node") / F.lit(2.0**64) + 0.5  # grows with the node's number
    lists = lists.where(chance >= F.lit(done) / F.col("size"))
    first = lists.where(chance < F.lit(pivots) / F.col("size")).withColumn("salt", copies(_ways()))
    first = first.select("gram", "salt", F.col("node").alias("p"), F.col("n").alias("np"), F.col("comp").alias("cp"), *[F.col(w).alias(f"p{w}") for w in SKETCH])
    rest = lists.select("gram", dealt("node", _ways()).alias("salt"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), *SKETCH)
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"p{w}"))) for w in SKETCH), F.lit(0))
    both = F.col("np") + F.col("nx")
    needed = F.ceil(both * percent / F.lit(100 + percent) - 1e-6)
    fit = (F.least("np", "nx") * 100 >= F.greatest("np", "nx") * percent) & (differ <= both - 2 * needed)
    met = rest.join(first, ["gram", "salt"]).where((F.col("p") < F.col("x")) & (F.col("cp") != F.col("cx")) & fit)
    return met.select("p", "np", "cp", "x", "nx", "cx").distinct()


def _links(pairs: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs that are linked: partial overlaps per fragment, summed per pair."""
    with_x = pairs.join(_cut(ranked).select(F.col("node").alias("x"), "fragment", F.col("grams").alias("gx")), "x")
    both = with_x.join(_cut(ranked).select(F.col("node").alias("p"), "fragment", F.col("grams").alias("gp")), ["p", "fragment"])
    partial = both.select("p", "np", "cp", "x", "nx", "cx", F.size(F.array_intersect("gx", "gp")).alias("partial"))
    overlap = partial.groupBy("p", "np", "cp", "x", "nx", "cx").agg(F.sum("partial").alias("overlap"))
    return overlap.where(F.col("overlap") * 100 >= (F.col("np") + F.col("nx") - F.col("overlap")) * percent)


def _cut(ranked: DataFrame) -> DataFrame:
    """Rows (node, fragment, grams): each set's part in each fragment of the n-gram order; empty parts are left out."""
    fragment = lambda g: F.shiftrightunsigned(g, 64 - FRAGMENT_BITS)
    parts = F.transform(F.sequence(F.lit(0), F.lit((1 << FRAGMENT_BITS) - 1)), lambda f: F.filter("shared", lambda g: fragment(g) == f))
    return ranked.select("node", F.posexplode(parts).alias("fragment", "grams")).where("size(grams) > 0")


def _hooked(links: DataFrame) -> DataFrame:
    """Rows (comp, hook): the least group that a group is linked with, or the least one that this is linked with."""
    least = links.groupBy(F.greatest("cp", "cx").alias("comp")).agg(F.min(F.least("cp", "cx")).alias("hook"))
    on = least.select(F.col("comp").alias("hook"), F.col("hook").alias("further"))
    return least.join(on, "hook", "left").select("comp", F.coalesce("further", "hook").alias("hook"))


def _open(lists: DataFrame, pivots: float) -> DataFrame:
    """The lists that have more members than there were pivots, and members of more than one group."""
    told = lists.where(F.col("size") > F.lit(pivots)).groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("size").alias("size"))
    left = told.where("lo < hi").withColumn("salt", copies(_ways())).select("gram", "salt")
    return lists.withColumn("salt", dealt("node", _ways())).join(left, ["gram", "salt"]).drop("salt")


def _components(ranked: DataFrame, percent: int) -> DataFrame | None:
    """Rows (node, component) of the nodes that have a link; none if there is no list."""
    lists = saved(_lists(ranked), "jaccard-lists")
    every: list[DataFrame] = []
    done, pivots = 0.0, float(PIVOTS)
    while True:
        left, longest, pairs = lists.agg(F.count(F.lit(1)), F.max("size"), F.sum("size")).first()  # each member meets no more than its list's size
        if not left:
            break
        if pairs <= LAST_PAIRS:
            pivots = math.inf
        sets = sieve(ranked.select("node", "shared"), lists.select("node"), "node")[0]  # of few classes after the first round
        links = saved(_links(_pairs(lists, done, pivots, percent), sets, percent).select("p", "x", "cp", "cx"), "jaccard-links")
        every.append(links.select(F.col("p").alias("u"), F.col("x").alias("v")))
        if longest <= pivots:
            break
        hooks = _hooked(links).withColumn("salt", copies(GROUP_WAYS))
        fresh = lists.withColumn("salt", dealt("node", GROUP_WAYS)).join(hooks, ["comp", "salt"], "left").withColumn("comp", F.coalesce("hook", "comp")).drop("hook", "salt")
        after = saved(_open(fresh, pivots), "jaccard-lists")
        discard(lists)
        lists = after
        done, pivots = pivots, pivots * MORE_PIVOTS
    discard(lists)
    return connected_components(functools.reduce(DataFrame.union, every), "jaccard-components", TOGETHER) if every else None


def _labelled(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, k1, k2, n, cid), and rows (cid, lead) of the classes whose lead may be another row.

    ``lead`` is the least (has no doc_id, doc_id, k1, k2) of the class's component.
    """
    profile = saved(docs.mapInArrow(_profile(width, percent), "doc_id bigint, k1 bigint, k2 bigint, n bigint, cid binary, half bigint, grams array<bigint>"), "jaccard-profile")
    picked = _picked(profile, percent)
    ranked = _ranked(docs, picked, width, percent)
    comps = _components(ranked, percent)
    discard(ranked)
    rows = profile.drop("grams", "half")
    lead = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "k1", "k2")
    classes = rows.where("n > 0").groupBy("cid").agg(F.min(lead).alias("first"), F.count(F.lit(1)).alias("rows"))
    if comps is None:
        return rows, saved(classes.where("rows > 1").withColumnRenamed("first", "lead"), "jaccard-classes")
    linked = picked.join(comps, "node").select("cid", F.col("component").alias("comp"))
    first = classes.join(linked, "cid", "left").where("rows > 1 or comp is not null")
    first = saved(first, "jaccard-classes")
    leads = first.where("comp is not null").groupBy("comp").agg(F.min("first").alias("lead"))
    return rows, first.join(leads, "comp", "left").select("cid", "rows", F.coalesce("lead", "first").alias("lead"))


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Group documents whose n-gram sets have a Jaccard similarity of ``percent`` / 100 or more.

    ``docs`` has integer ``doc_id`` and ``text``; other columns are ignored.
    Returns one row per row of ``docs``: ``doc_id``, ``n_shingles`` (size of
    the set of ``width``-word shingles) and ``component_id`` (the smallest
    doc_id reachable by links, itself included).

    Null and empty texts, and texts of white space, have empty sets, link with
    nothing and keep their own doc_id. A row without doc_id takes part by its
    text; if nothing in its component has one, component_id is null. Repeated
    rows come back as often as they came. An empty table gives an empty result.
    The result is exact up to collisions of the n-grams' 64-bit hashes within a
    pair of documents and of 128-bit digests of whole sets.
    """
    rows, classes = _labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text"), width, percent)
    total = rows.count()
    labelled = spread_join(rows, classes, ["cid"], "k1", "rows", total, "left")
    component = F.when(F.col("lead").isNotNull(), F.col("lead.doc_id")).otherwise(F.col("doc_id"))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_per_group(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Keep of each group of linked documents the one with the smallest doc_id, with the columns of ``docs``.

    A row without doc_id stays if no row of its group has one and its hash is
    the least. Rows that repeat both doc_id and text count as one group's
    copies: one stays. Null and empty texts link with nothing and all stay but
    for such repeats. An empty table gives an empty result. Only rows that may
    have to go are shuffled with their texts.
    """
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text")
    rows, classes = _labelled(keyed.select("doc_id", "k1", "k2", "text"), width, percent)
    total = rows.count()
    labelled = spread_join(rows, classes, ["cid"], "k1", "rows", total, "inner")
    beaten = labelled.where("k1 <> lead.k1 or k2 <> lead.k2").select("k1", "k2", F.lit(True).alias("beaten"))
    repeated = rows.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2", F.lit(False).alias("beaten"))
    marked = saved(beaten.union(repeated).groupBy("k1", "k2").agg(F.max("beaten").alias("beaten")), "jaccard-marked")
    may, clear = sieve(keyed.select("doc", "k1", "k2"), marked)
    rest = may.join(marked, ["k1", "k2"], "left").where("not coalesce(beaten, false)").dropDuplicates(["k1", "k2"])
    return clear.select("doc.*").union(rest.select("doc.*"))
