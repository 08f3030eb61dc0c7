"""Personal entries matched within and across books.

Which pairs of entries match, and by what rule, is told by joins on blocks of
last names and Column expressions; so are links of single entries. Only what
depends on an order runs as a kernel, each on its own small part: clusters
within one block, merges of accepted groups that match one another, and clusters
of near names in the entries that are left, on blocks that matching entries tie
together. Blocks without a matching pair do not get there.
"""

from __future__ import annotations

from collections import defaultdict

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.compat import FIELDS, PREPARED, allowed_distance, clean, cross_eligible, effective_title, first_status, is_multi_initial, match_rule, names_may_match, prepared, rest_not_blocked, rest_says, rule_of_both, rule_of_names, signature, strip_surname_prefix, titles_agree
from rollcall.operators.components import connected_components
from rollcall.operators.fuzzy import fuzzy_self_join
from rollcall.operators.numbering import numbered
from rollcall.sources.shared import saved, together

#: Radius of fuzzy groups, and limits of links that need no review.
RADIUS, SURE_DISTANCE = 3, 2
#: Partitions of joins and kernels whose work goes with pairs rather than with bytes.
TASKS = 64
#: Edges that one task takes at once.
TOGETHER = 1 << 20
#: Pairs of free entries of near names that are made at most; where names and titles allow more, a kernel compares entries.
PAIRED = 1 << 20
#: Calls of the kernel that makes clusters of blocks, each of which takes many blocks.
CALLS = 256
#: Values of a field up to which a kernel remembers which of them agree.
REMEMBERED = 2048
#: Entries of the same names and titles that stand in one array, and what they share and what each has of its own.
PACK = 256
NAMED = ["block", "m_title", "m_kind", "m_plain", "m_first", "m_bare", "m_two", "m_three", "m_raw", "m_last"]
RESTING = ["row_ord", "book", "edition", "m_place", "m_post", "m_trade", "m_body"]
#: What tells which names and titles an entry has; the others of ``NAMED`` follow from these.
TOLD = ["m_title", "m_first", "m_two", "m_three", "m_raw"]
if TYPE_CHECKING:
    import numpy as np
    import pandas as pd

_OUT = "scope int, place long, k1 long, k2 long, k3 long, k4 long, k5 long, seq long, match string, row_ord long, match_rule string, match_tier string"


def _side(prefix: str):
    return lambda name: F.col(f"{prefix}_{name}")


def last_key(df: DataFrame) -> Column:
    return clean(df["parsed_last"])


def name_pairs(entries: DataFrame, stripped: bool = True) -> DataFrame:
    """Pairs (a, b, distance) of different last names within the radius, with or without their prefixes."""
    names = entries.select("last").where("last <> ''").distinct()
    raw = fuzzy_self_join(names, "last", RADIUS)
    if not stripped:
        return raw
    bare = names.select("last", strip_surname_prefix(F.col("last")).alias("bare"))
    equal = bare.groupBy("bare").agg(F.collect_set("last").alias("lasts")).select("bare", "lasts")
    near = fuzzy_self_join(bare, "bare", RADIUS).select(F.col("a").alias("x"), F.col("b").alias("y"), "distance")
    near = near.union(equal.select(F.col("bare").alias("x"), F.col("bare").alias("y"), F.lit(0).alias("distance")))
    left, right = equal.select(F.col("bare").alias("x"), F.explode("lasts").alias("p")), equal.select(F.col("bare").alias("y"), F.explode("lasts").alias("q"))
    other = near.join(left, "x").join(right, "y").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")
    return raw.union(other).groupBy("a", "b").agg(F.min("distance").alias("distance"))


def absorbing_pairs(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of last names of which one, less its prefix, is the other and more words: a place that stands in the name."""
    names = entries.select("last").where("last <> ''").distinct().select("last", strip_surname_prefix(F.col("last")).alias("bare"))
    starts = F.transform(F.filter(F.sequence(F.lit(1), F.length("bare")), lambda k: F.substring(F.col("bare"), k, F.lit(1)) == " "), lambda k: F.substring(F.col("bare"), F.lit(1), k - 1))
    long = names.where(F.col("bare").contains(" ")).select(F.col("last").alias("p"), F.explode(starts).alias("bare"))
    met = long.join(names.withColumnRenamed("last", "q"), "bare").where("p <> q")
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _asked(names: DataFrame) -> DataFrame:
    """Ordered pairs (a_block, to, distance) of last names, less their prefixes, of which entries can match."""
    both = names.select("a", "b").union(names.select(F.col("b").alias("a"), F.col("a").alias("b")))
    bare = both.select("a", "b", strip_surname_prefix(F.col("a")).alias("x"), strip_surname_prefix(F.col("b")).alias("y"))
    bare = bare.withColumn("distance", F.levenshtein("x", "y"))
    absorbs = F.col("x").startswith(F.concat("y", F.lit(" "))) | F.col("y").startswith(F.concat("x", F.lit(" ")))
    able = (F.col("distance") <= allowed_distance(F.col("x"), F.lit("exact"))) | absorbs
    return bare.where(able).select(F.col("a").alias("a_block"), F.col("b").alias("to"), "distance")


def _packs(entries: DataFrame, side: str, of: list[str]) -> DataFrame:
    """Entries of the same names and titles, and the same ``of``, as rows with arrays ``rows`` of ``PACK`` entries at most."""
    key = list(dict.fromkeys([*NAMED, *of]))
    at = entries.select(*key, F.struct(*RESTING).alias("own"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("own.row_ord"))
    at = at.withColumn("pack", F.floor((place - 1) / PACK)).groupBy(*key, "pack").agg(F.collect_list("own").alias("rows"))
    return at.select(*[F.col(c).alias(f"{side}_{c}") for c in [*key, "rows"]])


def matching_pairs(entries: DataFrame, names: DataFrame | None, scope: str, others: DataFrame | None = None, same: bool = True, once: Column | None = None, more: list[str] | None = None) -> DataFrame:
    """Rows (a, b, rule, first): ordered pairs of entries that match, a being the one that asks.

    Candidates share a last name (where ``same``) or have near ones that
    ``names`` has, or have none and the same initials; within the scope of a
    book they share the book as well. They share what ``m_kind`` tells of the
    title, and the first letter of the first name where both have one: these are
    the join's keys. Entries of the same names and titles meet others as one,
    and are told apart only where those can match. ``others`` are the entries
    that may be b, by default the same; ``once`` is a further condition on
    columns of a and b, ``row_ord``, ``block`` and ``more``; of the last the
    rows get a's.
    """
    others, more = entries if others is None else others, more or []
    of = [*(["book"] if scope == "within_book" else []), *more]
    keep = list(dict.fromkeys(["block", *more, "rows"]))
    met, said = _named_pairs(_packs(entries, "a", of), _packs(others, "b", of), names, scope, same, keep)
    met = met.withColumn("x", F.explode("a_rows")).drop("a_rows").withColumn("y", F.explode("b_rows")).drop("b_rows")
    met = met.withColumn("a_row_ord", F.col("x.row_ord")).withColumn("b_row_ord", F.col("y.row_ord"))
    a, b = F.col("x").getField, F.col("y").getField
    met = met.where(F.expr("a_row_ord <> b_row_ord") if once is None else once).where(rest_not_blocked(a, b))
    met = met.select(F.col("a_row_ord").alias("a"), F.col("b_row_ord").alias("b"), "first", *said, *[c.alias(name) for name, c in rest_says(a, b, F.col).items()], *[F.col(f"a_{c}").alias(c) for c in more])
    # Exploded, as the rule would else be told twice, in code that is too long for the JVM to compile.
    met = met.select("a", "b", F.explode(F.array(rule_of_both(F.col))).alias("rule"), "first", *more)
    return met.where("rule is not null")


def _named_pairs(left: DataFrame, right: DataFrame, names: DataFrame | None, scope: str, same: bool, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows of ``left`` and ``right`` (columns ``NAMED`` and ``keep``, after a_ or b_) whose names and titles can match.

    They have ``keep`` of both, ``first`` and what ``rule_of_names`` says, whose names come second.
    """
    within = scope == "within_book"
    asked = []
    if same:
        asked.append(left.withColumn("to", F.col("a_block")).withColumn("distance", F.lit(0)))
    if names is not None:
        asked.append(left.join(_asked(names), "a_block").select(*left.columns, "to", "distance"))
    left = asked[0] if len(asked) == 1 else asked[0].unionByName(asked[1])
    start = lambda s: F.substring(f"{s}_m_first", 1, 1)
    # An entry without a first name meets all, under "*"; others meet those of their letter and those without one.
    left = left.withColumn("letter", F.explode(F.when(F.col("a_m_first") == "", F.array(F.lit("**"))).otherwise(F.array(start("a"), F.lit("")))))
    right = right.withColumn("to", F.col("b_block")).withColumn("letter", F.explode(F.array(start("b"), F.lit("**")))).withColumn("kind", F.col("b_m_kind"))
    left = left.withColumn("kind", F.col("a_m_kind"))
    on = ["to", "kind", "letter"]
    if within:
        left, right, on = left.withColumn("of", F.col("a_book")), right.withColumn("of", F.col("b_book")), [*on, "of"]
    # Rows are few and small against the pairs they make, so tasks are as many as said here, whatever their bytes.
    met = left.repartition(TASKS, *on).join(right.repartition(TASKS, *on), on).where(titles_agree(_side("a"), _side("b")))
    met = met.withColumn("first", first_status(_side("a"), _side("b"))).where("first <> 'conflict'")
    said = rule_of_names(_side("a"), _side("b"), scope, F.col("distance"), F.col("first"))
    met = met.select(*[f"{s}_{c}" for s in "ab" for c in keep], "first", *[c.alias(name) for name, c in said.items()]).where(names_may_match(F.col))
    return met, list(said)


class _Greedy:
    """Star clusters in the order of rows over known pairs, kept apart where names stand side by side in an edition.

    Rows go by their place in the order of ``row_ord``.
    """

    def __init__(self, entries: pd.DataFrame, a: np.ndarray, b: np.ndarray):
        import numpy as np

        rows = entries.sort_values("row_ord")
        self.ids = rows["row_ord"].to_numpy()
        a, b = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)
        order = np.argsort(a, kind="stable")
        self.to, self.first = b[order], np.searchsorted(a[order], np.arange(len(rows) + 1))
        number = lambda columns: rows.groupby(columns, sort=False, dropna=False).ngroup().to_numpy()
        part = ["part"] if "part" in rows.columns else []  # what stands side by side does so within its part
        self.sign, self.kind = number([*part, "sig_title", "sig_first", "sig_last", "sig_post"]), number([*part, "sig_title", "sig_last"])
        self.spot = number(["book", "edition"])
        _, one = np.unique(self.sign, return_index=True)
        self.kind_of = self.kind[one]
        self.given = (rows["sig_first"].to_numpy() != "")[one]
        self.post = number(["sig_post"])[one]
        self.named = (rows["sig_last"].to_numpy() != "")[one]

    def apart(self, members: np.ndarray):
        """A function that gives the signatures that stand beside one in an edition of ``members``, of its title and last name."""
        import numpy as np

        spots = int(self.spot.max(initial=0)) + 1
        sign, spot = np.divmod(np.unique(self.sign[members] * spots + self.spot[members]), spots)
        order = np.argsort(self.kind_of[sign], kind="stable")
        beside = np.stack([self.kind_of[sign], sign, spot])[:, order]
        known: dict[int, tuple] = {}

        def of(sign: int) -> np.ndarray:
            kind = self.kind_of[sign]
            if not self.named[sign]:
                return beside[1, :0]
            if kind not in known:
                lo, hi = np.searchsorted(beside[0], [kind, kind + 1])
                signs, s = np.unique(beside[1, lo:hi], return_inverse=True)
                spots, p = np.unique(beside[2, lo:hi], return_inverse=True)
                at = np.zeros((len(signs), len(spots)), np.float32)
                at[s, p] = 1
                given, post = self.given[signs], self.post[signs]
                known[kind] = signs, (at @ at.T > 0) & ((given[:, None] != given) | (post[:, None] != post))
            signs, differ = known[kind]
            return signs[differ[np.searchsorted(signs, sign)]]

        return of

    def met(self, seed: int, still) -> np.ndarray:
        """Rows that ``seed`` matches, of those that ``still`` says yes to."""
        at = self.to[self.first[seed] : self.first[seed + 1]]
        return at[still(at)]

    def clusters(self, members: np.ndarray):
        """Rows of each cluster of two or more; a row joins the first seed that it matches."""
        import numpy as np

        apart, used = self.apart(members), np.zeros(len(self.ids), bool)
        place = np.full(len(self.ids), -1)
        place[members] = np.arange(len(members))
        for k, seed in enumerate(members.tolist()):
            if used[seed]:
                continue
            met = self.met(seed, lambda at: (place[at] > k) & ~used[at])  # noqa: B023
            if not len(met):
                continue
            met = met[np.argsort(place[met])]
            signs = self.sign[met].tolist()
            against, out = set(apart(self.sign[seed]).tolist()), set()
            for sign in dict.fromkeys(signs):  # in the order of rows
                if sign in against:
                    out.add(sign)
                else:
                    against.update(apart(sign).tolist())
            if out:
                met = met[[sign not in out for sign in signs]]
            if len(met):
                used[seed] = True
                used[met] = True
                yield np.concatenate([[seed], met])


class _Field:
    """How a field's values agree, in a kernel: 0 where one is empty, 1 where two match, 2 where they do not; null matches none."""

    def __init__(self, values: pd.Series, match):
        import pandas as pd

        self.codes, found = pd.factorize(values.to_numpy(object), use_na_sentinel=False)
        self.values, self.match, self.known = [x if isinstance(x, str) else None for x in found], match, {}

    def _state(self, x: str | None, y: str | None) -> int:
        return 0 if x == "" or y == "" else 1 if x is not None and y is not None and self.match(x, y) else 2

    def of(self, row: int, others: np.ndarray) -> np.ndarray:
        import numpy as np

        x, others = int(self.codes[row]), self.codes[others]
        if (said := self.known.get(x)) is None:
            said = np.full(len(self.values), -1, np.int8)
            if len(self.values) <= REMEMBERED:
                self.known[x] = said
        found = said[others]
        if (new := found < 0).any():
            for y in np.unique(others[new]).tolist():
                said[y] = self._state(self.values[x], self.values[y])
            found = said[others]
        return found


class _OneByOne(_Greedy):
    """Clusters of many parts, without a table of pairs: a seed is compared with the rows that are still free.

    ``facts`` has (a, b, need): rows of a's names and titles match those of b's
    where nothing stands against it and the rest agrees for ``need`` at least.
    For each row that ``a`` and ``b`` name the rows of its names and titles are
    meant. What ``rest_not_blocked`` and ``rest_says`` tell of two entries is told
    here field by field; of those of one block without more columns, else with
    ``unlike``, ``x`` and ``y``, which are ``r_unlike`` and ``r_tails``.
    """

    def __init__(self, entries: pd.DataFrame, facts: pd.DataFrame):
        import numpy as np

        super().__init__(entries, np.zeros(0, int), np.zeros(0, int))
        rows = entries.sort_values("row_ord")
        self.told = rows.groupby(["part", *TOLD], sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(self.told, kind="stable")
        self.rows_of = np.split(order, np.cumsum(np.bincount(self.told))[:-1])
        a, b = (self.told[np.searchsorted(self.ids, facts[c].to_numpy())] for c in "ab")
        order = np.argsort(a, kind="stable")
        self.asks, self.whom, self.need = np.searchsorted(a[order], np.arange(len(self.rows_of) + 1)), b[order], facts["need"].to_numpy()[order]
        self.free: dict[int, tuple] = {}
        self.unlike, self.tails = None, ()
        self.placed = np.where((rows["book"].isna() | rows["edition"].isna()).to_numpy(), -1, self.spot)
        equal = lambda x, y: x == y
        within = lambda x, y: x in y or y in x
        shared = lambda x, y: not set(x.split(" ")).isdisjoint(y.split(" "))
        self.f_place, self.f_body, self.f_trade, self.f_post = (_Field(rows[c], f) for c, f in (("m_place", equal), ("m_body", within), ("trade", shared), ("m_post", equal)))
        if "unlike" in facts.columns:
            code = {x: k for k, x in enumerate(self.f_place.values)}
            self.nowhere, self.unsaid = code.get("", -1), code.get(None, -1)
            self.unlike = facts["unlike"].to_numpy(bool)[order]
            self.tails = tuple(np.array([code.get(x, -2) if x else -2 for x in facts[c]], int)[order] for c in "xy")

    def clusters(self, members: np.ndarray):
        self.free = {}
        return super().clusters(members)

    def met(self, seed: int, still) -> np.ndarray:
        import numpy as np

        told = self.told[seed]
        if told not in self.free:
            lo, hi = self.asks[told], self.asks[told + 1]
            parts = [self.rows_of[x] for x in self.whom[lo:hi].tolist()]
            at = np.concatenate(parts) if parts else np.zeros(0, int)
            order = np.argsort(at, kind="stable")
            self.free[told] = at[order], np.repeat(np.arange(lo, hi), [len(x) for x in parts])[order]
        at, fact = self.free[told]
        keep = still(at)
        at, fact = self.free[told] = at[keep], fact[keep]  # what is used, or comes before a seed, never comes back
        if not len(at):
            return at
        open_ = (self.placed[at] != self.placed[seed]) | (self.placed[seed] < 0)
        signals = np.zeros(len(at))
        for field in (self.f_place, self.f_body, self.f_trade):
            said = field.of(seed, at)
            open_ &= said != 2
            signals += said == 1
        signals += 0.5 * (self.f_post.of(seed, at) == 1)
        enough = signals >= self.need[fact]
        if self.unlike is not None:
            here, there = self.f_place.codes[seed], self.f_place.codes[at]
            enough |= ((self.tails[0][fact] == there) & (here == self.nowhere)) | ((self.tails[1][fact] == here) & (there == self.nowhere))
            open_ &= ~(self.unlike[fact] & ((here == self.unsaid) | (there == self.unsaid)))
        return at[open_ & enough]


def _numbers(pairs: pd.DataFrame) -> tuple:
    return pairs["a"].to_numpy("int64"), pairs["b"].to_numpy("int64")


def with_rule(found: DataFrame, entries: DataFrame, scope: str) -> DataFrame:
    """Clusters with ``rule`` instead of ``mate``: that of their seed and the first row that joined it."""
    keep = ["book", "edition", *PREPARED]
    a, b = (entries.select(F.col("row_ord").alias(on), *[F.col(c).alias(f"{s}_{c}") for c in keep]) for s, on in (("a", "seed"), ("b", "mate")))
    rule = match_rule(_side("a"), _side("b"), scope)
    heads = found.where("seq = 0").select("seed", "mate", *(["first_row"] if "first_row" in found.columns else [])).join(a, "seed").join(b, "mate")
    on = [c for c in ("seed", "first_row") if c in found.columns]
    return found.drop("mate").join(heads.select(*on, rule.alias("rule")), on)


def exact_clusters(entries: DataFrame, keys: list[str], scope: str = "within_book") -> DataFrame:
    """K1, K6, K8: star clusters of the rows of each block, as rows (keys, block, seed, seq, row_ord, rule).

    Which names and titles can match is told by a join of these; only blocks in
    which some can are looked at. There each seed is compared with the later rows
    that are still free, so no pair is made of rows that an earlier seed has taken.
    """
    by = [*keys, "block"]
    at = entries.withColumn("part", F.xxhash64(*by))  # two blocks in one part do no harm: no pair is of both
    names = at.groupBy("part", *(["book"] if scope == "within_book" else []), *NAMED).agg(F.min("row_ord").alias("head"), F.count(F.lit(1)).alias("own"))
    names = saved(names, "match-named")
    sides = [names.select(*[F.col(c).alias(f"{s}_{c}") for c in names.columns]) for s in "ab"]
    same, _ = _named_pairs(*sides, None, scope, True, ["part", "head", "own"])
    same = same.where("a_head <> b_head or a_own > 1")
    # Last names are the same here, so none stands in another with a place, and what is exact needs nothing more.
    always = F.col("r_whole").isNotNull() | (F.col("r_named") & F.col("r_exact").isNotNull())
    same = same.where(always | (F.col("r_named") & F.col("r_near")))
    same = saved(same.select(F.col("a_part").alias("part"), F.col("a_head").alias("a"), F.col("b_head").alias("b"), F.when(always, 0.0).otherwise(1 - F.col("r_signals")).alias("need")), "match-same")
    some = at.select("part", "row_ord", "book", "edition", "sig_title", "sig_first", "sig_last", "sig_post", *TOLD, "m_place", "m_post", F.array_join("m_trade", " ").alias("trade"), "m_body")
    some = some.join(same.select("part").distinct(), "part", "left_semi")
    columns = ["seed", "seq", "row_ord", "mate"]
    some, same = (x.withColumn("call", F.pmod("part", F.lit(CALLS))).repartition(TASKS, "call").groupBy("call") for x in (some, same))

    def run(key, rows: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pool = _OneByOne(rows, facts)
        return _table(columns, (((), pool.ids[c]) for c in pool.clusters(np.arange(len(pool.ids)))))

    found = some.cogroup(same).applyInPandas(run, "seed long, seq long, row_ord long, mate long")
    found = with_rule(saved(found, "match-stars"), entries, scope)
    return found.join(entries.select(F.col("row_ord").alias("seed"), *by), "seed").select(*by, "seed", "seq", "row_ord", "rule")


def _table(columns: list[str], clusters) -> pd.DataFrame:
    """Rows (key, seed, seq, row, mate) of clusters, each with the columns that it has in common before them."""
    import numpy as np
    import pandas as pd  # on executors only; a driver without it is smaller

    found = list(clusters)
    if not found:
        return pd.DataFrame([], columns=columns)
    sizes = [len(c) for _, c in found]
    heads = list(zip(*[key for key, _ in found], strict=True))
    parts = [np.repeat(np.array(h, dtype=object if isinstance(h[0], str) else "int64"), sizes) for h in heads]
    seeds, mates = (np.repeat(np.array([c[k] for _, c in found]), sizes) for k in (0, 1))
    rows = [*parts, seeds, np.concatenate([np.arange(n) for n in sizes]), np.concatenate([c for _, c in found]), mates]
    return pd.DataFrame(dict(zip(columns, rows, strict=True)), columns=columns)


def _renamed(rule: Column, distance: Column) -> Column:
    return F.concat(F.lit("fuzzy_last_"), distance.cast("string"), F.lit("+"), F.regexp_replace(rule, r"^[^+]*\+", ""))


def _sure(distance: Column, first: Column) -> Column:
    return (distance <= SURE_DISTANCE) & (first == "exact")


def _both_ways(names: DataFrame) -> DataFrame:
    return names.select("a", "b", "distance").union(names.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))


def single_links(entries: DataFrame, clustered: DataFrame, seeds: DataFrame, names: DataFrame) -> DataFrame:
    """For each entry without a cluster the first accepted group of a near last name whose seed it matches.

    Rows (row_ord, seed, rule, sure): groups stand in the order of their blocks'
    first rows and of their seeds.
    """
    single = entries.where("not initials").join(clustered.select("row_ord"), "row_ord", "left_anti")
    to = entries.join(seeds.select(F.col("seed").alias("row_ord")), "row_ord", "left_semi")
    pairs = matching_pairs(single, names, "within_book", to, same=False, more=["block"])
    at = seeds.select(F.col("seed").alias("b"), F.col("block").alias("to"), "first_row")
    near = _both_ways(names).select(F.col("a").alias("block"), F.col("b").alias("to"), "distance")
    met = pairs.join(at, "b").join(near, ["block", "to"])
    best = met.groupBy("a").agg(F.min_by(F.struct("b", "rule", "first", "distance"), F.struct("first_row", "b")).alias("x"))
    return best.select(F.col("a").alias("row_ord"), F.col("x.b").alias("seed"), _renamed(F.col("x.rule"), F.col("x.distance")).alias("rule"), _sure(F.col("x.distance"), F.col("x.first")).alias("sure"))


def _merge(seeds: pd.DataFrame, facts: pd.DataFrame) -> list[tuple]:
    """Groups of near last names united in order; (seed, other, rule) with its root, or with a group that it may belong to."""
    rows = {r.seed: r for r in seeds.sort_values(["first_row", "seed"]).itertuples()}
    leads = defaultdict(list)
    for seed, r in rows.items():
        leads[r.block].append(seed)
    told = facts[facts.kind == 1]
    distance = {(x, y): d for x, y, d in zip(told.x, told.y, told.distance, strict=True)}
    said = facts[facts.kind == 0]
    rules: dict[tuple, dict] = defaultdict(dict)
    for a, b, rule, first in zip(said.a, said.b, said.rule, said["first"], strict=True):
        rules[a, rows[b].block][b] = rule, first
    place = {seed: k for left in leads.values() for k, seed in enumerate(left)}
    into: dict[int, int] = {}
    under = defaultdict(set)
    sizes = {seed: r.members for seed, r in rows.items()}
    roots = {name: list(left) for name, left in leads.items()}  # of the seeds of each block, kept up to date
    known = {name: frozenset(left) for name, left in leads.items()}
    out, tested = [], defaultdict(dict)  # what a root was tested against, as sets that rows of one block share

    def root(seed: int) -> int:
        while seed in into:
            seed = into[seed]
        return seed

    def unite(gone: int, keep: int) -> None:
        under[into.get(gone)].discard(gone)
        into[gone] = keep
        under[keep].add(gone)
        to, left, sizes[keep] = root(keep), [gone], sizes[keep] + sizes[gone]
        while left:
            seed = left.pop()
            name = rows[seed].block
            roots[name][place[seed]] = to
            known.pop(name, None)
            left.extend(under[seed])

    def was_tested(x: int, y: int) -> bool:
        return any(y in some for some in tested[x].values()) or any(x in some for some in tested[y].values())

    for x, left in leads.items():
        for y, right in leads.items():
            d = distance.get((x, y)) if x < y else None
            if d is None:
                continue
            for a in left:
                ra = root(a)  # looked up once for each left group, as the rule has it
                met, done = rules.get((a, y)), 0
                if not met:
                    some = known.setdefault(y, None) or frozenset(roots[y])
                    known[y] = tested[ra][id(some)] = some
                    continue
                seen: set[int] = set()
                for b in sorted(met, key=place.__getitem__):
                    seen.update(roots[y][done : place[b]])
                    done, rb = place[b], roots[y][place[b]]
                    if ra == rb or rb in seen or was_tested(ra, rb):
                        continue
                    seen.add(rb)
                    rule, first = met[b]
                    if d <= SURE_DISTANCE and first == "exact":
                        keep, gone = (ra, rb) if sizes[ra] >= sizes[rb] else (rb, ra)
                        unite(gone, keep)
                        done += 1
                    else:
                        out.append((a, b, f"fuzzy_last_{d}+" + rule.split("+", 1)[-1]))
                seen.update(roots[y][done:])
                tested[ra][id(seen)] = seen
    return out + [(seed, root(seed), "") for seed in rows]


def _merging(seeds: DataFrame, entries: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of ``seeds`` (book_ord, seed, block) that match, and the components of these."""
    side = lambda s: seeds.select(F.col("seed").alias(s), F.col("block").alias("x" if s == "a" else "y"), *(["book_ord"] if s == "a" else []))
    heads = entries.join(seeds.select(F.col("seed").alias("row_ord")), "row_ord", "left_semi")
    pairs = matching_pairs(heads, names, "within_book", same=False, once=F.expr("a_block < b_block"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").where("x < y").join(names.select(F.col("a").alias("x"), F.col("b").alias("y"), "distance"), ["x", "y"])
    found = saved(found.select("book_ord", "a", "b", "x", "y", "rule", "first", "distance"), "match-merges")
    return found, connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), "match-merge-parts", TOGETHER)


def merged_groups(seeds: DataFrame, found: DataFrame, parts: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (seed, other, rule): the root of each seed that has another one, with an empty rule, and doubtful pairs of seeds.

    ``seeds`` has (book_ord, seed, block, first_row, members), the next two are
    those of ``_merging``. Seeds that match others hang together in small parts,
    a few of which are a task's work.
    """
    # Parts of a book share tasks, as a call of the kernel costs more than most of them; none bears on another.
    parts = parts.select(F.col("node").alias("seed"), F.pmod(F.xxhash64("component"), F.lit(TASKS)).alias("part"))
    at = saved(seeds.join(parts, "seed").withColumn("part", F.xxhash64("book_ord", "part")), "match-merge-seeds")
    blocks = at.select("part", "block").distinct()
    near = blocks.withColumnRenamed("block", "x").join(names.select(F.col("a").alias("x"), F.col("b").alias("y"), "distance"), "x").join(blocks.withColumnRenamed("block", "y"), ["part", "y"])
    none = F.lit(None)
    facts = found.join(at.select(F.col("seed").alias("a"), "part"), "a").select("part", F.lit(0).alias("kind"), "a", "b", "rule", "first", "x", "y", "distance")
    facts = facts.union(near.select("part", F.lit(1).alias("kind"), none.cast("long").alias("a"), none.cast("long").alias("b"), F.lit("").alias("rule"), F.lit("").alias("first"), "x", "y", "distance"))
    facts = saved(facts, "match-merge-facts")

    def run(key, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        return pd.DataFrame(_merge(rows, told), columns=["seed", "other", "rule"])

    out = at.repartition(TASKS, "part").groupBy("part").cogroup(facts.repartition(TASKS, "part").groupBy("part")).applyInPandas(run, "seed long, other long, rule string")
    return saved(out.where("rule <> '' or seed <> other"), "match-merged")


def _star_groups(blocks: dict[str, int], near: dict[str, set[str]]):
    """K3: each last name with the later ones that are near; names stand in the order of their first rows."""
    names = sorted(blocks, key=blocks.__getitem__)
    place = {name: k for k, name in enumerate(names)}
    for name in names:
        later = sorted((x for x in near.get(name, ()) if x in place and place[x] > place[name]), key=place.__getitem__)
        if later:
            yield name, (name, *later)


def _names_ahead(free: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (a, b, need, unlike, x, y, pairs): names and titles of free entries that can match, as ``_OneByOne`` has it.

    Each is named by its first entry; b's block is a's or comes after it. ``pairs`` is how many entries meet.
    """
    scope = "within_book" if keys else "cross_book"
    names = free.groupBy(*keys, *(["book"] if keys else []), "first_row", *NAMED).agg(F.min("row_ord").alias("head"), F.count(F.lit(1)).alias("own"))
    names = saved(names, "match-free-named")
    sides = [names.select(*[F.col(c).alias(f"{s}_{c}") for c in names.columns]) for s in "ab"]
    met, _ = _named_pairs(*sides, near, scope, True, ["first_row", "head", "own"])
    met = met.where("a_first_row <= b_first_row and (a_head <> b_head or a_own > 1)")
    always = F.col("r_whole").isNotNull() | (F.col("r_named") & F.col("r_zero") & F.col("r_exact").isNotNull())
    need = F.when(always, 0.0).when(F.col("r_named") & F.col("r_near"), 1 - F.col("r_signals")).otherwise(float("inf"))
    tails = [F.when(F.col("r_named") & F.col("r_unlike"), F.col("r_tails")[k]).otherwise("").alias(c) for k, c in enumerate("xy")]
    met = met.select(F.col("a_head").alias("a"), F.col("b_head").alias("b"), need.alias("need"), F.col("r_unlike").alias("unlike"), *tails, (F.col("a_own") * F.col("b_own")).alias("pairs"))
    return saved(met, "match-free-names")


def fuzzy_clusters(entries: DataFrame, near: DataFrame, keys: list[str], books: int) -> DataFrame:
    """K7, K9: clusters of free entries of near last names, as rows (keys, first_row, seed, seq, row_ord, rule).

    ``entries`` has all entries with ``free``; a cluster has two last names and
    ``books`` books or more. A cluster's entries are free no more, but for those
    that are ``matched``, which is why names are taken in order. Where entries
    would make more than ``PAIRED`` pairs, which grow with the square of a block,
    the kernel gets the pairs of their names and titles and tells entries apart.
    """
    free = entries.where("free")
    scope = "within_book" if keys else "cross_book"
    some = _names_ahead(free, near, keys)
    paired = (some.agg(F.sum("pairs")).first()[0] or 0) <= PAIRED
    slim = ["row_ord", "book", "edition", "block", "first_row", "free", "matched", "sig_title", "sig_first", "sig_last", "sig_post"]
    if paired:
        # Rows go by the order of their blocks' first rows, then by their own, and a seed takes only what is behind it.
        later = F.expr("a_first_row <= b_first_row and (a_first_row < b_first_row or a_row_ord < b_row_ord)")
        some = saved(matching_pairs(free, near, scope, once=later, more=["first_row"]).select("a", "b"), "match-free")
    own = [] if paired else [*TOLD, "m_place", "m_post", F.array_join("m_trade", " ").alias("trade"), "m_body"]
    # No title of one kind matches one of another.
    grouped = _with_group(entries.select(*keys, "m_kind", *slim, *own), some, near, [*keys, "m_kind"])
    grouped = saved(grouped.where("free").drop("m_kind", "free"), "match-grouped")
    told = [F.lit(0.0).alias("need"), F.lit(False).alias("unlike"), F.lit("").alias("x"), F.lit("").alias("y")] if paired else ["need", "unlike", "x", "y"]
    rest = [F.lit(0.0).alias("need"), F.lit(False).alias("unlike")]
    by = [*keys, "group"]
    mine = saved(grouped.select(*by, "block").distinct(), "match-heads")
    both = mine.join(near.select(F.col("a").alias("block"), F.col("b").alias("y")).union(near.select(F.col("b").alias("block"), F.col("a").alias("y"))), "block")
    # A name that is near to two of these stands in the order of names though it has no entries of this kind of title.
    heads = mine.union(both.groupBy(*by, F.col("y").alias("block")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by, "block")).distinct()
    heads = heads.join(entries.groupBy(*keys, "block").agg(F.min("first_row").alias("first_row")), [*keys, "block"])
    facts = some.join(grouped.select(F.col("row_ord").alias("a"), *by), "a").select(*by, F.lit(0).alias("kind"), "a", "b", *told)
    names = both.select(*by, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), *rest, F.col("block").alias("x"), "y")
    first = heads.select(*by, F.lit(2).alias("kind"), F.col("first_row").alias("a"), F.lit(0).cast("long").alias("b"), *rest, F.col("block").alias("x"), F.lit("").alias("y"))
    facts = saved(facts.union(names).union(first), "match-facts")
    columns = [*keys, "first_row", "seed", "seq", "row_ord", "mate"]

    def run(key, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        some = told[told.kind == 0]
        pool = _Greedy(rows, *_numbers(some)) if paired else _OneByOne(rows.assign(part=0), some)
        rows = rows.sort_values("row_ord")
        heads = told[told.kind == 2]
        blocks = dict(zip(heads.x, heads.a, strict=True))
        close = defaultdict(set)
        for x, y in zip(told[told.kind == 1].x, told[told.kind == 1].y, strict=True):
            close[x].add(y)
            close[y].add(x)
        block, book = (rows.groupby(c, sort=False, dropna=False).ngroup().to_numpy() for c in ("block", "book"))
        matched, taken, none = rows["matched"].to_numpy(bool), np.zeros(len(rows), bool), np.zeros(0, int)
        of_block = {name: np.sort(at) for name, at in rows.reset_index(drop=True).groupby("block").indices.items()}
        spread = lambda at, field: len(set(field[at].tolist()))

        def found():
            for name, names in _star_groups(blocks, close):
                left = np.concatenate([of_block.get(x, none) for x in names])
                left = left[~taken[left]]
                if spread(left, book) < books:
                    continue
                for cluster in pool.clusters(left):
                    if spread(cluster, block) > 1 and spread(cluster, book) >= books:
                        yield (*key[:-1], blocks[name]), pool.ids[cluster]
                        taken[cluster[~matched[cluster]]] = True

        return _table(columns, found())

    schema = ", ".join(f"{k} long" for k in keys) + ", " * bool(keys) + "first_row long, seed long, seq long, row_ord long, mate long"
    out = grouped.repartition(TASKS, *by).groupBy(*by).cogroup(facts.repartition(TASKS, *by).groupBy(*by)).applyInPandas(run, schema)
    return with_rule(saved(out, "match-near-stars"), entries, scope)


def _with_group(entries: DataFrame, pairs: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """``entries`` of blocks that have a matching pair, plus ``group``: blocks that the kernel has to see together.

    These are blocks with entries that match one another, and the names that are
    near to both, as those are where such entries meet. The names that are near
    one another do not matter as such: in a long list of surnames nearly all of
    them hang together.
    """
    place = entries.select("row_ord", "block", *keys)
    one = place.select(F.col("row_ord").alias("a"), F.col("block").alias("x"), *keys)
    other = place.select(F.col("row_ord").alias("b"), F.col("block").alias("y"))
    met = saved(pairs.select("a", "b").join(one, "a").join(other, "b").select(*keys, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "match-blocks")
    both = near.select("a", "b").union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hubs = met.where("x <> y").join(both.select(F.col("a").alias("x"), F.col("b").alias("z")), "x").join(both.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
    node = lambda c: F.struct(*[F.col(k) for k in keys], F.col(c).alias("block"))
    edges = met.select(node("x").alias("u"), node("y").alias("v")).union(hubs.select(node("x").alias("u"), node("z").alias("v"))).union(hubs.select(node("y").alias("u"), node("z").alias("v")))
    found = connected_components(edges, "match-groups", TOGETHER)
    at = entries.withColumn("node", node("block"))
    at = at.join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    known = met.select(node("x").alias("group")).union(met.select(node("y").alias("group"))).union(found.select(F.col("component").alias("group"))).distinct()
    return at.join(known, "group", "left_semi").drop("node", "component").withColumn("group", F.xxhash64("group"))


def eligible_entries(parsed: DataFrame, title_ids: DataFrame) -> DataFrame:
    """Personal entries that no title group has, with the keys of their blocks."""
    # Small files are read by one task; what is prepared of each entry is worth more of them.
    parsed = parsed.repartition(TASKS, "row_ord")
    at = parsed.join(title_ids.select("entry_id").distinct(), "entry_id", "left_anti").where(~F.col("name_type").isin("titled", "anonymous"))
    e = at.__getitem__
    sign = signature(e)
    last, first = clean(e("parsed_last")), F.lower(F.trim(e("parsed_first")))
    lone = (last == "") & is_multi_initial(F.trim(e("parsed_first")), 2)
    at = at.withColumn("last", last).withColumn("initials", lone)
    at = at.withColumn("block", F.when(F.col("last") != "", F.col("last")).when(lone, F.concat(F.lit("\u0001"), first)))
    for part in ("title", "first", "last", "post"):
        at = at.withColumn(f"sig_{part}", sign[part])
    at = at.withColumns(prepared(e))
    first = at.groupBy(F.col("book").alias("of")).agg(F.min("row_ord").alias("book_ord"))
    return at.join(first, at["book"].eqNullSafe(first["of"])).drop("of")


def _rows(df: DataFrame, scope: int, place, keys: list, seq, match: str, rule, tier) -> DataFrame:
    """Rows of the result; ``keys`` tell groups apart and in which order they are numbered."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    keys = [as_column(k).cast("long").alias(f"k{n}") for n, k in enumerate([*keys, 0, 0, 0, 0][:5], 1)]
    return df.select(F.lit(scope).alias("scope"), as_column(place).cast("long").alias("place"), *keys, as_column(seq).cast("long").alias("seq"), F.lit(match).alias("match"), "row_ord", as_column(rule).alias("match_rule"), as_column(tier).alias("match_tier"))


def _exact_within(entries: DataFrame) -> DataFrame:
    """Exact blocks of each book (K6)."""
    c = F.col
    heads = entries.select("row_ord", "initials", "first_row")
    exact = exact_clusters(entries, ["book_ord"]).join(heads, "row_ord")
    rule = c("rule")
    unsure = rule.contains("fuzzy_first") & ~(rule.contains("+title") | rule.contains("+loc") | rule.contains("+post"))
    return saved(exact.withColumn("phase", F.when(c("initials"), 1).otherwise(2)).withColumn("unsure", unsure), "match-exact")


def _within(entries: DataFrame, exact: DataFrame, names: DataFrame) -> DataFrame:
    """Phases within a book after its exact blocks: links of single entries, merges, clusters of near names (K5, K4, K7)."""
    c = F.col
    groups = exact.where("not unsure")
    seeds = groups.where("seq = 0 and not initials").select("book_ord", "seed", "block", "first_row")
    links, (found, parts) = together(entries.sparkSession, lambda: saved(single_links(entries, exact, seeds, names), "match-links"), lambda: _merging(seeds, entries, names))
    sizes = groups.groupBy("seed").agg(F.count(F.lit(1)).alias("own")).join(links.where("sure").groupBy("seed").agg(F.count(F.lit(1)).alias("more")), "seed", "left")
    seeds = seeds.join(sizes.select("seed", (c("own") + F.coalesce("more", F.lit(0))).alias("members")), "seed")
    merged = merged_groups(seeds, found, parts, names)
    roots = merged.where("rule = ''").select("seed", c("other").alias("root"))
    leads = groups.where("seq = 0").select("seed", "phase", "first_row", "book_ord", "rule")
    at = leads.join(roots, "seed", "left").withColumn("root", F.coalesce("root", "seed"))
    home = leads.select(c("seed").alias("root"), c("phase").alias("to_phase"), c("first_row").alias("to_first"))
    at = saved(at.join(home, "root"), "match-roots")  # a row for each accepted group, with the group that it went into

    key = [c("to_phase"), c("to_first"), c("root"), c("first_row"), c("seed")]
    said = lambda rule: F.concat(rule, F.when(c("root") != c("seed"), "+cluster_merge").otherwise(""))
    own = groups.select("seed", "row_ord", "seq").join(at, "seed")
    sure = links.where("sure").select("seed", "row_ord", c("rule").alias("own_rule")).join(at, "seed")
    doubt = links.where("not sure").select("seed", "row_ord", c("rule").alias("own_rule")).join(at, "seed")
    pair = merged.where("rule <> ''")
    ends = [leads.select(c("seed").alias(s), c("first_row").alias(f"first_{s}"), "book_ord") for s in ("seed", "other")]
    pair = pair.join(ends[0], "seed").join(ends[1].drop("book_ord"), "other")
    pair = pair.select("book_ord", "rule", "first_seed", "first_other", "seed", "other", F.posexplode(F.array("seed", "other")).alias("seq", "row_ord"))
    accepted = _rows(own, 0, c("book_ord"), key, c("seq"), "y", said(c("rule")), "auto_within").union(_rows(sure, 0, c("book_ord"), key, 1 << 40, "y", said(c("own_rule")), "auto_within_linkage"))
    # A group that went into another stands behind it, and a linked entry behind those of its group.
    order = ["scope", "place", "k1", "k2", "k3"]
    accepted = accepted.withColumn("seq", F.row_number().over(Window.partitionBy(*order).orderBy("k4", "k5", "seq", "row_ord")).cast("long")).withColumns({k: F.lit(0).cast("long") for k in ("k4", "k5")})
    waiting = _rows(exact.where("unsure"), 0, c("book_ord"), [c("phase"), c("first_row"), c("seed")], c("seq"), "", c("rule"), "candidate_within")
    waiting = waiting.union(_rows(doubt, 0, c("book_ord"), [c("phase"), c("first_row"), c("seed")], (1 << 41) + c("row_ord"), "", c("own_rule"), "candidate_within_linkage"))
    waiting = waiting.union(_rows(pair, 0, c("book_ord"), [F.lit(5), c("first_seed"), c("first_other"), c("seed"), c("other")], c("seq"), "", c("rule"), "candidate_cluster_merge"))
    settled = saved(accepted.union(waiting), "match-settled")
    free = entries.where("not initials").join(settled.select("row_ord", F.lit(True).alias("taken")).distinct(), "row_ord", "left")
    free = free.withColumn("free", c("taken").isNull()).withColumn("matched", F.lit(False)).drop("taken")
    fuzzy = fuzzy_clusters(free, names.where("near"), ["book_ord"], 1)
    return settled.union(_rows(fuzzy, 0, c("book_ord"), [F.lit(6), c("first_row"), c("seed")], c("seq"), "", c("rule"), "candidate_within"))


def _across(entries: DataFrame, near: DataFrame) -> DataFrame:
    """Phases across books: exact last names, then near ones (K8, K9)."""
    c = F.col
    heads = entries.select("row_ord", "first_row", "book", "matched")
    exact = exact_clusters(entries, [], "cross_book").join(heads, "row_ord")
    many = exact.groupBy("seed").agg(F.count_distinct("book").alias("books")).where("books > 1").select("seed")
    exact = saved(exact.join(many, "seed"), "match-cross-exact")
    tier = F.when(c("matched"), "anchor_cross").otherwise("candidate_cross")
    taken = exact.where("not matched").select("row_ord", F.lit(True).alias("taken"))
    free = entries.join(taken, "row_ord", "left").withColumn("free", c("taken").isNull()).drop("taken")
    fuzzy = fuzzy_clusters(free, near, [], 2).join(heads.select("row_ord", "matched"), "row_ord")
    out = _rows(exact, 1, 0, [F.lit(7), c("first_row"), c("seed")], c("seq"), "", c("rule"), tier)
    return out.union(_rows(fuzzy, 1, 0, [F.lit(8), c("first_row"), c("seed")], c("seq"), "", c("rule"), tier))


def _able(entries: DataFrame, within: DataFrame, relaxed: bool) -> DataFrame:
    """Entries that may match across books: all with enough said of them that do not wait for review, with ``matched``."""
    doubtful = within.where("match = ''").select("row_ord").distinct()
    sure = within.where("match = 'y'").select("row_ord").distinct().withColumn("matched", F.lit(True))
    able = entries.where(cross_eligible(entries.__getitem__, relaxed) & (F.col("last") != "")).join(doubtful, "row_ord", "left_anti")
    able = able.withColumn("first_row", F.min("row_ord").over(Window.partitionBy("block")))
    return saved(able.join(sure, "row_ord", "left").withColumn("matched", F.coalesce("matched", F.lit(False))), "match-able")


def match_components(parsed: DataFrame, title_ids: DataFrame, relaxed: bool = True, across: bool = True) -> DataFrame:
    """All component matches: rows (group_id, match, row_ord, entry_id, match_rule, match_tier), accepted where match is y.

    Without ``across`` the groups within books only, which have the same numbers
    either way, as they come first.
    """
    need = ["entry_id", "row_ord", "book", "edition", "name_type", *FIELDS]
    entries = eligible_entries(parsed.select(*need), title_ids).where("block is not null")
    entries = saved(entries.withColumn("first_row", F.min("row_ord").over(Window.partitionBy("book", "block"))), "match-entries")
    slim = ["row_ord", "book", "edition", "block", "initials", "sig_title", "sig_first", "sig_last", "sig_post", "book_ord", "first_row", *PREPARED]
    few = entries.select(*slim)

    def near_names() -> DataFrame:
        raw = name_pairs(entries, stripped=False).select("a", "b", F.lit(True).alias("near"))
        return saved(name_pairs(entries).join(raw, ["a", "b"], "left").withColumn("near", F.coalesce("near", F.lit(False))), "match-names")

    names, exact = together(entries.sparkSession, near_names, lambda: _exact_within(few))
    within = saved(_within(few, exact, names), "match-within")

    every = saved(within.union(_across(_able(entries, within, relaxed).select(*slim, "matched"), names.where("near"))), "match-rows") if across else within
    keys = ["scope", "place", "k1", "k2", "k3", "k4", "k5"]
    numbers = numbered(every.select(*keys).distinct(), keys, "n", "match-numbers")
    out = every.join(numbers, keys).join(entries.select("row_ord", "entry_id"), "row_ord")
    return out.select(F.format_string("cm_%04d", "n").alias("group_id"), "match", "row_ord", "entry_id", "match_rule", "match_tier", "seq")


def coexistence_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of signatures of one title and last name that stand in one edition and differ in kind."""
    e = entries.__getitem__
    at = entries.select("book", "edition", "row_ord", signature(e).alias("s")).where("s.last <> ''")
    key = ["book", "edition", F.col("s.title").alias("title"), F.col("s.last").alias("last")]
    a, b = at.select(*key, F.col("s").alias("sa")).distinct(), at.select(*key, F.col("s").alias("sb")).distinct()
    met = a.join(b, ["book", "edition", "title", "last"]).where(F.struct("sa.first", "sa.post") < F.struct("sb.first", "sb.post"))
    differ = ((F.col("sa.first") == "") != (F.col("sb.first") == "")) | (F.col("sa.post") != F.col("sb.post"))
    return met.where(differ).select("title", "last", F.col("sa.first").alias("first_a"), F.col("sa.post").alias("post_a"), F.col("sb.first").alias("first_b"), F.col("sb.post").alias("post_b")).distinct()


def title_of(df: DataFrame) -> Column:
    return effective_title(df["parsed_title"], df["parsed_postnominals"])
