"""Pairs and clusters of long lists: what meets, and that nothing is lost by it."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.functions import compat
from rollcall.operators import clusters

FIELDS = ["book", "edition", *compat.FIELDS]


def some_rows(seed, n):
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    lasts = "Ash|Ashe|Asher|de la Ash|Ash Leeds|Bell|Bells|Bell Hull|Haworth|Howarth|la Bell|".split("|")
    return [
        (i, f"e{i}", "personal", pick("B", "C"), pick("1", "2", "3"), pick("Mr.", "Rev. Mr.", "Rev.", "Mr. Mr.", "", "Esq.", "Dr."), pick("John", "Jon", "J.", "", "Mary", "R. L.", "R. L. S"), pick(*lasts),
         pick("", "Esq.", "Jun."), pick("", "printer and bookseller", "Printer", "attorney at law"), pick("", "Trinity Coll", "Trinity College", "T.C.D"), pick("", "", "Leeds", "Hull"))
        for i in range(n)
    ]


def entries_of(spark, rows):
    schema = "row_ord long, entry_id string, name_type string, " + ", ".join(f"{f} string" for f in FIELDS)
    return clusters.eligible_entries(spark.createDataFrame(rows, schema), spark.createDataFrame([], "entry_id string")).where("block is not null")


def by_every_pair(at, scope):
    """Pairs that match, from a join that lets every entry meet every other."""
    keep = ["row_ord", "block", *FIELDS]
    a, b = (at.select(*[F.col(c).alias(f"{s}_{c}") for c in keep]) for s in "ab")
    rule = compat.entries_match(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), scope)
    met = a.join(b, F.expr("a_row_ord <> b_row_ord" + (" and a_book = b_book" if scope == "within_book" else "")))
    return {tuple(r) for r in met.select("a_row_ord", "b_row_ord", rule.alias("rule")).where("rule is not null").collect()}


@pytest.mark.parametrize("scope", ["within_book", "cross_book"])
def test_pairs_lose_no_match(spark, scope):
    """Entries meet by title and first letter as well as by name, not all those of like names, and every match is found."""
    at = entries_of(spark, some_rows(4, 200)).localCheckpoint()
    near = clusters.name_pairs(at).select("a", "b").union(clusters.absorbing_pairs(at)).distinct()
    found = clusters.matching_pairs(at, near, scope)
    keys = found._jdf.queryExecution().optimizedPlan().toString()
    assert "kind#" in keys and "letter#" in keys
    got = {(r.a, r.b, r.rule) for r in found.collect()}
    assert got == by_every_pair(at, scope) and len(got) > 100


def plain_stars(rows, rules, apart):
    """K1 by one pass for each seed over all later rows."""
    used, out = set(), []
    for k, seed in enumerate(rows):
        if seed in used:
            continue
        cluster = [seed]
        for row in rows[k + 1 :]:
            if row not in used and (seed, row) in rules and not any((x, row) in apart for x in cluster):
                cluster.append(row)
        if len(cluster) > 1:
            used.update(cluster)
            out.append((seed, rules[seed, cluster[1]], cluster))
    return out


def test_clusters_need_no_table_of_pairs(spark):
    """Exact clusters are made from entries alone, one way round for each pair, and are those of the plain rule."""
    at = entries_of(spark, some_rows(5, 400)).localCheckpoint()
    got = {}
    for r in clusters.exact_clusters(at, ["book_ord"]).collect():
        got.setdefault((r.seed, r.rule), []).append((r.seq, r.row_ord))
    rules = {(a, b): rule for a, b, rule in by_every_pair(at, "within_book")}
    rows = {r.row_ord: r for r in at.collect()}
    want = []
    for key in sorted({(r.book, r.block) for r in rows.values()}):
        mine = sorted(k for k, r in rows.items() if (r.book, r.block) == key)
        sign = lambda k: tuple(rows[k][f"sig_{p}"] for p in ("title", "first", "last", "post"))
        beside = {(sign(x), sign(y)) for x in mine for y in mine if rows[x].edition == rows[y].edition}
        differ = lambda s, t: s != t and s[2] and s[0] == t[0] and s[2] == t[2] and (bool(s[1]) != bool(t[1]) or s[3] != t[3])
        apart = {(x, y) for x in mine for y in mine if (sign(x), sign(y)) in beside and differ(sign(x), sign(y))}
        want += plain_stars(mine, rules, apart)
    assert {k: [row for _, row in sorted(v)] for k, v in got.items()} == {(seed, rule): rows for seed, rule, rows in want} and len(want) > 20


def test_groups_within_books_need_no_others(spark):
    """What stands within books is the same, with the same numbers, where nothing is looked for across books."""
    schema = "row_ord long, entry_id string, name_type string, " + ", ".join(f"{f} string" for f in FIELDS)
    rows, none = spark.createDataFrame(some_rows(6, 150), schema), spark.createDataFrame([], "entry_id string")
    alone = sorted(map(tuple, clusters.match_components(rows, none, across=False).collect()))
    every = clusters.match_components(rows, none).where("match_tier not like '%cross'").collect()
    assert alone == sorted(map(tuple, every)) and len(alone) > 20


def test_pairs_run_compiled(spark):
    """No part of the join's code is longer than the 8,000 bytes up to which the JVM compiles a method."""
    at = entries_of(spark, some_rows(7, 50)).localCheckpoint()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = clusters.matching_pairs(at, clusters.name_pairs(at).localCheckpoint(), "within_book")._jdf.queryExecution().executedPlan()
        parts = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
        sizes = [parts.apply(k)._3().maxMethodCodeSize() for k in range(parts.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000


def test_pairs_of_packs(spark, monkeypatch):
    """Entries of the same names and titles are told apart by the rest, in arrays of any length."""
    monkeypatch.setattr(clusters, "PACK", 3)
    rows = [(i, f"e{i}", "personal", "B", str(i % 4), "Rev.", "John", "Bell", "", "", "", ("", "Leeds", "Hull")[i % 3]) for i in range(24)]
    rows += [(100 + i, f"f{i}", "personal", "B", str(i % 4), "", "John", ("Bell Hull", "Bells")[i % 2], "", "", "", ("", "Hull")[i % 3 > 1]) for i in range(12)]
    at = entries_of(spark, rows).localCheckpoint()
    near = clusters.name_pairs(at).select("a", "b").union(clusters.absorbing_pairs(at)).distinct()
    got = [(r.a, r.b, r.rule) for r in clusters.matching_pairs(at, near, "within_book").collect()]
    assert set(got) == by_every_pair(at, "within_book") and len(got) == len(set(got)) > 100


def plain_merge(seeds, rules, distance):
    """K4, J8 pair by pair: seeds are (seed, block, first_row, members)."""
    seeds = sorted(seeds, key=lambda r: (r[2], r[0]))
    into, sizes, out, tested, leads = {}, {r[0]: r[3] for r in seeds}, [], set(), {}
    for r in seeds:
        leads.setdefault(r[1], []).append(r[0])

    def root(seed):
        while seed in into:
            seed = into[seed]
        return seed

    for x, left in leads.items():
        for y, right in leads.items():
            if x >= y or (x, y) not in distance:
                continue
            for a in left:
                ra = root(a)
                for b in right:
                    rb = root(b)
                    pair = frozenset((ra, rb))
                    if ra == rb or pair in tested:
                        continue
                    tested.add(pair)
                    if (a, b) not in rules:
                        continue
                    rule, first = rules[a, b]
                    if distance[x, y] <= 2 and first == "exact":
                        keep, gone = (ra, rb) if sizes[ra] >= sizes[rb] else (rb, ra)
                        into[gone] = keep
                        sizes[keep] += sizes[gone]
                    else:
                        out.append((a, b, f"fuzzy_last_{distance[x, y]}+{rule.split('+', 1)[-1]}"))
    return out + [(r[0], root(r[0]), "") for r in seeds]


def merge_case(seed, blocks, each, share):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(blocks)]
    seeds = [(k, names[k % blocks], k % blocks, rng.randint(2, 5)) for k in range(blocks * each)]
    distance = {(x, y): rng.randint(1, 3) for x in names for y in names if x < y and rng.random() < 0.8}
    pairs = [(a[0], b[0]) for a in seeds for b in seeds if (a[1], b[1]) in distance and rng.random() < share]
    return seeds, {p: ("fuzzy_last_1+exact_first", rng.choice(["exact", "exact", "initial"])) for p in pairs}, distance


def merge_tables(seeds, rules, distance):
    import pandas as pd

    block = {s: b for s, b, *_ in seeds}
    facts = [(0, a, b, rule, first, block[a], block[b], distance[block[a], block[b]]) for (a, b), (rule, first) in rules.items()]
    facts += [(1, None, None, "", "", x, y, d) for (x, y), d in distance.items()]
    return pd.DataFrame(seeds, columns=["seed", "block", "first_row", "members"]), pd.DataFrame(facts, columns=["kind", "a", "b", "rule", "first", "x", "y", "distance"])


def test_merges_are_those_of_every_pair():
    for k in range(150):
        case = merge_case(k, 2 + k % 7, 1 + k % 6, (0.05, 0.2, 0.5)[k % 3])
        assert sorted(clusters._merge(*merge_tables(*case))) == sorted(plain_merge(*case)), k


def test_merges_do_not_look_at_every_pair():
    """25 million pairs of seeds, of which two match."""
    import time

    seeds = [(k, ("x", "y")[k % 2], k % 2, 2) for k in range(10_000)]
    tables = merge_tables(seeds, {(0, 1): ("r+exact_first", "exact"), (4, 3): ("r+exact_first", "exact")}, {("x", "y"): 1})
    start = time.process_time()
    found = clusters._merge(*tables)
    assert time.process_time() - start < 5 and [r for r in found if r[0] != r[1]] == [(1, 0, ""), (3, 4, "")]


def test_components_at_once_are_those_of_rounds(spark):
    from rollcall.operators.components import connected_components

    rng = random.Random(3)
    edges = spark.createDataFrame([((1, f"n{rng.randrange(300)}"), (1, f"n{rng.randrange(300)}")) for _ in range(200)], "u struct<k: long, b: string>, v struct<k: long, b: string>")
    once, rounds = (sorted(map(tuple, connected_components(edges, "at-once", n).collect())) for n in (1000, 0))
    assert once == rounds and len(once) > 150


def test_clusters_of_a_long_block_make_no_pairs(spark, monkeypatch):
    """600 entries that all match are one cluster; no table on the way to it has more rows than they are."""
    rows = [(i, f"e{i}", "personal", "B", str(i), "Rev.", "John", "Bell", "", "", "", "") for i in range(600)]
    at, sizes, saved = entries_of(spark, rows).localCheckpoint(), {}, clusters.saved
    monkeypatch.setattr(clusters, "saved", lambda df, name: sizes.setdefault(name, saved(df, name)))
    got = clusters.exact_clusters(at, ["book_ord"]).collect()
    assert [r.row_ord for r in sorted(got, key=lambda r: r.seq)] == list(range(600)) and {r.seed for r in got} == {0}
    assert sizes and max(df.count() for df in sizes.values()) <= 600


@pytest.mark.parametrize(("scope", "remembered"), [("within_book", 2048), ("cross_book", 0)])
def test_clusters_keep_the_rule_field_by_field(spark, monkeypatch, scope, remembered):
    """Clusters are those of all pairs of a block that match, with nulls and empty values in what is compared."""
    monkeypatch.setattr(clusters, "REMEMBERED", remembered)
    rng = random.Random(9)
    rows = [(*r[:9], *(None if rng.random() < 0.1 else x for x in r[9:])) for r in some_rows(8, 300)]
    rows += [(1000 + i, f"f{i}", "personal", "B", None, "Mr.", "", "Bell", "", "", "", "Leeds") for i in range(4)]
    at = entries_of(spark, rows).localCheckpoint()
    within = scope == "within_book"
    got = {}
    for r in clusters.exact_clusters(at, ["book_ord"] if within else [], scope).collect():
        got.setdefault((r.seed, r.rule), []).append((r.seq, r.row_ord))
    pairs = clusters.matching_pairs(at, None, scope).collect()
    rules, rows = {(r.a, r.b): r.rule for r in pairs}, {r.row_ord: r for r in at.collect()}
    want = []
    for key in {(r.book if within else "", r.block) for r in rows.values()}:
        mine = sorted(k for k, r in rows.items() if (r.book if within else "", r.block) == key)
        sign = lambda k: tuple(rows[k][f"sig_{p}"] for p in ("title", "first", "last", "post"))
        beside = {(sign(x), sign(y)) for x in mine for y in mine if (rows[x].book, rows[x].edition) == (rows[y].book, rows[y].edition)}
        differ = lambda s, t: s != t and s[2] and s[0] == t[0] and s[2] == t[2] and (bool(s[1]) != bool(t[1]) or s[3] != t[3])
        apart = {(x, y) for x in mine for y in mine if (sign(x), sign(y)) in beside and differ(sign(x), sign(y))}
        want += plain_stars(mine, rules, apart)
    assert {k: [row for _, row in sorted(v)] for k, v in got.items()} == {(seed, rule): rows for seed, rule, rows in want} and len(want) > 20


def test_near_names_meet_one_way_round(spark, monkeypatch):
    """Clusters of near names are made of pairs that go from the seed to what is behind it; the other way round is not made."""
    names = {k: ("Haworth", "Howarth")[k % 2] for k in range(40)}
    rows = [(k, f"e{k}", "personal", "BC"[k // 2 % 2], str(k), "Rev.", "John", last, "", "", "", "Leeds") for k, last in names.items()]
    at = entries_of(spark, rows).withColumns({"first_row": F.col("row_ord") % 2, "free": F.lit(True), "matched": F.lit(False)}).localCheckpoint()
    made, saved = {}, clusters.saved
    monkeypatch.setattr(clusters, "saved", lambda df, name: made.setdefault(name, saved(df, name)))
    near = spark.createDataFrame([("haworth", "howarth", 2, True)], "a string, b string, distance int, near boolean")
    got = clusters.fuzzy_clusters(at, near, [], 2).collect()
    assert sorted(r.row_ord for r in got) == list(range(40)) and {r.seed for r in got} == {0}
    pairs = [(r.a, r.b) for r in made["match-free"].collect()]
    assert len(pairs) == 40 * 39 // 2 and all((a % 2, a) < (b % 2, b) for a, b in pairs)


def near_case(spark, seed, n):
    """Entries as ``fuzzy_clusters`` takes them, in part matched, with nulls and with places that stand in names; and near names."""
    rng = random.Random(seed)
    rows = [(*r[:8], *(None if rng.random() < 0.05 else x for x in r[8:])) for r in some_rows(seed, n)]
    rows += [(1000 + i, f"f{i}", "personal", "BC"[i % 2], str(i % 5), ("Rev.", "", "Dr.")[i % 3], ("John", "")[i % 4 > 2], ("Bell", "Bell Up", "Bells")[i % 5 % 3], "", "", "", ("", "Up")[i % 7 > 3]) for i in range(60)]
    at = entries_of(spark, rows).where("not initials").withColumns({"free": F.col("row_ord") % 11 != 3, "matched": F.col("row_ord") % 3 == 0}).localCheckpoint()
    return at, clusters.name_pairs(at, stripped=False).select("a", "b").localCheckpoint()


@pytest.mark.parametrize(("keys", "books"), [(["book_ord"], 1), ([], 2)])
def test_clusters_of_near_names_by_pairs_or_by_names(spark, monkeypatch, keys, books):
    """Clusters of near names are the same whether pairs of entries are made or pairs of their names and titles."""
    at, near = near_case(spark, 12, 200)
    at = at.join(at.groupBy(*keys, "block").agg(F.min("row_ord").alias("first_row")), [*keys, "block"]).localCheckpoint()
    got = []
    for most in (1 << 40, -1):
        monkeypatch.setattr(clusters, "PAIRED", most)
        got.append(sorted(tuple(r[c] for c in (*keys, "first_row", "seed", "seq", "row_ord", "rule")) for r in clusters.fuzzy_clusters(at, near, keys, books).collect()))
    assert got[0] == got[1] and len(got[0]) > 60 and any("+loc" in r[-1] for r in got[0])


def test_clusters_of_long_near_blocks_make_no_pairs(spark, monkeypatch):
    """1,600 entries of two near names, all of which match, are one cluster; no table on the way to it has more rows than they are."""
    rows = [(k, f"e{k}", "personal", "BC"[k // 2 % 2], str(k), "Rev.", "John", ("Haworth", "Howarth")[k % 2], "", "", "", "Leeds") for k in range(1600)]
    at = entries_of(spark, rows).withColumns({"first_row": F.col("row_ord") % 2, "free": F.lit(True), "matched": F.lit(False)}).localCheckpoint()
    sizes, saved = {}, clusters.saved
    monkeypatch.setattr(clusters, "saved", lambda df, name: sizes.setdefault(name, saved(df, name)))
    near = spark.createDataFrame([("haworth", "howarth", 2, True)], "a string, b string, distance int, near boolean")
    got = clusters.fuzzy_clusters(at, near, [], 2).collect()
    assert [r.row_ord for r in sorted(got, key=lambda r: r.seq)] == [*range(0, 1600, 2), *range(1, 1600, 2)] and {r.seed for r in got} == {0}
    assert max(df.count() for df in sizes.values()) <= 1600


@pytest.mark.parametrize("most", [1 << 40, -1])
def test_names_keep_their_place_without_a_title_of_the_kind(spark, monkeypatch, most):
    """Two near names meet at the first name that is near to both, though its own entries have titles of another kind."""
    monkeypatch.setattr(clusters, "PAIRED", most)
    rows = [(k, f"e{k}", "personal", "BC"[k % 2], str(k), title, "John", last, "", "", "", "Leeds") for k, (title, last) in enumerate([("Dr.", "Hawirth"), ("Rev.", "Haworth"), ("Rev.", "Howarth")])]
    at = entries_of(spark, rows).withColumns({"first_row": F.col("row_ord"), "free": F.lit(True), "matched": F.lit(True)}).localCheckpoint()
    got = clusters.fuzzy_clusters(at, clusters.name_pairs(at, stripped=False).select("a", "b"), [], 2).collect()
    assert sorted((r.first_row, r.row_ord) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2)]


@pytest.mark.parametrize(("need", "want"), [(float("inf"), [0, 1]), (0.0, [0, 1, 3, 4])])
def test_entries_of_near_names_are_told_apart_by_places_in_them(need, want):
    """Across blocks a place that stands in one name matches it, and an unknown place matches none."""
    import numpy as np
    import pandas as pd

    lasts, places = ["bell up", *["bell"] * 4], ["", "up", None, "hull", ""]
    rows = pd.DataFrame({"part": 0, "row_ord": range(5), "book": "B", "edition": list("12345"), "m_title": "rev.", "m_first": "john", "m_two": False, "m_three": False, "m_raw": lasts, "m_place": places, "m_post": "", "trade": "", "m_body": ""})
    rows = rows.assign(sig_title="rev.", sig_first="john", sig_last=lasts, sig_post="")
    facts = pd.DataFrame([(0, 1, need, True, "up", "")], columns=["a", "b", "need", "unlike", "x", "y"])
    assert [c.tolist() for c in clusters._OneByOne(rows, facts).clusters(np.arange(5))] == [want]
