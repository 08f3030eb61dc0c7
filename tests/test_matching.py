import random

import pytest
from pyspark.sql import functions as F

from rollcall.functions import compat
from rollcall.operators import clusters, editions, graph, identity, ledger, titles
from rollcall.operators.fuzzy import fuzzy_self_join
from rollcall.operators.numbering import numbered
from rollcall.plans import views

FIELDS = ["book", "edition", *compat.FIELDS]


def entry(title="", first="", last="Ash", post="", occ="", aff="", loc="", book="B", edition="1"):
    return (book, edition, title, first, last, post, occ, aff, loc)


CASES = [
    (entry("Mr.", "John"), entry("", "John", post="Esq.", edition="2"), "within_book", "exact_last+exact_first"),
    (entry("Mr."), entry("", edition="2"), "within_book", None),
    (entry("Rev."), entry("Mr.", edition="2"), "within_book", None),
    (entry("", "John", loc="Leeds"), entry("", "John", loc="Hull", edition="2"), "within_book", None),
    (entry("Mr.", "John"), entry("Mr.", "John"), "within_book", None),
    (entry("Miss", "Ann"), entry("Miss", "An", edition="2"), "within_book", "exact_last+fuzzy_first+title"),
    (entry("Mr.", "Elphin"), entry("Mr.", "Elphon", edition="2"), "within_book", "exact_last+fuzzy_first"),
    (entry("Mr.", "Joseph", "Haworth"), entry("Mr.", "Joseph", "Howarth", edition="2"), "within_book", "fuzzy_last_2+exact_first"),
    (entry("Mr.", "J.", "de la Tour"), entry("Mr.", "John", "Tour", edition="2"), "within_book", "exact_last+initial_first"),
    (entry("", "R. L.", ""), entry("", "R. L.", "", edition="2"), "within_book", "multi_initials"),
    (entry("", "R. L.", ""), entry("", "R. L.", "", book="C"), "cross_book", None),
    (entry("", "John", "Ash Leeds"), entry("", "John", "Ash", loc="Leeds", edition="2"), "within_book", "exact_last+exact_first+loc"),
]


@pytest.mark.parametrize("case", CASES)
def test_match_rule(spark, case):
    a, b, scope, want = case
    schema = ", ".join(f"{s}_{f} string" for s in "ab" for f in FIELDS)
    rows = spark.createDataFrame([a + b], schema)
    rule = compat.entries_match(lambda n: F.col(f"a_{n}"), lambda n: F.col(f"b_{n}"), scope)
    assert rows.select(rule).first()[0] == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_fuzzy_join_loses_no_pair(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(150)})
    want = {(a, b, edits(a, b)) for a in words for b in words if a < b and edits(a, b) <= 3}
    got = fuzzy_self_join(spark.createDataFrame([(w,) for w in words], "w string"), "w", 3)
    assert {tuple(r) for r in got.collect()} == want


def namelist(spark, rows):
    schema = "row_ord long, entry_id string, name_type string, " + ", ".join(f"{f} string" for f in FIELDS)
    return spark.createDataFrame([(i, f"e{i}", "personal", *r) for i, r in enumerate(rows)], schema)


def test_clusters_link_and_merge(spark):
    rows = [
        entry("Mr.", "John", "Haworth"), entry("Mr.", "John", "Haworth", edition="2"),
        entry("Mr.", "John", "Howarth", edition="3"), entry("Mr.", "John", "Howarth", edition="4"),
        entry("Mr.", "John", "Hawarth", edition="5"),
        entry("Mr.", "John", "Haworth", book="C", loc="Hull"),
        entry("Mr.", "Elphin", "Oak"), entry("Mr.", "Elphon", "Oak", edition="2"),
    ]
    none = spark.createDataFrame([], "entry_id string")
    results = []
    for parts in (1, 3):
        got = clusters.match_components(namelist(spark, rows).repartition(parts), none).collect()
        results.append(sorted((r.match, r.row_ord, r.match_rule, r.match_tier) for r in got))
        groups = {r.row_ord: r.group_id for r in got if r.match == "y"}
        assert len({groups[k] for k in (0, 1, 2, 3, 4)}) == 1
    assert results[0] == results[1]
    tiers = {(r[1], r[3]): r[2] for r in results[0]}
    assert tiers[4, "auto_within_linkage"] == "fuzzy_last_1+exact_first"
    assert (6, "candidate_within") in tiers and (5, "candidate_cross") in tiers
    assert sum("cluster_merge" in r[2] for r in results[0]) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_grouping_of_blocks_changes_nothing(spark, monkeypatch, seed):
    """Kernels that see the blocks which matching entries tie together find what one that sees a whole book finds."""
    rng = random.Random(seed)
    lasts = "Ash Ashe Asher Ashes Bell Bells Belle Cole Coles Coley Smith Smyth Smythe Smithe Haworth Howarth Hawarth Haworthe Low Lowe Lowes".split()
    pick = lambda *values: rng.choice(values)
    rows = [
        entry(pick("Mr.", "Mr.", "", "Rev.", "Dr."), pick("John", "John", "Jon", "J.", "", "Mary", "William", "R. L."), pick("", *lasts * 2), pick("", "", "Esq.", "Jun."), "",
              "", pick("", "", "", "Leeds", "Hull"), pick("B", "C"), pick("1", "2", "3", "4"))
        for _ in range(260)
    ]
    none = spark.createDataFrame([], "entry_id string")

    def found():
        got = clusters.match_components(namelist(spark, rows), none).collect()
        return sorted((r.group_id, r.row_ord, r.match, r.match_rule, r.match_tier) for r in got)

    apart = found()
    monkeypatch.setattr(clusters, "_with_group", lambda entries, pairs, near, keys: entries.withColumn("group", F.lit(0).cast("long")))
    assert apart == found()
    assert {t for *_, t in apart} >= {"auto_within", "candidate_within", "auto_within_linkage", "candidate_cross"}


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(f"k{(7 * k) % 500:03d}", -k) for k in range(500)], "a string, b int").repartition(7)
    got = numbered(rows, ["a", "b"], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: (r.a, r.b))] == list(range(1, 501))
    assert numbered(rows.where("false"), ["a"], "n").count() == 0


def test_names_side_by_side_stay_apart(spark):
    rows = [entry("Mr.", "John", post="Jun."), entry("Mr.", "John", post="Sen."), entry("Mr.", "John", post="Jun.", edition="2")]
    got = clusters.match_components(namelist(spark, rows), spark.createDataFrame([], "entry_id string")).collect()
    assert {r.row_ord for r in got} == {0, 2}


def test_identity_is_last_writer(spark):
    rows = [(0, "g1", 0, "e1", "y"), (0, "g1", 1, "e2", "y"), (0, "g1", 2, "e3", "y"), (3, "g9", 3, "e4", "y"), (3, "g9", 4, "e2", ""), (3, "g8", 5, "e5", ""), (3, "g8", 6, "e1", "y")]
    ids = identity.person_ids(spark.createDataFrame(rows, "file int, group_id string, row_ord long, entry_id string, match string"))
    assert {r.entry_id: r.person_id for r in ids.collect()} == {"e1": "e1", "e3": "e1", "e2": "e4", "e4": "e4"}


def reviewed(spark, marks, group="g"):
    rows = [(group, i, chr(97 + i), m, chr(65 + i), "B", "1", "r") for i, m in enumerate(marks)]
    return spark.createDataFrame(rows, "group_id string, row_ord long, entry_id string, match string, normalized_name string, book string, edition string, match_rule string")


@pytest.mark.parametrize(("marks", "want"), [("yyx", {("a", "b", "y"), ("a", "c", "n"), ("b", "c", "n")}), ("nyx", {("a", "b", "n"), ("a", "c", "n"), ("b", "c", "n")}), (" yy", set())])
def test_reviewed_groups(spark, marks, want):
    got = ledger.group_pairs(reviewed(spark, [m.strip() for m in marks]))
    assert {(r.entry_a, r.entry_b, r.verdict) for r in got.collect()} == want


LEDGER = "entry_a string, entry_b string, verdict string, name_a string, name_b string, context_a string, context_b string, note string"


def test_ledger_round_trip(spark):
    empty = spark.createDataFrame([], LEDGER)
    kept = ledger.harvest(reviewed(spark, "yyx"), empty)
    fresh = reviewed(spark, ["", "", ""])
    assert [r.match for r in ledger.apply_ledger(fresh, kept).orderBy("row_ord").collect()] == ["y", "y", "x"]
    some = spark.createDataFrame([("a", "b", "y", "", "", "", "", "")], LEDGER)
    assert [r.match for r in ledger.apply_ledger(fresh, some).orderBy("row_ord").collect()] == ["", "", ""]
    changed = ledger.harvest(reviewed(spark, "nyy"), kept).where("entry_a = 'a' and entry_b = 'b'").first()
    assert (changed.verdict, changed.note) == ("n", "[was y, now n]")


def test_titles(spark):
    rows = [(0, "e0", "p0", "titled", "duke of hull", "N", "B", "1", "1781", "x"), (1, "e1", "p1", "titled", "duke of hull", "N", "B", "2", "1783", "x"), (2, "e2", "p2", "titled", "duke of hull", "N", "C", "1", "1784", "x"), (3, "e3", "p3", "titled", "earl of ash", "N", "B", "1", "1781", "x"), (4, "e4", "p4", "titled", "earl of ash", "N", "B", "1", "1781", "x")]
    df = spark.createDataFrame(rows, "row_ord long, entry_id string, person_id string, name_type string, title_key string, normalized_name string, book string, edition string, year string, listed_as string")
    holders = spark.createDataFrame([("duke of hull", "Old", "", "", "1782"), ("duke of hull", "New", "", "1783", "")], "title_key string, person_name string, wikidata_id string, start_year string, end_year string")
    got = {r.row_ord: (r.group_id, r.match, r.title_holder, r.match_tier) for r in titles.match_titles(df, holders).collect()}
    assert got == {1: ("tt_0002", "y", "New", "title_holder"), 2: ("tt_0002", "y", "New", "title_holder"), 3: ("tt_0003", "", "", "title_same"), 4: ("tt_0003", "", "", "title_same")}


def test_missed_match_score(spark):
    rows = [(0, "d", "e0", "Mr. Peter Hollis", "1", "Mr.", "Peter", "Hollis", "", ""), (1, "a", "e1", "Mr. Peter Holliss", "2", "Mr.", "Peter", "Holliss", "", "")]
    df = spark.createDataFrame(rows, "row_ord long, person_id string, entry_id string, normalized_name string, edition string, parsed_title string, parsed_first string, parsed_last string, parsed_postnominals string, parsed_location string")
    found = editions.missed_matches(df).collect()
    assert [(r.dep_pid, r.arr_pid, round(r.score, 6)) for r in found] == [("d", "a", 4.5)]


def test_overlap_measures(spark):
    links = spark.createDataFrame([(str(p), b) for b, people in (("A", (1, 2, 3)), ("B", (2, 3, 4)), ("C", (5,))) for p in people], "person_id string, book string")
    works = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "book string, first_year int")
    got = {(r.work_a, r.work_b): (r["count"], r.jaccard, round(r.repr, 6)) for r in graph.overlap(links, works).collect()}
    assert got[("A", "B")] == (2.0, 0.5, round(2 / (9 / 5), 6)) and got[("A", "C")] == (0.0, 0.0, 0.0) and len(got) == 3


def test_communities():
    weights = {("a", "b"): 1.0, ("b", "c"): 1.0, ("a", "c"): 1.0, ("d", "e"): 1.0, ("c", "d"): 0.1}
    found = graph.greedy_communities(list("abcdef"), weights)
    assert sorted(map(sorted, found)) == [["a", "b", "c"], ["d", "e"], ["f"]]


def plain_communities(nodes, weights):
    """The same by trying every pair of groups in each step."""
    total, groups = sum(weights.values()), [{n} for n in sorted(nodes)]
    inside = lambda g, h: sum(w for (a, b), w in weights.items() if (a in g and b in h) or (a in h and b in g))
    degree = lambda g: sum(w * ((a in g) + (b in g)) for (a, b), w in weights.items())
    while True:
        gains = [(inside(g, h) / total - degree(g) * degree(h) / (2 * total * total), g, h) for k, g in enumerate(groups) for h in groups[k + 1 :] if inside(g, h)]
        best = max(gains, key=lambda x: x[0], default=(0, None, None))
        if best[0] <= 1e-12:
            return sorted(map(sorted, groups))
        groups = [g for g in groups if g is not best[1] and g is not best[2]] + [best[1] | best[2]]


def test_communities_of_parts(spark):
    """Parts that nothing ties together are merged on their own, with the weight of the whole graph."""
    rng = random.Random(3)
    names = [f"w{k:02d}" for k in range(18)]
    weights = {(a, b): rng.random() + 0.01 for k, a in enumerate(names) for b in names[k + 1 :] if (a < "w09") == (b < "w09") and rng.random() < 0.4}
    works = spark.createDataFrame([(n,) for n in [*names, "single"]], "book string")
    got = {r.book: r.community for r in graph.communities(works, spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "work_a string, work_b string, weight double")).collect()}
    groups = sorted(sorted(b for b in got if got[b] == k) for k in set(got.values()) if k >= 0)
    assert groups == [g for g in plain_communities(names, weights) if len(g) > 1] and got["single"] == -1
    sizes = [sum(v == k for v in got.values()) for k in range(len(groups))]
    assert sizes == sorted(sizes, reverse=True)
    assert {r.community for r in graph.communities(works, spark.createDataFrame([], "work_a string, work_b string, weight double")).collect()} == {-1}


def test_views_exist():
    assert "row_ord" in views.SUBSCRIPTIONS and "parsed_last" in views.NAMELIST
