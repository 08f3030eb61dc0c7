"""Operators on tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rollcall.llm.decontaminate import benchmark_hits, decontaminate, is_contaminated
from rollcall.llm.jaccard_join import jaccard_components, one_per_group
from rollcall.llm.line_dedup import drop_repeated_lines
from rollcall.llm.mixing import mix, mixing_plan
from rollcall.llm.sharding import SlotMap, assign_shards, plan_slots, rebalance, slot_loads

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    out = []
    for k in range(n):
        seed = (seed * 6364136223846793005 + 1442695040888963407 + k) % (1 << 63)
        out.append(WORDS[(seed >> 33) % len(WORDS)] + str((seed >> 40) % 50))
    return out


def corpus():
    """Near and exact copies, a line that many share, nulls, blanks, a very long text and a repeated row."""
    rows, line = [], "This line stands in Many documents of the corpus."
    base = prose(1, 120)
    for k in range(40):
        words = list(base)
        for j in range(k % 6):
            words[(k * 17 + j * 31) % 120] = f"edit{k}x{j}"
        rows.append((100 + k, " ".join(words)))
    for k in range(30):
        rows.append((k, " ".join(prose(k + 7, 5 + 9 * k)) + f"\n{line if k % 2 else line.upper()}\t\nend {k}"))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one two"), (204, "One TWO"), (205, "ÉTÉ été"), (206, "x" * 30), (207, " ".join(prose(99, 20000)))]
    rows += [(300, "a b c d e f"), (300, "a b c d e f"), (301, "a b c d e f"), (None, "a b c d e f")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{(i or 0) % 4}" if i != 203 else None, len(t or "")) for i, t in corpus()]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def grams(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, width, percent):
    sets, parent = [grams(t, width) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return [(i, len(sets[k]), min(least[root(k)], default=None) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def sortable(rows):
    return sorted((tuple((x is None, x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_components(docs, width, percent):
    got = jaccard_components(docs, width, percent).collect()
    assert sortable(got) == sortable(brute_components(corpus(), width, percent))


def test_jaccard_rounds_of_a_large_cluster(spark, monkeypatch):
    from rollcall.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    monkeypatch.setattr(jaccard_join, "MORE_PIVOTS", 2)
    base, rows = prose(3, 80), []
    for k in range(60):
        words = base[: 80 - k % 9]
        rows.append((k, " ".join([*words, *(f"own{k}x{j}" for j in range(k % 5))])))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sortable(got) == sortable(brute_components(rows, 4, 85))


@pytest.mark.parametrize("bounds", [{}, {"LAST_PAIRS": 0}, {"LAST_PAIRS": 0, "TOGETHER": 0}])
def test_jaccard_rounds_only_where_much_is_left(spark, monkeypatch, bounds):
    from rollcall.llm import jaccard_join
    from rollcall.operators import components

    written = []
    for module in (jaccard_join, components):
        monkeypatch.setattr(module, "saved", lambda df, name, save=module.saved: (written.append(name), save(df, name))[1])
    for name, value in {"PIVOTS": 1, "MORE_PIVOTS": 2, **bounds}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    base, rows = prose(4, 80), []
    for k in range(40):
        words = base[: 80 - 3 * (k % 9)]
        rows.append((k, " ".join([*words, *(f"own{k}x{j}" for j in range(k % 7))])))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sortable(got) == sortable(brute_components(rows, 4, 85))
    rounds, stars = written.count("jaccard-links"), written.count("jaccard-components")
    assert rounds > 1 if bounds else rounds == 1
    assert stars > 1 if "TOGETHER" in bounds else stars == 1


def test_one_per_group(docs):
    kept = one_per_group(docs, 4, 85)
    want = {c for _, n, c in brute_components(corpus(), 4, 85) if n} | {200, 201, 202}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert kept.columns == docs.columns


def test_line_dedup(docs):
    rows = corpus()
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = drop_repeated_lines(docs).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sortable(got) == sortable(want)
    assert sum(r.n_dropped for r in got) > 20


ITEMS = [("i1", " ".join(prose(1, 120)[5:40])), ("i2", "one, Two!"), ("i3", None), ("i4", "..."), ("i5", " ".join(prose(99, 20000)[500:513])), (None, " ".join(prose(8, 50)[:14])), ("i1", "été")]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("items", [ITEMS, [x for x in ITEMS if not x[1] or len(x[1]) > 40]])
def test_benchmark_hits(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add(i)
    want = []
    for i, t in corpus():
        w, hit, found = words_of(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        want.append((i, len(w), len(hit), tuple(sorted(x for x in found if x is not None))))
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in benchmark_hits(docs, bench).collect()]
    assert sortable(got) == sortable(want)
    bad = Counter(i for i, n, h, _ in want if h and 20 * h >= n)
    kept = decontaminate(docs, bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in corpus()) - bad
    assert kept.columns == docs.columns


def test_contamination_rule(spark):
    rows = spark.createDataFrame([(0, 0), (1, 20), (1, 21)], "h long, n long")
    assert [r[0] for r in rows.select(is_contaminated(F.col("h"), F.col("n"))).collect()] == [False, True, False]


def test_mixing(docs):
    plan = mixing_plan(docs).collect()
    sizes = defaultdict(int)
    for i, t in corpus():
        sizes[None if i == 203 else f"s{(i or 0) % 4}"] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in full)
        heavy = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / heavy for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 2
    mixed = mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert sorted(map(repr, mixing_plan(docs.repartition(3)).collect())) == sorted(map(repr, plan))


def test_mixing_comes_near_its_targets(spark):
    rows = [(k, "w " * (20 + k % 30), f"s{k % 5}") for k in range(4000)]
    plan = mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.06 * r.target


def test_sharding(docs):
    rows = assign_shards(docs, shards=3, slots=64)
    got = rows.collect()
    places, used = defaultdict(list), defaultdict(int)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        assert r.grown_shard is None and r.law == "bytes"
        places[r.shard].append(r.slot)
        used[r.shard] += r.size
    assert len(got) == len(corpus()) and all(sorted(v) == list(range(len(v))) for v in places.values())
    assert set(docs.columns) <= set(rows.columns)


def test_slot_map_is_kept_and_edited(spark, tmp_path):
    rows = [(k, "x" * (k * 7919 % 900)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loads = slot_loads(docs, 256)
    first = plan_slots(loads, 4)
    assert max(first.shard_bytes(4)) - min(first.shard_bytes(4)) < 0.01 * sum(first.shard_bytes(4))
    second = rebalance(first, loads, 5)
    moved = [b for a, b in zip(first.shards, second.shards, strict=True) if a != b]
    assert second.version == 2 and set(moved) == {4} and max(second.shard_bytes(5)) < 1.05 * sum(second.shard_bytes(5)) / 5
    path = str(tmp_path / "map")
    first.write(spark, path)
    second.write(spark, path)
    assert SlotMap.read(spark, path) == second and SlotMap.read(spark, path, 1) == first


def test_empty_tables(spark, empty, docs):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert jaccard_components(empty).count() == 0 and drop_repeated_lines(empty).count() == 0
    assert benchmark_hits(empty, bench).count() == 0 and mixing_plan(empty).count() == 0 and assign_shards(empty).count() == 0
    hits = benchmark_hits(docs, bench)
    assert hits.where("n_hit > 0").count() == 0 and hits.count() == len(corpus())


def test_clashing_columns(docs):
    extra = docs.where("doc_id < 5").withColumns({c: F.lit("own") for c in ("size", "shard", "slot", "copies", "target", "n_lines", "n_dropped", "key", "row", "items", "n", "cid")})
    assert assign_shards(extra).where("cast(shard as string) = 'own'").count() == 0
    assert mixing_plan(extra).where("cast(copies as string) = 'own'").count() == 0
    assert drop_repeated_lines(extra).where("n_lines < 1").count() == 0
    assert jaccard_components(extra).count() == 5 and one_per_group(extra).columns == extra.columns
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
