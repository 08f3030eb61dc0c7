"""The bipartite graph of works and persons: nodes, edges, overlap, communities."""

from __future__ import annotations

import heapq
from collections import defaultdict
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.operators.components import connected_components
from rollcall.operators.numbering import numbered
from rollcall.sources.shared import saved

if TYPE_CHECKING:
    import pandas as pd

MEASURES = ("count", "jaccard", "repr")


def work_nodes(rows: DataFrame) -> DataFrame:
    """A row for each book, with its first author and its first and last year."""
    year = F.trim(F.col("year").cast("string")).try_cast("int")
    return rows.groupBy("book").agg(F.min_by("author", "row_ord").alias("author"), F.min(year).alias("first_year"), F.max(year).alias("last_year")).withColumn("label", F.col("book"))


def person_nodes(rows: DataFrame) -> DataFrame:
    """A row for each person, with the last name seen."""
    return rows.groupBy("person_id").agg(F.max_by("normalized_name", "row_ord").alias("normalized_name")).withColumn("label", F.col("normalized_name"))


def edges(rows: DataFrame) -> DataFrame:
    """K12, L13."""
    return rows.select("person_id", "book").distinct()


def author_conflicts(rows: DataFrame) -> DataFrame:
    """Authors other than the first of each book, with how many rows have them."""
    first = rows.groupBy("book").agg(F.min_by("author", "row_ord").alias("kept"))
    return rows.join(first, "book").where("author <> kept").groupBy("book", "kept", "author").agg(F.count(F.lit(1)).alias("rows"))


def work_sizes(links: DataFrame) -> DataFrame:
    """Persons of each work."""
    return links.groupBy("book").agg(F.count(F.lit(1)).alias("persons"))


def overlap(links: DataFrame, works: DataFrame) -> DataFrame:
    """Each pair of works with its sizes, shared persons and all measures; pairs that share none are kept.

    Works stand by first year and title; ``work_a`` is the earlier. Shared
    persons are counted from the persons' side: each person's works make pairs,
    so the work grows with the persons and not with the square of the lists.
    """
    sizes = works.join(work_sizes(links), "book", "left").select("book", F.coalesce("persons", F.lit(0)).alias("size"), F.coalesce("first_year", F.lit(0)).alias("year"))
    population = links.select("person_id").distinct().agg(F.count(F.lit(1)).alias("population"))
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy("year", "book")))
    a, b = placed.select(*[F.col(c).alias(f"{c}_a") for c in placed.columns]), placed.select(*[F.col(c).alias(f"{c}_b") for c in placed.columns])
    pairs = a.join(b, F.col("place_a") < F.col("place_b"))
    near = links.select("person_id", F.col("book").alias("x")).join(links.select("person_id", F.col("book").alias("y")), "person_id").where("x <> y")
    shared = near.groupBy(F.col("x").alias("book_a"), F.col("y").alias("book_b")).agg(F.count(F.lit(1)).alias("n"))
    out = pairs.join(shared, ["book_a", "book_b"], "left").join(F.broadcast(population))
    n = F.coalesce("n", F.lit(0))
    union = F.col("size_a") + F.col("size_b") - n
    expected = F.col("size_a") * F.col("size_b") / F.col("population")
    return out.select(
        F.col("book_a").alias("work_a"), F.col("book_b").alias("work_b"), "size_a", "size_b", n.alias("shared"),
        n.cast("double").alias("count"), F.when(union > 0, n / union).otherwise(0.0).alias("jaccard"), F.when(expected > 0, n / expected).otherwise(0.0).alias("repr"),
    )


def overlap_measure(links: DataFrame, works: DataFrame, measure: str) -> DataFrame:
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; one of {MEASURES}")
    return overlap(links, works).select("work_a", "work_b", F.col(measure).alias("value"))


def projected_edges(pairs: DataFrame, measure: str = "jaccard") -> DataFrame:
    """Pairs of works that share a person, weighted by a measure."""
    return pairs.where((F.col("shared") > 0) & (F.col(measure) > 0)).select("work_a", "work_b", F.col(measure).alias("weight"))


def greedy_communities(nodes: list[str], weights: dict[tuple[str, str], float], resolution: float = 1.0, total: float | None = None) -> list[set[str]]:
    """Communities of greatest modularity by repeatedly merging the pair that gains most, while one gains.

    Ties go to the first names. ``total`` is the weight of all edges of the
    graph, if ``weights`` are those of a part of it that nothing ties to the
    rest: gains within such a part depend on the others by that sum only.
    """
    total = sum(weights.values()) if total is None else total
    groups = {n: {n} for n in nodes}
    if not total:
        return list(groups.values())
    degree, between = defaultdict(float), defaultdict(dict)
    for (a, b), w in weights.items():
        degree[a] += w
        degree[b] += w
        between[a][b] = between[b][a] = w
    version: dict[str, int] = defaultdict(int)
    heap: list[tuple] = []

    def offer(a: str, b: str) -> None:
        a, b = min(a, b), max(a, b)
        gain = between[a][b] / total - resolution * degree[a] * degree[b] / (2 * total * total)
        heapq.heappush(heap, (-gain, a, b, version[a], version[b]))

    for a, b in weights:
        offer(a, b)
    while heap:
        loss, a, b, at, bt = heapq.heappop(heap)
        if loss >= 0:
            break
        if a not in groups or b not in groups or (at, bt) != (version[a], version[b]):
            continue
        groups[a] |= groups.pop(b)
        degree[a] += degree.pop(b)
        for other, w in between.pop(b).items():
            between[other].pop(b)
            if other != a:
                between[a][other] = between[other][a] = between[a].get(other, 0.0) + w
        version[a] += 1
        for other in between[a]:
            offer(a, other)
    return list(groups.values())


def communities(works: DataFrame, weighted: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(book, community): by size from 0, and -1 for works on their own.

    Each connected part of the projected graph is merged on its own, in one
    task; a part has a node for each work, not for each person. Ties go by
    title, which other tools may break otherwise.
    """
    weighted = saved(weighted.select("work_a", "work_b", "weight"), "community-edges")
    parts = connected_components(weighted.select(F.col("work_a").alias("u"), F.col("work_b").alias("v")), "community-parts")
    total = weighted.agg(F.sum("weight").alias("total"))
    at = weighted.join(parts.select(F.col("node").alias("work_a"), "component"), "work_a").join(F.broadcast(total))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        weights = {(min(a, b), max(a, b)): w for a, b, w in zip(part.work_a, part.work_b, part.weight, strict=True)}
        found = greedy_communities(sorted({x for pair in weights for x in pair}), weights, resolution, float(part.total.iloc[0]))
        return pd.DataFrame([(book, min(g), len(g)) for g in found if len(g) > 1 for book in g], columns=["book", "lead", "size"])

    found = saved(at.groupBy("component").applyInPandas(run, "book string, lead string, size long"), "communities-found")
    order = numbered(found.select((-F.col("size")).alias("less"), "lead").distinct(), ["less", "lead"], "number", "community-numbers")
    member = found.join(order.select("lead", "number"), "lead").select("book", (F.col("number") - 1).cast("int").alias("community"))
    return works.select("book").join(member, "book", "left").select("book", F.coalesce("community", F.lit(-1)).alias("community"))


def community_order(works: DataFrame, membership: DataFrame) -> DataFrame:
    """Works with ``place``: communities in turn, single works last, by year and title within."""
    at = works.join(membership, "book")
    order = [F.when(F.col("community") < 0, 1).otherwise(0), "community", F.coalesce("first_year", F.lit(0)), "book"]
    return at.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def shared_persons(rows: DataFrame) -> DataFrame:
    """Persons of two works or more, with their works in order; those with most works first."""
    books = F.array_sort(F.collect_set("book"))
    out = rows.groupBy("person_id").agg(F.max_by("normalized_name", "row_ord").alias("normalized_name"), books.alias("books"))
    out = out.where(F.size("books") >= 2)
    return out.select("person_id", "normalized_name", F.size("books").cast("long").alias("num_works"), F.array_join("books", "; ").alias("works")).orderBy(F.desc("num_works"), "person_id")
