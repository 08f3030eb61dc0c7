"""Whole runs: from a folder of lists to parsed names, matches, person ids, graph and exports."""

from __future__ import annotations

import dataclasses
import functools
import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import present
from rollcall.functions.text import normalize_name
from rollcall.operators import graph
from rollcall.operators.clusters import match_components
from rollcall.operators.editions import missed_matches
from rollcall.operators.identity import collapse, person_ids
from rollcall.operators.ingest import consolidate, split_compounds
from rollcall.operators.ledger import apply_ledger, harvest
from rollcall.operators.order import detect_orders, with_order
from rollcall.operators.parse import parse_names
from rollcall.operators.titles import match_titles
from rollcall.sources.shared import saved
from rollcall.sources.sinks import ring_svg, write_csv, write_graphml, write_ledger, write_lines
from rollcall.sources.tables import HOLDERS, LEDGER, OVERRIDES, SHORT_TITLES, exists, filter_author, read_optional, read_pairs, read_words, scan_lists, with_group_order


@dataclass(frozen=True)
class Config:
    """Paths and choices of a run; lexicons that are not given are empty."""

    lists: str
    spelling: str | None = None
    occupations: str | None = None
    given_names: str | None = None
    overrides: str | None = None
    holders: str | None = None
    ledger: str | None = None
    short_titles: str | None = None
    matched: tuple[str, ...] = ()
    strict: bool = False
    resolution: float = 1.0

    @staticmethod
    def load(spark: SparkSession, path: str) -> Config:
        """A TOML file in any store that Spark reads; names that are not known are an error."""
        said = tomllib.loads(spark.read.text(path, wholetext=True).first()["value"])
        if unknown := set(said) - {f.name for f in fields(Config)}:
            raise ValueError(f"{path} has unknown settings: {sorted(unknown)}")
        return Config(**said)


def run_parse(spark: SparkSession, config: Config) -> DataFrame:
    """Lists to parsed names, in the order of files and rows."""
    spelling = read_pairs(spark, config.spelling, "misspelling", "correction") if config.spelling else {}
    trades = read_words(spark, config.occupations, "occupation") if config.occupations else []
    given = read_words(spark, config.given_names, "given_name") if config.given_names else []
    lists, _ = scan_lists(spark, config.lists)
    rows = split_compounds(consolidate(lists))
    rows = rows.withColumn("row_ord", F.col("row_ord") * 2 + F.col("part")).drop("part")
    rows = saved(rows.withColumn("normalized_name", normalize_name(F.col("`normalization input`"), spelling)), "normalized")
    orders = detect_orders(rows, given, read_optional(spark, config.overrides, OVERRIDES))
    return saved(parse_names(with_order(rows, orders), trades, spelling), "parsed")


def run_match(spark: SparkSession, config: Config, parsed: DataFrame) -> DataFrame:
    """Title and component matches with ``file`` (0 to 3, see ``accepted_members``).

    What the ledger decides is filled in for all groups that wait for review,
    titles and components alike.
    """
    titles = saved(match_titles(parsed, read_optional(spark, config.holders, HOLDERS)), "title-matches")
    known = titles.select("entry_id").union(read_matched(spark, config)).distinct()
    parts = match_components(parsed, known, relaxed=not config.strict)
    titles = titles.select(F.when(F.col("match") == "y", 0).otherwise(1).alias("file"), "group_id", "match", "row_ord", "entry_id", F.lit("").alias("match_rule"), "match_tier")
    parts = parts.select(F.when(F.col("match") == "y", 2).otherwise(3).alias("file"), "group_id", "match", "row_ord", "entry_id", "match_rule", "match_tier")
    return with_ledger(spark, config, saved(titles.union(parts), "matches"))


def read_matched(spark: SparkSession, config: Config) -> DataFrame:
    """Ids of entries that earlier title runs have matched, from any number of files; none if none are named."""
    none = spark.createDataFrame([], "entry_id string")
    return functools.reduce(DataFrame.union, (read_optional(spark, p, ["entry_id"]) for p in config.matched), none).distinct()


def with_ledger(spark: SparkSession, config: Config, matches: DataFrame) -> DataFrame:
    """Matches with ``match`` filled in by the ledger in files 1 and 3, the candidates."""
    if not config.ledger or not exists(spark, config.ledger):
        return matches
    fresh = apply_ledger(matches.where("file in (1, 3)"), read_optional(spark, config.ledger, LEDGER))
    return saved(matches.where("file not in (1, 3)").unionByName(fresh), "matches")


def run_harvest(spark: SparkSession, config: Config, reviewed: DataFrame) -> DataFrame:
    """The ledger with the decisions of reviewed candidates, written back to its path if there is one."""
    found = saved(harvest(reviewed, read_optional(spark, config.ledger, LEDGER)).select(*LEDGER), "ledger")
    if config.ledger:
        write_ledger(found, config.ledger)
    return found


def run_apply(parsed: DataFrame, matches: DataFrame) -> DataFrame:
    return saved(collapse(parsed, matches), "deduplicated")


def mapping_conflicts(matches: DataFrame) -> DataFrame:
    """Entries that more than one accepted group has, with how many and the person they were given."""
    return person_ids(matches).where("groups > 1")


def run_report(rows: DataFrame, min_score: float = 2.5, author: str | None = None, limit: int | None = None) -> DataFrame:
    """Departures with like arrivals of the next edition, the best first; of one author and no more than ``limit`` if said."""
    found = missed_matches(filter_author(rows, author), min_score)
    return found if limit is None else found.limit(limit)


def run_graph(spark: SparkSession, config: Config, rows: DataFrame) -> dict[str, DataFrame]:
    """Nodes, edges, overlap, communities, labels and shared persons; works go by their short titles where a side table has them."""
    links, works = saved(graph.edges(rows), "edges"), saved(graph.work_nodes(rows), "works")
    pairs = saved(graph.overlap(links, works), "overlap")
    found = saved(graph.communities(works, graph.projected_edges(pairs), config.resolution), "communities")
    short = read_optional(spark, config.short_titles, SHORT_TITLES).dropDuplicates(["book"])
    labels = works.join(short, "book", "left").select("book", present.short_title(F.col("book"), F.col("short_title")).alias("label"), present.author_last(F.col("author")).alias("author"))
    ordered = graph.community_order(works, found).select("book", "community", "place")
    ring = present.ring_layout(ordered.join(present.node_areas(graph.work_sizes(links)), "book"))
    return {
        "works": works, "persons": graph.person_nodes(rows), "edges": links, "overlap": pairs, "communities": found, "labels": labels,
        "ring": saved(ring, "ring"), "chords": present.chord_widths(pairs), "shared": graph.shared_persons(rows), "authors": graph.author_conflicts(rows),
    }


def run_all(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    parsed = run_parse(spark, config)
    matches = run_match(spark, config, parsed)
    rows = run_apply(parsed, matches)
    return {"parsed": parsed, "matches": matches, "deduplicated": rows, "conflicts": mapping_conflicts(matches)} | run_graph(spark, config, rows)


#: Tables that a run writes, with their files.
FILES = {
    "parsed": "parsed.csv", "deduplicated": "deduplicated.csv", "conflicts": "id-conflicts.csv", "overlap": "overlap.csv", "communities": "communities.csv",
    "labels": "labels.csv", "shared": "shared-persons.csv", "authors": "author-conflicts.csv",
}
MATCH_FILES = ("title-matches.csv", "title-candidates.csv", "matches.csv", "candidates.csv")


def write_run(out: dict[str, DataFrame], folder: str, there: tuple[str, ...] = ()) -> list[str]:
    """Write what a run has found, as CSV, GraphML and SVG; returns the paths. Matches go to a file for each kind, in row order.

    Tables named in ``there`` were read from the folder and are not written.
    """
    done = []
    for name, file in FILES.items():
        if name in out and name not in there:
            done.append(f"{folder}/{file}")
            write_csv(out[name], done[-1], single=True)
    if "matches" in out:
        columns = ["group_id", "match", "row_ord", "entry_id", "match_rule", "match_tier"]
        said = out["parsed"].select("entry_id", *[c for c in out["parsed"].columns if c not in ("entry_id", "row_ord")]) if "parsed" in out else None
        for k, file in enumerate(MATCH_FILES):
            rows = out["matches"].where(F.col("file") == k).select(*columns)
            rows = rows.join(said, "entry_id").select(*columns, *[F.col(f"`{c}`") for c in said.columns if c != "entry_id"]) if said is not None else rows
            done.append(f"{folder}/{file}")
            write_csv(with_group_order(rows).orderBy("group_ord", "group_id", "row_ord"), done[-1], rows.columns, single=True)
    if "edges" in out:
        done += [f"{folder}/graph.graphml", f"{folder}/ring.svg"]
        write_graphml(out["works"], out["persons"], out["edges"], done[-2])
        drawing = out["ring"].sparkSession.createDataFrame([(0, ring_svg(out["ring"], out["chords"]))], "place int, line string")
        write_lines(drawing, done[-1], ["place"])
    return done
