"""Queries that write tables through the sinks and read them back through the scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import present
from rollcall.operators import graph
from rollcall.plans import views
from rollcall.sources import sinks, tables
from rollcall.sources.shared import saved, shared_dir

QUERIES = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _names(spark, sf_dir) -> DataFrame:
    return views.view(spark, sf_dir, views.NAMELIST)


def _lists(spark, sf_dir) -> str:
    """A folder of two lists, with a column of its own each, and a table that is no list."""
    folder = _folder(spark)
    at = _names(spark, sf_dir).select("row_ord", F.col("no").alias("no."), F.col("listed_as").alias("listed as"), F.col("full_book").alias("book"), F.col("full_author").alias("author"), "edition", "year", F.col("entry_id").alias("own"))
    for k, name in enumerate(("b.csv", "a.csv")):
        part = at.where(F.col("row_ord") % 2 == k).orderBy("row_ord").drop("row_ord").withColumnRenamed("own", f"own{k}")
        sinks.write_csv(part, f"{folder}/{name}", single=True)
    sinks.write_csv(at.select("year").limit(1), f"{folder}/c.csv", single=True)
    return folder


@query
def list_scan(spark, sf_dir):
    rows, _ = tables.scan_lists(spark, _lists(spark, sf_dir))
    return rows.select("file", "row_ord", F.col("listed as").alias("listed_as"), "book", "own0", "own1")


@query
def skipped_lists(spark, sf_dir):
    _, skipped = tables.scan_lists(spark, _lists(spark, sf_dir))
    return spark.createDataFrame([(path.rsplit("/", 1)[-1],) for path in skipped], "name string")


@query
def required_columns(spark, sf_dir):
    lacking = []
    for columns in (["book", "no"], ["book", "shelf"], ["shelf"]):
        try:
            tables.assert_columns(_names(spark, sf_dir), columns)
        except tables.MissingColumns:
            lacking.append((",".join(columns),))
    return spark.createDataFrame(lacking, "asked string")


@query
def optional_tables(spark, sf_dir):
    path = _folder(spark)
    sinks.write_csv(views.view(spark, sf_dir, views.HOLDERS).drop("wikidata_id"), path)
    there = tables.read_optional(spark, path, tables.HOLDERS)
    return there.unionByName(tables.read_optional(spark, f"{path}-none", tables.HOLDERS))


@query
def lexicons(spark, sf_dir):
    folder = _folder(spark)
    sinks.write_csv(spark.createDataFrame([(" Printer",), ("printer ",), (" ",), ("Attorney",)], "occupation string"), f"{folder}/trades")
    sinks.write_csv(spark.createDataFrame([("Wundham", "Wyndham"), ("New Town", "Newtown")], "misspelling string, correction string"), f"{folder}/spelling")
    words = [("word", w, "") for w in tables.read_words(spark, f"{folder}/trades", "occupation")]
    pairs = [("pair", k, v) for k, v in tables.read_pairs(spark, f"{folder}/spelling", "misspelling", "correction").items()]
    return spark.createDataFrame(words + pairs, "kind string, word string, correction string")


@query
def csv_sink(spark, sf_dir):
    path = _folder(spark)
    sinks.write_csv(_names(spark, sf_dir), path, ["entry_id", "listed_as", "full_book"])
    return tables.read_csv(spark, path)


@query
def csv_replaced(spark, sf_dir):
    path = _folder(spark)
    sinks.write_csv(_names(spark, sf_dir), path, ["entry_id", "listed_as"])
    sinks.replace_csv(tables.read_csv(spark, path).where("listed_as like '%Birch%'"), path)
    return tables.read_csv(spark, path)


@query
def ledger_file(spark, sf_dir):
    path = _folder(spark)
    sinks.write_ledger(views.view(spark, sf_dir, views.LEDGER), path)
    return tables.assert_columns(tables.read_csv(spark, path), tables.LEDGER)


@query
def candidates_file(spark, sf_dir):
    path, rows = _folder(spark), _names(spark, sf_dir)
    wrote = sinks.write_candidates(rows.select("book", "entry_id", "edition"), path, ["entry_id"])
    none = sinks.write_candidates(rows.where("false"), f"{path}-none", ["entry_id"])
    return tables.read_csv(spark, path).select("*", F.lit(wrote).alias("wrote"), F.lit(none or tables.exists(spark, f"{path}-none")).alias("none"))


@query
def graphml_round_trip(spark, sf_dir):
    rows = views.view(spark, sf_dir, views.SUBSCRIPTIONS)
    rows = saved(rows.where("book < 'Brand#3'").select("person_id", "book", "author", "year", "row_ord", F.concat(F.lit('<&"> '), F.col("normalized_name")).alias("normalized_name")), "graphml-rows")
    path = f"{_folder(spark)}.graphml"
    sinks.write_graphml(graph.work_nodes(rows), graph.person_nodes(rows), graph.edges(rows), path)
    works, persons, edges = tables.read_graphml(spark, path)
    return edges.join(works, "book").join(persons.drop("label"), "person_id").select("person_id", "book", "author", "first_year", "last_year", "normalized_name")


@query
def drawing_shapes(spark, sf_dir):
    rows = saved(views.view(spark, sf_dir, views.SUBSCRIPTIONS).select("person_id", "book", "author", "year", "row_ord"), "drawing-rows")
    links, works = graph.edges(rows), graph.work_nodes(rows)
    member = works.select("book", F.lit(0).alias("community"))
    ring = present.ring_layout(graph.community_order(works, member).select("book", "community", "place").join(present.node_areas(graph.work_sizes(links)), "book"))
    svg = sinks.ring_svg(ring, present.chord_widths(graph.overlap(links, works)))
    return spark.createDataFrame([(svg.count("<circle"), svg.count("<path"), svg.count("<text"))], "works long, chords long, labels long")
