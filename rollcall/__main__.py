"""Command line: ``python -m rollcall COMMAND --config FILE``; tables come from and go to any store that Spark reaches."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.ledger import apply_review, display_groups, pending_groups
from rollcall.plans import run
from rollcall.sources.sinks import write_candidates, write_csv
from rollcall.sources.tables import read_csv


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rollcall", description="Names of lists: parse, match, review, graph.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        one = sub.add_parser(name, help=text)
        one.add_argument("--config", required=True, help="TOML file with the paths of lists, lexicons and side tables")
        one.add_argument("--out", default="out", help="folder for what is written")
        return one

    command("parse", "lists to parsed names")
    for name, text in (("dedupe", "match parsed names and give person ids"), ("all", "parse, match, give ids, and make the graph")):
        command(name, text).add_argument("--strict", action="store_true", help="across books, match entries only that say more than a first name")
    command("graph", "graph, overlaps and drawings of deduplicated rows").add_argument("--rows", help="deduplicated CSV; by default the one in the folder")
    command("apply", "fill in what the ledger decides and give person ids anew")
    command("harvest", "put the decisions of reviewed candidates into the ledger").add_argument("--candidates", help="reviewed CSV; by default the one in the folder")
    review = command("review", "show groups that wait for review, or act on one")
    review.add_argument("--rule", default="", help="only groups whose rule has this in it")
    review.add_argument("--group")
    review.add_argument("--action", choices=("y", "n", "x"))
    review.add_argument("--position", type=int, default=0, help="the row that an x is for, from 1")
    report = command("report", "departures of an edition with like arrivals of the next")
    report.add_argument("--author")
    report.add_argument("--min-score", type=float, default=2.5)
    report.add_argument("--limit", type=int, default=50, help="how many are printed; all are written")
    return top


def _ordered(df: DataFrame) -> DataFrame:
    return df.withColumn("row_ord", F.col("row_ord").cast("long"))


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    parts = [_ordered(read_csv(spark, f"{folder}/{file}")).select(F.lit(k).alias("file"), "group_id", "match", "row_ord", "entry_id", "match_rule", "match_tier") for k, file in enumerate(run.MATCH_FILES)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    said = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("rollcall").getOrCreate()
    config = run.Config.load(spark, said.config)
    if getattr(said, "strict", False):
        config = run.dataclasses.replace(config, strict=True)
    out, candidates = said.out, f"{said.out}/{run.MATCH_FILES[3]}"
    if said.command == "parse":
        run.write_run({"parsed": run.run_parse(spark, config)}, out)
    elif said.command == "dedupe":
        parsed = _ordered(read_csv(spark, f"{out}/{run.FILES['parsed']}"))
        matches = run.run_match(spark, config, parsed)
        run.write_run({"parsed": parsed, "matches": matches, "deduplicated": run.run_apply(parsed, matches), "conflicts": run.mapping_conflicts(matches)}, out, there=("parsed",))
    elif said.command == "all":
        run.write_run(run.run_all(spark, config), out)
    elif said.command == "graph":
        rows = _ordered(read_csv(spark, said.rows or f"{out}/{run.FILES['deduplicated']}"))
        run.write_run(run.run_graph(spark, config, rows), out)
    elif said.command == "apply":
        parsed = _ordered(read_csv(spark, f"{out}/{run.FILES['parsed']}"))
        matches = run.saved(run.with_ledger(spark, config, _matches(spark, out)), "matches")
        run.write_run({"parsed": parsed, "matches": matches, "deduplicated": run.run_apply(parsed, matches), "conflicts": run.mapping_conflicts(matches)}, out, there=("parsed",))
    elif said.command == "harvest":
        run.run_harvest(spark, config, _ordered(read_csv(spark, said.candidates or candidates)))
    elif said.command == "review":
        rows = _ordered(read_csv(spark, candidates))
        if said.group and said.action:
            act = spark.createDataFrame([(1, said.group, said.action, said.position)], "seq int, group_id string, action string, position int")
            done = run.saved(apply_review(rows, act), "reviewed")
            write_csv(done.orderBy("row_ord"), candidates, rows.columns, single=True)
        else:
            waiting = pending_groups(rows, said.rule).select("group_id")
            shown = rows.join(waiting, "group_id", "left_semi") if not said.group else rows.where(F.col("group_id") == said.group)
            display_groups(shown.select("group_id", "row_ord", "match", "entry_id", "normalized_name", "book", "edition", "match_rule")).show(200, truncate=False)
    elif said.command == "report":
        rows = _ordered(read_csv(spark, f"{out}/{run.FILES['deduplicated']}"))
        found = run.saved(run.run_report(rows, said.min_score, said.author), "report")
        found.orderBy(F.desc("score"), "dep_pid", "arr_pid").limit(said.limit).select("score", "edition_boundary", "dep_label", "arr_label").show(said.limit, truncate=False)
        write_candidates(found, f"{out}/edition-candidates.csv", ["score", "edition_boundary", "dep_label", "arr_label", "dep_pid", "arr_pid"])


if __name__ == "__main__":
    main()
