"""A whole run over small invented lists, and the goldens where they are at hand."""

import csv
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rollcall.__main__ import main
from rollcall.functions.text import changed, normalize_name
from rollcall.operators.parse import parse_names
from rollcall.plans.run import FILES, MATCH_FILES, Config, run_all
from rollcall.sources import sinks
from rollcall.sources.tables import MissingColumns, assert_columns, read_csv, read_graphml, read_optional, read_pairs, read_words, scan_lists

LISTS = {
    "a.csv": [("1", "Mr. John Birch, Leeds", "The Chronicle", "Marlow, O.", "1", "1789"), ("", "Lord and Lady Ashford", "The Chronicle", "Marlow, O.", "1", "1789"), ("", "Duke of Hull", "The Chronicle", "Marlow, O.", "1", "1789")],
    "b.csv": [("1", "John Birch, Esq. Leeds", "The Chronicle", "Marlow, O.", "2", "1790"), ("2", "Duke of Hull", "The Chronicle", "Marlow, O.", "2", "1790"), ("3", " ", "The Chronicle", "Marlow, O.", "2", "1790")],
    "c.csv": [("1", "Mr. John Birch of Leeds", "Letters", "Hollis", "1", "1782"), ("2", "Duke of Hull", "Letters", "Hollis", "1", "1782")],
}


@pytest.fixture
def folder(tmp_path):
    for name, rows in LISTS.items():
        with (tmp_path / name).open("w", newline="") as f:
            out = csv.writer(f)
            out.writerow(["no.", "listed as", "book", "author", "edition", "year"])
            out.writerows(rows)
    (tmp_path / "d.csv").write_text("x,y\n1,2\n")
    return str(tmp_path)


def test_scan(spark, folder):
    rows, skipped = scan_lists(spark, folder)
    assert [r["listed as"] for r in rows.orderBy("row_ord").collect()] == [x[1] for v in LISTS.values() for x in v]
    assert [Path(s).name for s in skipped] == ["d.csv"]
    with pytest.raises(MissingColumns):
        assert_columns(rows, ["nothing"])
    assert read_optional(spark, folder + "/none.csv", ["a"]).count() == 0


def test_run(spark, folder, tmp_path):
    out = run_all(spark, Config(lists=folder))
    people = {r.entry_id: r.person_id for r in out["deduplicated"].collect()}
    assert len(people) == 8
    dukes = {v for k, v in people.items() if k in ("Marlow-Chronicle-1-0003", "Marlow-Chronicle-2-0002", "Hollis-Letters-1-0002")}
    assert dukes == {"Marlow-Chronicle-1-0003"}
    shared = out["shared"].collect()
    assert [(r.normalized_name, r.num_works, r.works) for r in shared] == [("Duke of Hull", 2, "Letters; The Chronicle")]
    assert out["overlap"].first().shared == 1
    graphml = tmp_path / "graph.xml"
    sinks.write_graphml(out["works"], out["persons"], out["edges"], str(graphml))
    lines = graphml.read_text()
    assert lines.count("<node") == out["works"].count() + out["persons"].count() and lines.count("<edge") == out["edges"].count()
    works, persons, edges = read_graphml(spark, str(graphml))
    for read, made in ((works, out["works"]), (persons, out["persons"]), (edges, out["edges"])):
        assert sorted(map(tuple, read.collect())) == sorted(map(tuple, made.select(*read.columns).collect()))
    assert out["parsed"].select(changed(F.col("normalization input"), F.col("normalized_name"))).first()[0] == 2
    path = str(tmp_path / "out.csv")
    sinks.write_csv(out["shared"], path, ["person_id", "normalized_name", "num_works", "works"], single=True)
    sinks.replace_csv(read_csv(spark, path), path)
    assert read_csv(spark, path).count() == 1
    assert sinks.counters(out["parsed"], titled="name_type = 'titled'").first().asDict() == {"rows": 8, "titled": 5}


def test_command_line(spark, folder, tmp_path, capsys):
    """A run that writes its files, a review of what waits, its harvest, and a second run that the ledger decides."""
    (tmp_path / "more").mkdir()
    with (Path(folder) / "e.csv").open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["no.", "listed as", "book", "author", "edition", "year"])
        out.writerows([("1", "Mr. Elphin Oak", "Elegies", "Vale", "1", "1790"), ("2", "Mr. Peter Hollis", "Elegies", "Vale", "1", "1790")])
    with (Path(folder) / "f.csv").open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["no.", "listed as", "book", "author", "edition", "year"])
        out.writerows([("1", "Mr. Elphon Oak", "Elegies", "Vale", "2", "1791"), ("2", "Mr. Peter Holliss", "Elegies", "Vale", "2", "1791")])
    config, done = tmp_path / "more" / "run.toml", tmp_path / "more" / "out"
    config.write_text(f'lists = "{folder}"\nledger = "{tmp_path}/more/ledger.csv"\n')
    run = lambda *args: main([*args, "--config", str(config), "--out", str(done)], spark)
    run("all")
    assert {p.name for p in done.iterdir()} >= {*FILES.values(), *MATCH_FILES, "graph.graphml", "ring.svg"}
    assert (done / "ring.svg").read_text().startswith("<svg") and read_csv(spark, str(done / "candidates.csv")).count() > 0
    run("review")
    assert "Elphin Oak" in capsys.readouterr().out
    waiting = read_csv(spark, str(done / "candidates.csv")).where("normalized_name like '%Oak'").first().group_id
    run("review", "--group", waiting, "--action", "y")
    run("harvest")
    ledger = read_csv(spark, str(tmp_path / "more" / "ledger.csv")).collect()
    assert [(r.verdict, {r.name_a, r.name_b}) for r in ledger] == [("y", {"Mr. Elphin Oak", "Mr. Elphon Oak"})]
    run("dedupe")
    run("apply")
    persons = {r.normalized_name: r.person_id for r in read_csv(spark, str(done / "deduplicated.csv")).collect()}
    assert persons["Mr. Elphin Oak"] == persons["Mr. Elphon Oak"]
    run("report", "--limit", "1")
    assert "John Birch" in capsys.readouterr().out
    assert read_csv(spark, str(done / "edition-candidates.csv")).where("arr_label like '%Holliss%'").count() == 1
    bad = tmp_path / "more" / "bad.toml"
    bad.write_text("list = 1\n")
    with pytest.raises(ValueError, match="unknown settings"):
        Config.load(spark, str(bad))


def beside(*columns):
    """A CSV file of a folder beside the repository that has the columns, the first by name; None if there is none."""
    top = Path(__file__).resolve().parents[2]
    for folder in sorted(x for x in top.iterdir() if x.is_dir() and not x.name.startswith(".") and x != Path(__file__).resolve().parents[1]):
        for path in sorted(x for x in [*folder.glob("*/*.csv"), *folder.glob("*/*/*.csv")] if x.is_file() and os.access(x, os.R_OK)):
            with path.open(encoding="utf-8", errors="replace", newline="") as f:
                if set(columns) <= set(next(csv.reader(f), [])):
                    return str(path)
    return None


GOLDENS = {"CANDIDATES": beside("match_rule", "normalized_name", "listed as", "parsed_title", "parsed_location"), "SPELLING": beside("misspelling", "correction"), "OCCUPATIONS": beside("occupation")}


@pytest.mark.skipif(not all(GOLDENS.values()), reason="no goldens beside the repository")
def test_goldens(spark):
    """Rows that show what they were normalised from; others were split or refined before."""
    golden = read_csv(spark, GOLDENS["CANDIDATES"])
    spelling = read_pairs(spark, GOLDENS["SPELLING"], "misspelling", "correction")
    trades = read_words(spark, GOLDENS["OCCUPATIONS"], "occupation")
    rows = golden.select(F.monotonically_increasing_id().alias("i"), "normalized_name", F.col("listed as").alias("normalization input"), F.lit("first-last").alias("name_order"),
                         *[F.col(c).alias(f"want_{c[7:]}") for c in golden.columns if c.startswith("parsed_")])
    rows = rows.withColumn("own", normalize_name(F.col("normalization input"), spelling))
    got = parse_names(rows, trades, spelling).collect()
    same = [r for r in got if r.own == r.normalized_name]
    assert len(same) >= 0.9 * len(got)
    wrong = [(r["normalization input"], {c: (r[f"want_{c}"], r[f"parsed_{c}"]) for c in ("title", "first", "last", "postnominals", "occupation", "affiliation", "location") if r[f"want_{c}"] != r[f"parsed_{c}"]}) for r in same]
    wrong = [w for w in wrong if w[1]]
    assert not wrong, wrong[:5]
