"""Every query with SQL against DuckDB over the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


def compare(spark, name, run, sql):
    df = run(spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for path in DATA.glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want, name


LIBRARY = sorted(n for n in entry.oracle_sql() if n != "pipeline" and not n.startswith("op"))


@pytest.mark.parametrize("name", LIBRARY)
def test_sql(spark, name):
    compare(spark, name, entry.queries()[name], entry.oracle_sql()[name])


def test_flagship(spark):
    assert entry.entry(spark).columns == ["person_id", "normalized_name", "num_works", "works"]


def test_no_sql_without_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(DATA)


def test_every_query_says_something():
    """No comparison holds only because both sides are empty."""
    with duckdb.connect() as db:
        for path in (DATA.parent / "sf0.01").glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        empty = [name for name in LIBRARY if not db.execute(f"SELECT count(*) FROM ({entry.oracle_sql()[name]}) x").fetchone()[0]]
        rules = {r[0] for name in ("match_pairs", "match_pairs_cross") for r in db.execute(f"SELECT DISTINCT verdict FROM ({entry.oracle_sql()[name]}) x").fetchall()}
    assert not empty
    parts = {p for rule in rules for p in rule.split("+")}
    assert {"exact_last", "fuzzy_last_1", "fuzzy_last_2", "exact_first", "fuzzy_first", "initial_first", "missing_first", "loc", "post", "occ", "aff"} <= parts


def test_pairs_of_a_larger_table(spark, monkeypatch):
    monkeypatch.setitem(globals(), "DATA", DATA.parent / "sf0.01")
    for name in ("missed_match_scores", "match_pairs", "match_pairs_cross", "ledger_apply", "exact_clusters", "single_links"):
        compare(spark, name, entry.queries()[name], entry.oracle_sql()[name])
