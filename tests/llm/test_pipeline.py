import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as entry
import corpus_pipeline
from rollcall.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    with duckdb.connect() as db:
        for path in DATA.glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        found = db.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.saved(stage(spark, docs, str(DATA)), "stage")
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= before, name
        if name != "sharding":
            assert out.columns == docs.columns, name
        docs, before = out, now
    assert docs.where("shard is null or shard not between 0 and 7").count() == 0
