"""Every operator and stage on empty tables, nulls, repeated rows, very long texts and columns with clashing names."""

import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollcall.llm import language_id, queries
from rollcall.llm.decontaminate import benchmark_hits, decontaminate
from rollcall.llm.html_extract import extract_main_text, main_text
from rollcall.llm.jaccard_join import jaccard_components, one_per_group
from rollcall.llm.licence_scan import scan_licences
from rollcall.llm.line_dedup import drop_repeated_lines
from rollcall.llm.media_sniff import media_digests, sniff_media, text_media
from rollcall.llm.mixing import mix, mixing_plan
from rollcall.llm.sharding import SlotMap, assign_shards, map_path
from rollcall.llm.surrogates import replace_entities

LINE = "A line that stands in many of the documents."
ROWS = [
    (1, f"Mr. John Smith lives here.\n{LINE}\nThe end.", "en", "a"), (2, f"Write to a.b@c.example.com\n{LINE}", "en", "b"), (3, LINE, None, None),
    (4, None, "en", "a"), (5, "", "de", "b"), (5, "", "de", "b"), (6, "1 2 3 ½", "de", None), (None, "no id here", "en", "a"), (None, None, None, None),
    (7, "long " * 60000, "en", "c"), (8, "one two three four five", "de", "a"), (8, "one two three four five", "de", "a"), (9, "ÉTÉ " * 13, "de", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use for columns of their own, or within.
NAMES = ["Size", "SLOT", "Shard", "Copies", "Target", "N_Lines", "n_DROPPED", "Doc", "k1", "K2", "Node", "gram", "Comp", "Salt", "rows", "Media", "Content", "Lang_Pred", "Score", "LICENCES", "n_Entities", "Special", "dropped", "by", "Virtual", "Place", "of", "its", "sieve_place", "N_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({n: F.lit(f"own {n}") for n in NAMES}).repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("i1", "ÉTÉ " * 13), (None, "x"), ("i2", None)], "item_id string, text string")


@pytest.fixture(scope="module")
def net(spark):
    return language_id.fit_languages(spark.createDataFrame(ROWS, SCHEMA).select("doc_id", "text", "lang"))


OPERATORS = {
    "languages": lambda d, net, bench: language_id.identify_languages(d, net),
    "lines": lambda d, net, bench: drop_repeated_lines(d),
    "benchmark": lambda d, net, bench: benchmark_hits(d, bench),
    "licences": lambda d, net, bench: scan_licences(d),
    "shards": lambda d, net, bench: assign_shards(d, shards=3, slots=64),
    "media": lambda d, net, bench: sniff_media(text_media(d)),
    "digests": lambda d, net, bench: media_digests(d),
    "components": lambda d, net, bench: jaccard_components(d),
    "plan": lambda d, net, bench: mixing_plan(d),
    "surrogates": lambda d, net, bench: replace_entities(d, "key"),
    "pages": lambda d, net, bench: extract_main_text(d.drop("text", "n_chars").withColumn("html", F.col("source"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_row_for_row(docs, net, bench, name):
    """One row out for each row in, names that differ in more than case, and nothing for nothing."""
    out = OPERATORS[name](docs, net, bench)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert len(out.collect()) == len(ROWS)
    kept = [c for c in ("k1", "Node", "sieve_place", "its") if c in out.columns]
    assert all(out.where(F.col(c) == f"own {c}").count() == len(ROWS) for c in kept)
    assert OPERATORS[name](docs.where("false"), net, bench.where("false")).count() == 0


KEEPERS = {"one": lambda d, b: one_per_group(d), "clean": decontaminate, "mixed": lambda d, b: mix(d)}


@pytest.mark.parametrize("name", KEEPERS)
def test_rows_that_are_kept(docs, bench, name):
    out = KEEPERS[name](docs, bench)
    assert out.columns == docs.columns
    rows = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in out.collect()} <= rows
    assert KEEPERS[name](docs.where("false"), bench).count() == 0
    if name == "clean":
        assert {r.doc_id for r in out.collect()} == {r[0] for r in ROWS} - {9}
        assert decontaminate(docs, bench.where("false")).count() == len(ROWS)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(spark, docs, bench, tmp_path, name, stage):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, docs, str(tmp_path))
    if name != "sharding":
        assert out.columns == docs.columns
    held = {tuple(r) for r in docs.select("doc_id", "text", "k1", "its").collect()}
    assert {tuple(r) for r in out.select("doc_id", "text", "k1", "its").collect()} <= held
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_letters():
    assert [language_id.has_letter(t) for t in ("½ ² Ⅷ 12 _", "1a", "ß", "語", "")] == [False, True, True, True, False]


def test_long_addresses(spark):
    """An address of very many labels is found, and a text of dots and signs is read through."""
    texts = ["x@" + "a." * 100_000 + "org end", "a@" + "b." * 100_000, "." * 300_000, "Mr. x " * 50_000, "+1 " * 50_000, "x@y.org. Then."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = replace_entities(docs, "key").orderBy("doc_id").collect()
    assert got[0].text.endswith(" end") and len(got[0].text) < 300_000 and got[0].n_entities == 1
    assert [r.text for r in got[1:5]] == texts[1:5]
    assert re.fullmatch(r"\w@\w+\.example\.org\. Then\.", got[5].text)


def test_one_person_in_many_forms(spark):
    """Titles do not tell persons apart, surnames stay families, and bare mentions follow."""
    texts = [
        "Dr. John Smith met Mr. John Smith and Mr. Smith. Then John Smith left, and Smith too; a blacksmith stayed.",
        "Mrs. Anna Smith-Jones wrote. Prof. Luca Rossi and Dr. Robin Weber came.", "Mr. Luca Rossi came.", "Mrs. Robin Weber left.", "Smith is not named here.",
    ]
    got = [r.text for r in replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    m = re.fullmatch(r"Dr\. (\w+) (\w+) met Mr\. (\w+) (\w+) and Mr\. (\w+)\. Then (\w+) (\w+) left, and (\w+) too; a blacksmith stayed\.", got[0])
    given, surname = m[1], m[2]
    assert (m[3], m[6]) == (given, given) and {m[4], m[5], m[7], m[8]} == {surname} and "Smith" not in got[0] and given != "John"
    prof, doctor = re.search(r"Prof\. (\w+ \w+) and Dr\. (\w+ \w+) came", got[1]).groups()
    assert got[2] == f"Mr. {prof} came." and got[3] == f"Mrs. {doctor} left." and got[4] == texts[4]


def test_accounts_keep_their_check_digits(spark):
    texts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB83WEST12345698765432"]
    got = [r.text for r in replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]

    def rest(account):
        plain = account.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97

    assert [rest(t) for t in texts[:2]] == [rest(t) for t in got[:2]] == [1, 1] and not set(texts) & set(got)
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", got[0]) and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", got[1])


def test_pages_take_linear_time():
    for piece in ("<div>", "</p>", '<p title="', "<a href=x>", "<", "<!--", "<script>", "<![CDATA[", "<!", "<p class='x\"y>", "<div></p>"):
        start = time.perf_counter()
        main_text(piece * 50_000)
        assert time.perf_counter() - start < 8, piece


def test_slot_map_of_a_table_is_kept(spark, tmp_path):
    """The query's map is stored once, read by the next run, and edited when the table has grown."""
    spark.createDataFrame([(k, "x" * (k % 90)) for k in range(2000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    path = map_path(spark, str(tmp_path), "documents")
    first = queries.op6_sharding(spark, str(tmp_path)).collect()
    assert SlotMap.versions(spark, path) == [1]
    assert sorted(queries.op6_sharding(spark, str(tmp_path)).collect()) == sorted(first) and SlotMap.versions(spark, path) == [1]
    spark.createDataFrame([(k, "y" * 50) for k in range(2000, 2100)], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    second = {r.doc_id: r.shard for r in queries.op6_sharding(spark, str(tmp_path)).collect()}
    assert SlotMap.versions(spark, path) == [1, 2] and sum(second[r.doc_id] != r.shard for r in first) < 300
    used = SlotMap.read(spark, path).shard_bytes(8)
    assert max(used) - min(used) < 0.02 * sum(used)
