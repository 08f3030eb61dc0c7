import pytest
from pyspark.sql import functions as F

from rollcall.functions import text
from rollcall.operators import ingest, order, parse

SPELLING = {"Wundham": "Wyndham", "Wyndham": "Windham", "New Town": "Newtown"}


def apply(spark, values, fn):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalisation(spark):
    cases = {
        "The Rev. Mr. Alder, of Norwich": "Rev. Mr. Alder of Norwich",
        "Mr Wm.BirchofHull": "Mr. William Birch of Hull",
        "John Elm, Esquire, 2 copies": "John Elm Esq.",
        "Duke Bedford": "Duke of Bedford",
        "Viscount Marlow": "Visc. of Marlow",
        "His Grace the Duke of Ashford": "Duke of Ashford",
        "J.C. Oak": "J. C. Oak",
        "--- Green": "---- Green",
        "Samuel Reed ditto": "Samuel Reed",
        "Mrs. Fran. Vale": "Mrs. Frances Vale",
        "Mr. Fran. Vale": "Mr. Francis Vale",
        "Fran. Vale": "Fran. Vale",
        "": "",
    }
    assert apply(spark, cases, lambda c: text.normalize_name(c, SPELLING)) == list(cases.values())


def test_spelling_is_one_pass(spark):
    assert apply(spark, ["Wundham", "WYNDHAM of new town"], lambda c: text.replace_words(c, SPELLING)) == ["Wyndham", "Windham of Newtown"]


def test_geographic_of(spark):
    assert apply(spark, ["John Ash of Hull", "Duke of Hull"], text.strip_geographic_of) == ["John Ash Hull", "Duke of Hull"]


def test_compound_entries(spark):
    cases = {
        "Lord and Lady Ashford": ["Lord Ashford", "Lady Ashford"],
        "Mr. and Mrs. Green": ["Mr. Green", "Mrs. Green"],
        "Mr. And Mrs. Green": ["Mr. And Mrs. Green"],
        "Messrs. Oak and Co.": ["Messrs. Oak and Co."],
        "Mr and Mrs Green": ["Mr and Mrs Green"],
    }
    assert apply(spark, cases, ingest.split_compound) == list(cases.values())


def test_entry_ids(spark):
    rows = spark.createDataFrame([("Marlow, O.", "The Interesting Chronicle", "2", 7), ("Hollis", "Letters", "Am", 12345)], "a string, b string, e string, n int")
    got = [r[0] for r in rows.select(ingest.entry_id(F.col("a"), F.col("b"), F.col("e"), F.col("n"))).collect()]
    assert got == ["Marlow-Interesting-2-0007", "Hollis-Letters-Am-12345"]


def test_numbers_go_on_from_the_largest(spark):
    rows = [(0, 0, "1", ""), (0, 1, "1", "7"), (0, 2, "1", ""), (0, 3, "2", ""), (0, 4, "1", "x")]
    df = spark.createDataFrame(rows, "file int, row_ord long, edition string, `no.` string")
    for c in ("author", "book", "listed as"):
        df = df.withColumn(c, F.when(F.col("row_ord") == 1, " ").otherwise("A"))
    got = {r.row_ord: r.number for r in ingest.number_rows(df).collect()}
    assert got == {0: 8, 2: 9, 3: 1, 4: None}


def test_list_order(spark):
    names = ["John Ash", "Mary Bell", "Thomas Cole", "William Dunn", "James East"]
    rows = spark.createDataFrame([(i, n, "A", "B", "1") for i, n in enumerate(names)], "row_ord long, normalized_name string, author string, book string, edition string")
    given = ["john", "mary", "thomas", "william", "james"]
    found = order.detect_orders(rows, given).first()
    assert (found.order, found.confidence, found.source, found.fl, found.lf) == ("first-last", "high", "votes", 10, 0)
    forced = order.detect_orders(rows, given, spark.createDataFrame([("A|B|1", "last-first")], "list_key string, order string")).first()
    assert (forced.order, forced.source) == ("last-first", "override")


PARSED = [
    ("Mr Wm.BirchofHull", "first-last", ("personal", "", "Mr.", "William", "Birch", "", "", "", "Hull")),
    ("Peter Hollis, Boston", "first-last", ("bare", "", "", "Peter", "Hollis", "", "", "", "Boston")),
    ("Peter Hollis, N. Y.", "first-last", ("bare", "", "", "Peter", "Hollis", "N. Y", "", "", "")),
    ("Peter Hollis, printer, N. Y.", "first-last", ("bare", "", "", "Peter", "Hollis", "N. Y", "printer", "", "")),
    ("Peter Hollis, do.", "first-last", ("bare", "", "", "Peter", "Hollis", "", "", "", "ditto")),
    ("Bell, Mr. Edward, bookseller, Leeds", "last-first", ("personal", "", "Mr.", "Edward", "Bell", "", "bookseller", "", "Leeds")),
    ("Freer, W. Surgeon", "last-first", ("bare", "", "", "W.", "Freer", "", "", "", "Surgeon")),
    ("Bell, Mr, W. printer", "last-first", ("personal", "", "Mr.", "W.", "Bell", "", "printer", "", "")),
    ("Duke of Ashford", "first-last", ("titled", "duke of ashford", "Duke of Ashford", "", "", "", "", "", "")),
    ("Right Hon. the Earl of Ash", "first-last", ("titled", "earl of ash", "Right Hon. Earl of Ash", "", "", "", "", "", "")),
    ("A Young Lady", "first-last", ("anonymous", "", "", "", "", "", "", "", "")),
    ("Wm. Shore, Esq. Sheffield, 12 copies", "first-last", ("bare", "", "", "William", "Shore", "", "", "", "Esq. Sheffield")),
    ("", "first-last", ("bare", "", "", "", "", "", "", "", "")),
]


def test_parser(spark):
    rows = spark.createDataFrame([(i, raw, o) for i, (raw, o, _) in enumerate(PARSED)], "i int, `normalization input` string, name_order string")
    rows = rows.withColumn("normalized_name", text.normalize_name(F.col("`normalization input`")))
    got = parse.parse_names(rows, ["printer", "bookseller"]).orderBy("i").collect()
    columns = parse.PARSED[:-1]
    for row, (raw, _, want) in zip(got, PARSED, strict=True):
        assert tuple(row[c] for c in columns) == want, raw


@pytest.mark.parametrize(("raw", "notes"), [("John Ash, the son of Mr. Ash, 2 copies", "2 copies; son of Mr. Ash"), ("A. B. of the Royal Navy ditto", "ditto; of the Royal Navy"), ("", "")])
def test_notes(spark, raw, notes):
    assert apply(spark, [raw], parse.notes_of) == [notes]
