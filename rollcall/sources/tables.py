"""Scans: name lists, side tables, lexicons and match files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Columns that each table must have.
LIST_COLUMNS = ["no.", "listed as", "book", "author", "edition", "year"]
HOLDERS = ["title_key", "person_name", "wikidata_id", "start_year", "end_year"]
OVERRIDES = ["list_key", "order"]
LEDGER = ["entry_a", "entry_b", "verdict", "name_a", "name_b", "context_a", "context_b", "note"]
SHORT_TITLES = ["book", "short_title"]


class MissingColumns(ValueError):
    """A table lacks required columns."""


def assert_columns(df: DataFrame, required: Iterable[str], name: str = "table") -> DataFrame:
    """A3: ``df`` itself, or an error that names what it lacks."""
    if missing := [c for c in required if c not in df.columns]:
        raise MissingColumns(f"{name} is missing columns: {missing}")
    return df


def texts(columns: Iterable[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str | list[str], columns: Iterable[str] | None = None) -> DataFrame:
    """All cells as text; missing cells are empty, never null."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("encoding", "UTF-8")
    df = reader.csv(path)
    return df.na.fill("") if columns is None else assert_columns(df, columns, str(path)).na.fill("")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store Spark reads it from."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_optional(spark: SparkSession, path: str | None, columns: list[str]) -> DataFrame:
    """A4: a side table, or an empty one if it is not there."""
    if not path or not exists(spark, path):
        return spark.createDataFrame([], texts(columns))
    df = read_csv(spark, path)
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files of a folder, sorted by name; an error if there are none."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(str(s.getPath()) for s in fs.listStatus(root) if s.getPath().getName().endswith(".csv")) if fs.exists(root) else []
    if not found:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return found


def scan_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """A1, A2: all lists of a folder in the order of file names, and the files left out for missing columns.

    Adds ``file`` (rank of the file) and ``row_ord`` (place in the whole), which
    all later order goes by. Columns are the union of the files' columns.
    """
    kept, skipped = [], []
    for path in list_files(spark, folder):
        df = read_csv(spark, path)
        if all(c in df.columns for c in LIST_COLUMNS):
            kept.append(df.withColumn("file", F.lit(len(kept))).withColumn("__at", F.monotonically_increasing_id()))
        else:
            skipped.append(path)
    if not kept:
        raise FileNotFoundError(f"no list in {folder} has the columns {LIST_COLUMNS}")
    every = kept[0]
    for df in kept[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    counts = every.groupBy("file").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = every.withColumn("__n", F.row_number().over(Window.partitionBy("file").orderBy("__at")))
    placed = placed.join(F.broadcast(counts.select("file", before.alias("__before"))), "file")
    return placed.withColumn("row_ord", F.col("__before") + F.col("__n") - 1).drop("__at", "__n", "__before").na.fill(""), skipped


def read_words(spark: SparkSession, path: str, column: str) -> list[str]:
    """A5: a lexicon of words, lower-cased; its size is that of a file kept by hand."""
    words = read_csv(spark, path, [column]).select(F.lower(F.trim(column)).alias("w")).where("w <> ''").distinct()
    return sorted(r["w"] for r in words.collect())


def read_pairs(spark: SparkSession, path: str, key: str, value: str) -> dict[str, str]:
    """A5: a lexicon of pairs, with its case."""
    return {r[key]: r[value] for r in read_csv(spark, path, [key, value]).select(key, value).collect()}


def filter_author(rows: DataFrame, author: str | None) -> DataFrame:
    """Rows of one author; all of them if none is named."""
    return rows.where(F.trim("author") == author) if author else rows


def with_group_order(candidates: DataFrame, group: str = "group_id", order: str = "row_ord") -> DataFrame:
    """Rows plus ``group_ord``, the place at which their group first appears."""
    return candidates.withColumn("group_ord", F.min(order).over(Window.partitionBy(group)))


def year_of(c: Column) -> Column:
    return F.expr(f"try_cast(trim(`{c}`) as int)") if isinstance(c, str) else c.try_cast("int")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Works, persons and edges of a bipartite GraphML file; nodes with ``bipartite`` 0 are works."""
    xml = spark.read.format("xml").option("valueTag", "_value")
    keys = xml.option("rowTag", "key").schema("_id string, `_attr.name` string").load(path)
    names = F.create_map(*[F.lit(x) for r in keys.collect() for x in (r["_id"], r["_attr.name"])])  # a handful, from the file's head
    nodes = xml.option("rowTag", "node").schema("_id string, data array<struct<_key:string,_value:string>>").load(path)
    told = F.map_from_entries(F.transform("data", lambda d: F.struct(F.element_at(names, d["_key"]), d["_value"])))
    at = nodes.select(F.col("_id").alias("id"), told.alias("m"))
    side = F.try_element_at("m", F.lit("bipartite")).try_cast("int")

    def field(name: str, kind: str = "string") -> Column:
        return F.try_element_at("m", F.lit(name)).try_cast(kind).alias(name)

    works = at.where(side == 0).select("id", field("book"), field("author"), field("first_year", "int"), field("last_year", "int"), field("label"))
    persons = at.where(side == 1).select(F.col("id").alias("person_id"), field("normalized_name"), field("label"))
    edges = xml.option("rowTag", "edge").schema("_source string, _target string").load(path)
    ends = edges.select(F.col("_source").alias("person_id"), F.col("_target").alias("book"))
    ends = ends.union(edges.select(F.col("_target").alias("person_id"), F.col("_source").alias("book")))
    ends = ends.join(works.select(F.col("id").alias("book")), "book", "left_semi").select("person_id", "book")
    return works.drop("id"), persons, ends
