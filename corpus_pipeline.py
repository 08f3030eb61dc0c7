"""A corpus pipeline of five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import others, quoted, saved, table
from rollcall.llm.decontaminate import decontaminate
from rollcall.llm.jaccard_join import one_per_group
from rollcall.llm.language_id import accepted, fit_languages, identify_languages
from rollcall.llm.mixing import mix
from rollcall.llm.sharding import assign_shards, map_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a determined language.

    The network learns from the labelled rows of ``docs``. Texts that are null,
    empty or without a letter go, as does everything if nothing is labelled.
    Repeated rows stay or go together, an empty table stays empty, and other
    columns are kept, whatever they are called.
    """
    rest = F.struct(F.lit(0).alias("none"), *[F.col(quoted(c)) for c in others(docs.columns, ["text"])])
    found = identify_languages(docs.select(rest.alias("doc"), "text"), fit_languages(docs.select("doc_id", "text", "lang")))
    kept = [F.col("text") if c.lower() == "text" else F.col(f"doc.{quoted(c)}") for c in docs.columns]
    return found.where(accepted(F.col("score"), F.col("lang_pred"))).select(*kept)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest doc_id of a group stays. Texts without words, null or empty,
    are no group and stay; of rows that repeat doc_id and text one stays. A row
    without doc_id stays if its group has no other. An empty table stays empty
    and other columns are kept, whatever they are called.
    """
    return one_per_group(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more lies in passages of the benchmark.

    Texts without words, null or empty, stay. Repeated rows stay or go together,
    an empty table stays empty, an empty benchmark drops nothing, and other
    columns are kept, whatever they are called.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=13, gram=9, share=20)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin documents until the sources have their target shares.

    A document comes twice at most. Null is a source of its own; a source
    without words gives nothing. Repeated rows are drawn alike, rows without
    doc_id by their text. An empty table stays empty and other columns are kept,
    whatever they are called.
    """
    return mix(docs, weights=(3, 1, 2), percent=150, most=2, seed="mix-1:")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents to eight shards of near equal bytes, by the slot map that is kept for the folder.

    Null and empty texts have a size of 1. Repeated rows go to one shard, each
    with a place of its own. An empty table stays empty; other columns are kept
    but for those named like the new ones, in whatever case.
    """
    return assign_shards(docs, shards=8, path=map_path(spark, sf_dir, "pipeline"))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
