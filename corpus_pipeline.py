"""Corpus pipeline: quality, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.jaccard_join import JaccardParams, jaccard_components
from gridloom.llm.mixing import mixed_rows
from gridloom.llm.pieces import encode_texts, load
from gridloom.llm.quality_model import score_quality
from gridloom.llm.store import Scratch, table
from gridloom.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return score_quality(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar does not reject."""
    return score_toxicity(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles: that with the smallest id.

    Rows, not ids, are compared: a row goes by its id and a hash of its columns (null ids first), so rows that repeat an id
    are told apart. Of wholly equal rows one stays; rows without words link with nothing and all stay.
    """
    row = F.struct("doc_id", F.xxhash64(*COLUMNS).alias("h"))
    rows = docs.select(*COLUMNS, row.alias("__row"))
    found = jaccard_components(rows, JaccardParams(shingle_words=5, percent=80), id_col="__row")
    others = found.where("component_id <> __row").select("__row")
    again = found.where("component_id = __row and n_shingles > 0").groupBy("__row").agg(F.count("*").alias("n")).where("n > 1").select("__row")
    rest = rows.join(others, "__row", "left_anti")
    single = rest.join(again, "__row", "left_anti").select(*COLUMNS)
    return single.unionByName(rest.join(again, "__row", "left_semi").dropDuplicates(["__row"]).select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, dealt to its shards in shuffled order."""
    mixed = mixed_rows(docs)
    mixed = mixed.withColumn("n_chars", F.length("text").cast("long"))
    return mixed.repartition("shard").sortWithinPartitions("shard", "position").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document, and whether they decode to its text."""
    return encode_texts(docs, load(), ["doc_id", "lang", "source"])


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]

#: Learned scores and hash permutations: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
