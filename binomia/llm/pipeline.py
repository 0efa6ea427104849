"""Corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Every stage gets what the one before kept, as a Parquet table, and all but the last return
the columns of ``documents``, whatever they are named. An empty table passes through all
stages. Rows without doc_id are kept unless quality or contamination rules them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .decontam import decontaminated
from .jaccard import jaccard_components
from .packing import pack
from .quality import score, train
from .secret_scan import redacted_documents


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted to the labels, scores at 0.5 or more.

    Null and empty texts are scored as texts without words; equal texts share their fate, so
    repeated rows stay or go together; ties at 0.5 stay. No column is replaced.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, "__quality").filter("__quality >= 0.5").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five words, Jaccard 0.8; the smallest doc_id stays.

    Rows that repeat an id and its text count as one. Different texts under one id are
    documents of their own (told apart by a hash of id and text). Texts without words are
    near copies of nothing and stay, as do rows without id.
    """
    text = F.xxhash64("text")
    mixed = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b"))
    mixed = mixed.filter("a <> b").select("doc_id", F.lit(True).alias("__mixed"))
    tables = Scratch(spark, "near_copies")
    mixed, path = tables.put(mixed)
    rows = docs.join(mixed, "doc_id", "left").withColumn("__row", F.when(F.col("__mixed"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long")))
    found = jaccard_components(rows, words=5, num=80, den=100, id_col="__row")
    if mixed.isEmpty():
        first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__row"))
    else:  # components are named by hashes here and there: their smallest id decides
        groups = found.select(F.col("doc_id").alias("__row"), "component_id").distinct().join(rows.select("__row", "doc_id"), "__row")
        first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row"))["__row"].alias("__row")).select("__row")
    first = first.distinct()
    kept = rows.join(first, "__row", "left_semi").dropDuplicates(["__row"])
    return kept.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without benchmark passages in a twentieth of their words or more.

    Null and empty texts stay; repeated rows stay or go together.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts masked; ``n_chars`` follows the text.

    Null and empty texts stay as they are, repeated rows are masked alike.
    """
    return redacted_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows and their places in sequences of 2048 tokens.

    Null and empty texts are one end token; repeated rows are packed as often as they come.
    """
    return pack(docs, capacity=2048)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: The classifier and the tokeniser are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is dropped once the next stands."""
    docs, tables, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        docs, path = tables.put(stage(spark, docs, sf_dir))
        if old:
            tables.drop(old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
