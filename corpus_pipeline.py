"""Corpus pipeline: stages over the documents table, each written as Parquet and read again as the next one's docs.

Stages, in order: the quality classifier's rejects go; one document of each group of near copies stays (the smallest doc_id; of rows equal
in doc_id and text one; a null doc_id comes last; documents without shingles all stay); personal data is replaced by its kind in angle
brackets (n_chars follows); sources are mixed to their target weights, so a document appears as often as it is taken, which may be never;
the texts are BPE encoded and decoded. All but the last return the columns of documents, and other columns of any name pass through. Nulls
and empty tables have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm import bpe, jaccard_join, mixing, pii, quality_classifier
from tidemark.llm.common import new_path, settled, small, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, longer if df has it."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a row is named by what it holds, as ids may be null or repeated; components are found among these names
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    joined = settled(jaccard_join.joined(keyed.select(F.col(key).alias("doc_id"), "text")).where("n_shingles > 0"))
    rows = joined.groupBy(F.col("doc_id").alias("k")).agg(F.first("component_id").alias("c"), F.count(F.lit(1)).alias("n"))
    ids = keyed.select(F.col(key).alias("k"), F.col("doc_id").cast("long").alias("d")).distinct()
    named = settled(rows.join(ids, "k"))
    best = named.groupBy("c").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "k")).alias("b"), F.count(F.lit(1)).alias("size"))
    # only names of groups and of repeated rows go on: those that go, and those of which one row stays
    judged = named.join(best.where("size > 1"), "c", "left").select("k", F.coalesce(F.col("k") != F.col("b.k"), F.lit(False)).alias("goes"), "n")
    judged = settled(judged.where("goes OR n > 1"))
    gone, twice = (small(judged.where(x).select(F.col("k").alias(key))) for x in ("goes OR n > 1", "NOT goes"))
    once = keyed.join(twice, key, "left_semi").dropDuplicates([key])
    return keyed.join(gone, key, "left_anti").unionByName(once).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = pii.with_spans(docs)
    # a span may be told apart only when its neighbour is gone (a phone number right before an address), so base spans are sought once more
    df = pii.with_spans(first.select("row", pii.masked(first).alias("text")), {})
    row, text = F.col("row.row"), F.when(F.col("row.row.text").isNotNull(), pii.masked(df))
    n_chars = F.coalesce(row["n_chars"] + F.length(text) - F.length(row["text"]), row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    new = {"text": text, "n_chars": n_chars}
    return df.select(*[new.get(c, row.getField(c)).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, dup, copies, copy = (free_name(docs, n) for n in ("key", "dup", "copies", "copy"))
    mixed = settled(mixing.mixed(docs.select("doc_id", "text", "source")).select(F.col("key").alias(key), F.col("dup").alias(dup), F.col("copies").alias(copies)))
    taken, keyed = mixed.where(F.col(copies) > 0), docs.withColumn(key, mixing.row_key(docs))
    # only rows that are repeated need a number
    twice = small(settled(mixed.where(F.col(dup) > 0).select(key).distinct()))
    number = F.row_number().over(W.partitionBy(key).orderBy(key)) - 1
    single = keyed.join(twice, key, "left_anti").join(taken.where(F.col(dup) == 0).select(key, copies), key)
    repeated = keyed.join(twice, key, "left_semi").withColumn(dup, number.cast("long")).join(taken, [key, dup]).drop(dup)
    out = single.unionByName(repeated).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return out.select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: The stages use models, iterations and draws that SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
