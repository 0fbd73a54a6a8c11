"""From raw documents to a mix for training: quality, near duplicates, benchmark passages, personal data, mixing.

Every stage works on all rows that its predecessor kept.  The first four return the columns of documents; the
last returns the mix: documents in reading order (mix_block, mix_rank), each as often as its source is repeated.
A doc_id names a document: rows that share one count as one document from the second stage on; rows without doc_id are
duplicates of nothing.  Documents without words stay (nothing in them is bad), and the mix holds them once, however often it
repeats their source.  An empty table gives no rows; columns that documents has beside its own pass the first four stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolens.llm import decontamination, jaccard_join, mixing, pii, resampling
from isolens.llm.scratch import apart, broadcast_up_to, saved, table

#: Ids that are broadcast at most; more of them are joined by a shuffle of the documents.
MOST_IDS = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards the documents labelled good; what it does not select goes."""
    return resampling.select_rows(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 over five words, the document with the smallest doc_id stays."""
    linked = jaccard_join.similar_documents(docs, n=5, least=80).filter("doc_id is not null")
    by_id = saved(linked.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count(F.lit(1)).alias("n")).filter("gone or n > 1"), "by-id")
    left = docs.join(broadcast_up_to(by_id.filter("gone").select("doc_id"), MOST_IDS), "doc_id", "left_anti").select(docs.columns)
    repeated = by_id.filter("n > 1 and not gone").select("doc_id")
    if repeated.isEmpty():
        return left
    repeated = broadcast_up_to(repeated, MOST_IDS)
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, up to word edits, go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    own = apart(docs, "doc_id", "text", "n_chars")
    found = pii.find_pii(own, keep=tuple(c for c in own.columns if c != "doc_id"))
    clean = found.withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        touched = F.size("spans") > 0
        clean = clean.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(own.columns).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with its texts: mix_block, mix_rank, doc_id, source, epoch, tokens, weight, text."""
    # the key of a row without id, a hash, cannot be taken for an id
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.xxhash64("text", "source")).alias("id"))
    own = docs.select("doc_id", "source", "text", key.alias("key"))
    plan = mixing.mix(own.select(F.col("key").alias("doc_id"), "source", "text")).withColumnRenamed("doc_id", "key")
    # ids are unique by now; rows without one may be equal
    texts = own.filter("doc_id is not null").unionByName(own.filter("doc_id is null").dropDuplicates(["key"])).select("key", "doc_id", "text")
    return plan.join(texts, "key").select("mix_block", "mix_rank", "doc_id", "source", "epoch", "tokens", "weight", "text")


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("personal data", personal_data),
    ("source mixing", mixed),
]

#: Hashed language models, LSH and permutations by hash have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
