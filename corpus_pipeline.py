"""From raw documents to token ids: toxicity, line dedup, near duplicates, mixing, byte-level BPE.

Each stage reads what the one before wrote, as Parquet in the session's shared folder, and takes its decisions for good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import byte_bpe, line_dedup, ngram_join, pareto_mix, pu_toxicity
from faultline.llm.queries import ranks_path
from faultline.operators.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Learned scores and hashed candidates are not expressible in SQL.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go; all others stay, empty and null texts too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = pu_toxicity.score(docs.select(*COLUMNS), pu_toxicity.train(docs, labels))
    return scored.where("predicted = 0").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line makes superfluous go; documents stay, if need be with an empty text. Lines from 20
    words on may differ in two words, from 40 on in three."""
    kept = line_dedup.drop_lines(docs.select(*COLUMNS), grow=line_dedup.GROWING)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links the one with the smallest id stays, once; texts without words are alike."""
    docs = docs.select(*COLUMNS)
    found = ngram_join.ngram_join(docs).where("doc_id <=> class_id").select("doc_id", "text_key").distinct()
    return ngram_join.one_of_each(docs, found).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for; a document that is not taken goes."""
    mixed = pareto_mix.mix(docs.select(*COLUMNS))
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, and the digest of the bytes that they decode to."""
    return byte_bpe.round_trip(docs, ranks_path(), keep=("source",), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
