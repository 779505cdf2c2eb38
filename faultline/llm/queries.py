"""The dealt operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import (
    blob_ledger,
    byte_bpe,
    chat_events,
    collocations,
    line_dedup,
    multi_index,
    ngram_join,
    pareto_mix,
    prefix_trie,
    pu_toxicity,
    repetition,
    token_planes,
    warc,
)
from faultline.llm.oracles import oracle_sql as oracle_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents")).drop("text_key")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(_table(spark, sf_dir, "embeddings"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_table(spark, sf_dir, "documents")).drop("longest_repeat", "n_spans", "spans")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    names = blob_ledger.named(docs)
    _, findings = blob_ledger.commit(docs, names, blob_ledger.empty_ledger(spark))
    found = blob_ledger.findings_by_path(names, findings)
    base = [r.kind for r in blob_ledger.BASE]

    def of(*kinds: str):
        return F.filter("found", lambda f: f["kind"].isin(*kinds))

    def joined(rows):
        return F.array_join(F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op6_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "<|im_end|><|im_start|>assistant ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(text).alias("text"))
    return chat_events.formatted_digests(turns.unionByName(own))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = line_dedup.duplicate_lines(docs, line_dedup.read_lines(docs)).drop("text_key")
    return found.withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pareto_mix.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), ranks_path())


def words_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.regrouped_trie(_table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.stored(_table(spark, sf_dir, "documents"), words_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_ngram_join, op2_multi_index, op3_repetition, op4_secret_scan, op5_warc_segments,
            op6_chat_events, op7_line_dedup, op8_toxicity, op9_pareto_mix, op10_byte_bpe,
            op11_prefix_trie, op12_collocations, op13_token_planes,
        )
    }
