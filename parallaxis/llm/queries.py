"""The registered queries of the operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm import chat, decontaminate, jaccard_join, line_dedup, multi_index, packing, pii, spelling, storage, suffix_dedup, token_counts, tokens, toxicity, warc, whitening
from parallaxis.llm.oracle import ORACLE_SQL  # noqa: F401


def op1_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(storage.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(storage.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(storage.table(spark, sf_dir, "documents")))


def op4_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, storage.table(spark, sf_dir, "labels"), seen=toxicity.in_fold(F.col("doc_id")) != 2)
    return toxicity.score(docs, model).select(
        "doc_id",
        (toxicity.in_fold(F.col("doc_id")) == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "n_sentences",
        F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("offending"),
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(storage.table(spark, sf_dir, "documents"), storage.table(spark, sf_dir, "benchmark"))


def op6_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(storage.table(spark, sf_dir, "documents"))


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.round_trip(storage.table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "payload_intact")


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = storage.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.windows(turns))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(storage.table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after a load in two batches, a revision, a deletion taken back and a repeated commit."""
    docs = storage.table(spark, sf_dir, "documents")
    ledger = token_counts.TokenLedger(spark, storage.scratch(spark, "ledger"))
    counts = storage.materialize(token_counts.count_tokens(docs, {"word_bpe_49k": tokens.default_vocabulary()}), "token-counts")
    fold = toxicity.in_fold(F.col("doc_id"))
    first, late, gone = counts.filter(fold != 0), counts.filter(fold == 0), counts.filter(fold == 1)
    draft = late.withColumn("n_tokens", F.lit(0))
    ledger.commit("load", token_counts.inserted(first))
    ledger.commit("late load, not counted yet", token_counts.inserted(draft))
    ledger.commit("late counts", token_counts.revised(draft, late))
    ledger.commit("withdrawal", token_counts.deleted(gone))
    ledger.commit("load", token_counts.inserted(first))
    ledger.compact()
    ledger.commit("withdrawal", token_counts.deleted(gone))
    ledger.commit("withdrawal taken back", token_counts.inserted(gone))
    storage.drop(counts)
    return ledger.totals()


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup_passages(storage.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = storage.table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors)).withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(storage.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_multi_index_search": op1_multi_index_search,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii_spans": op3_pii_spans,
    "op4_toxicity_scores": op4_toxicity_scores,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_sequence_packing": op6_sequence_packing,
    "op7_warc_index": op7_warc_index,
    "op8_chat_windows": op8_chat_windows,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_token_counts": op10_token_counts,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}
