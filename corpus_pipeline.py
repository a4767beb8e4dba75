"""From raw documents to packed training sequences, in five stages.

Each stage works on what the one before it kept, written as Parquet and read again. All but the last return the
columns of ``documents``; whatever other columns the input has are carried as they are, under any name.

Edge cases: a null or empty text is clean, has nothing to drop, is alone in its group and packs as the end id alone.
Documents that line dedup leaves empty stay documents. Repeated rows are all scored alike; near-duplicate removal
keeps one of them. Null ids count as the smallest id where ids decide which line stays, and as the largest where they
decide which near duplicate does. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm import decontaminate, jaccard_join, line_dedup, packing, storage, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns but the text as one, so that no name can clash with an operator's own."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _unpacked(frame: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    own = {c: F.col("row").getField(c) for c in columns} | {"text": F.col("text")} | changed
    return frame.select(*(own[c].alias(c) for c in columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the noisy-or model, trained on all labels, scores at its threshold or more."""
    model = toxicity.fit(docs, storage.table(spark, sf_dir, "labels"))
    scored = toxicity.score(_packed(docs), model, keep=("row", "text"))
    return _unpacked(scored.filter(F.col("score") < toxicity.THRESHOLD), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; every document stays, and ``n_chars`` counts what is left of it."""
    kept = line_dedup.dedup_lines(_packed(docs), keep=("row",))
    return _unpacked(kept, docs.columns, n_chars=F.length("text").cast("long"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest id: five words, 0.8 or more."""
    return jaccard_join.one_of_each(docs, words=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold most of a benchmark item."""
    return decontaminate.clean(docs, storage.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens, mixed by source."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: Learned scores and a tokenizer's ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``, each written to the shared folder and read again."""
    docs = storage.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, storage.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        storage.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
