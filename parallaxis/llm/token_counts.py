"""Delta-maintained token rollups with idempotent batch commits.

A ledger is a folder of committed batches. A batch holds signed additive deltas by (source, lang, tokenizer version):
an insert adds a document and its tokens, a delete subtracts them, and a revised count subtracts the old figure and
adds the new one. Totals are the sum of all batches, so they never need the documents again.

A commit pre-aggregates its changes and writes them to a folder of its own. It then writes a claim, a small file that
names the folder, into a folder that no reader looks at, and renames that folder to one named after the batch id. The batch
is committed from that rename on, claim and all. Where such a folder is there already, a rename puts the new one inside it,
where it counts for nothing: a repeated or resumed commit adds nothing, and of two that race the first counts. A committer
that dies earlier leaves at most folders that nothing names, and the batch can be committed again.

``compact`` sums what is committed into a snapshot, whose own claim lists the batches that it holds; totals are the
newest snapshot and the batches after it. What a snapshot replaces is removed by the compaction after it, so totals
that were asked for before a compaction can still be read after it. Claims stay, so batches that were compacted are
still known.

Edge cases: null source, language or version are keys of their own; a null count is 0; an empty batch commits and
changes nothing; keys whose documents and tokens both return to 0 vanish from the totals; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm import storage, tokens

KEYS = ("source", "lang", "tokenizer_version")
_DELTA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"


def count_tokens(docs: DataFrame, vocabularies: dict[str, str]) -> DataFrame:
    """(doc_id, source, lang, tokenizer_version, n_tokens): whole texts, one row for each document and vocabulary.

    ``vocabularies`` maps a version name to a tokenizers JSON. A null or empty text has 0 tokens.
    """
    named = sorted(vocabularies.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                for version, path in named:
                    n = [len(x) // 4 for x in tokens.encoder(path).encode(texts)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("source"), part.column("lang"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                        names=["doc_id", *KEYS, "n_tokens"],
                    )

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).alias("sign"), F.col("n_tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("sign"), F.col("n_tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that take back the old counts and add the new ones."""
    return deleted(old).unionByName(inserted(new))


class TokenLedger:
    """Totals by source, language and tokenizer version, kept as committed deltas under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _marker(self, batch_id: str) -> str:
        return f"{self.root}/commits/{hashlib.sha256(batch_id.encode()).hexdigest()}"

    def _claim(self, marker: str) -> dict:
        return json.loads(storage.contents(self.spark, f"{marker}/claim"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds signed ``changes(source, lang, tokenizer_version, sign, n_tokens)``; False if the batch was there."""
        marker = self._marker(batch_id)
        if storage.exists(self.spark, f"{marker}/claim"):
            return False
        delta = changes.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("d_docs"),
            F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("d_tokens"),
        )
        return self._publish(marker, delta)

    def _publish(self, marker: str, delta: DataFrame, **also: list[str]) -> bool:
        """Writes a delta and then its claim: the folder's name, and what else the claim is to say."""
        own = uuid.uuid4().hex
        delta.write.parquet(f"{self.root}/deltas/{own}")
        waiting = f"{self.root}/waiting/{own}"
        storage.create(self.spark, f"{waiting}/claim", json.dumps({"folder": own, **also}))
        storage.make_dir(self.spark, marker.rpartition("/")[0])
        if not storage.rename(self.spark, waiting, marker):
            storage.remove(self.spark, waiting)
        if self._claim(marker)["folder"] == own:
            return True
        storage.remove(self.spark, f"{self.root}/deltas/{own}")
        return False

    def _snapshot(self) -> tuple[int, dict]:
        """Number and claim of the newest snapshot."""
        names = storage.listed(self.spark, f"{self.root}/snapshots")
        if not names:
            return -1, {"batches": [], "replaced": []}
        return int(max(names)), self._claim(f"{self.root}/snapshots/{max(names)}")

    def _state(self) -> tuple[list[str], list[str]]:
        """Names of the folders to add up, and of the batches in them: the newest snapshot, and batches after it."""
        _, newest = self._snapshot()
        folders, held = [newest["folder"]] if "folder" in newest else [], set(newest["batches"])
        later = [n for n in sorted(storage.listed(self.spark, f"{self.root}/commits")) if n not in held]
        return folders + [self._claim(f"{self.root}/commits/{n}")["folder"] for n in later], sorted(held | set(later))

    def _deltas(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _DELTA)
        return self.spark.read.schema(_DELTA).parquet(*(f"{self.root}/deltas/{f}" for f in folders))

    def deltas(self) -> DataFrame:
        return self._deltas(self._state()[0])

    def compact(self) -> bool:
        """Sums what is committed into the next snapshot; False if another one was first."""
        number, before = self._snapshot()
        folders, batches = self._state()
        summed = self._deltas(folders).groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        done = self._publish(f"{self.root}/snapshots/{number + 1:012d}", summed.filter("d_docs <> 0 or d_tokens <> 0"), batches=batches, replaced=folders)
        if done:
            for f in before["replaced"]:  # what the snapshot before this one replaced
                storage.remove(self.spark, f"{self.root}/deltas/{f}")
        return done

    def totals(self) -> DataFrame:
        summed = self.deltas().groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0 or n_tokens <> 0")
