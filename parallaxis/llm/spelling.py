"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word of length l is indexed under its two segments, the first l // 2 code points and the rest. One edit leaves one
of the two as it is, so a word of the same length, or one longer, has that segment as a substring: the first at its
own place, the second moved by the difference of the lengths. Short segments are shared by very many words, so the
segment that holds the edit is halved by the same rule, and the half that stays is part of the key: four keys for each
indexed word, eight for each probing one, and no word is compared with all that share a common beginning. A pair that
meets under several keys counts at the first of them, and is then verified.

Words come from running texts: letters in maximal runs, A-Z lower-cased, counted per block of documents before
anything is shuffled. A word's form is its near word of largest count (ties: smallest in code-point order) if that is
``ratio`` times its own at least; forms are followed to the last by pointer jumping, each round written to the shared
folder.

Edge cases: a null or empty text has no words; very long texts are cut between runs, never within one; repeated rows
count again; a null id is an empty string before the colon; no words give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxis.llm import storage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
MIN_LENGTH, MIN_COUNT, RATIO, TYPO_IN = 5, 3, 2, 97
#: Code points that are split at once, different words that a task counts before it passes them on, and rows of a batch.
PIECE, KEPT, BATCH_ROWS = 1 << 19, 200_000, 1_000


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE code points that end between runs."""
    at = 0
    while at < len(text):
        end = at + PIECE
        found = _BREAK.search(text, end) if end < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _counted(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                whole = text.as_py()
                if not whole:
                    continue
                # only A-Z have another lower case among single bytes
                lower = whole.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                prefix = f"{'' if not doc.is_valid else doc.as_py()}:".encode()
                start = zlib.crc32(prefix)
                for piece in _pieces(lower):
                    for word, n in Counter(RUN.findall(piece)).items():
                        if len(word) < min_length:
                            continue  # a deletion makes none longer
                        h = zlib.crc32(word.encode(), start)
                        if h % TYPO_IN == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < min_length:
                                continue
                        seen[word] += n
                if len(seen) > KEPT:
                    yield out()
        if seen:
            yield out()

    return run


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of ``docs(doc_id, text)`` with their number of occurrences, written to the shared folder."""
    with storage.arrow_rows(docs.sparkSession, BATCH_ROWS):
        counted = docs.select("doc_id", "text").mapInArrow(_counted(min_length), "word string, n long")
        return storage.materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "words")


def _left(word: Column, n: Column) -> Column:
    return F.substring(word, F.lit(1), n)


def _right(word: Column, n: Column) -> Column:
    return F.substring(word, F.length(word) - n + 1, n)


def _keys(word: Column, length: Column) -> list[tuple[Column, Column]]:
    """(beginning, end) that a word shares with an indexed word of ``length``, for each of the four places of an edit.

    The edit is in the second half of the second segment, the first half of it, the second half of the first segment,
    or the first half of that.
    """
    first = F.floor(length / 2)
    second = length - first
    none = F.lit("")
    return [
        (_left(word, first + F.floor(second / 2)), none),
        (_left(word, first), _right(word, second - F.floor(second / 2))),
        (_left(word, F.floor(first / 2)), _right(word, second)),
        (none, _right(word, first - F.floor(first / 2) + second)),
    ]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of different ``words(word, n)`` one edit apart, each once; a is not the longer one.

    Words are taken to differ from each other, as those of ``vocabulary`` do.
    """
    sized = words.select("word", "n", F.length("word").alias("length")).filter("length > 0")

    def keyed(frame: DataFrame, length: Column) -> DataFrame:
        keys = [F.struct(F.lit(k).alias("kind"), b.alias("beginning"), e.alias("end")) for k, (b, e) in enumerate(_keys(F.col("word"), length))]
        return frame.select("word", "n", length.cast("int").alias("l"), F.explode(F.array(*keys)).alias("key")).select("word", "n", "l", "key.*")

    index = keyed(sized, F.col("length")).select("l", "kind", "beginning", "end", F.col("word").alias("a"), F.col("n").alias("n_a"))
    same, longer = keyed(sized, F.col("length")), keyed(sized.filter("length > 1"), F.col("length") - 1)
    probe = same.unionByName(longer).select("l", "kind", "beginning", "end", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = index.join(probe, ["l", "kind", "beginning", "end"])
    met = met.filter((F.length("b") > F.col("l")) | (F.col("a") < F.col("b")))
    # of the keys under which a pair meets, the first
    agree = [(p[0] == q[0]) & (p[1] == q[1]) for p, q in zip(_keys(F.col("a"), F.col("l")), _keys(F.col("b"), F.col("l")))]
    earlier = F.lit(False)
    for k in range(3):
        earlier = earlier | ((F.col("kind") > k) & agree[k])
    return met.filter(~earlier).filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) of ``forms(word, form)``: forms followed to the last, twice as far each round."""
    up = storage.materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = storage.materialize(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        storage.drop(up)
        up = stepped
        if up.filter("moved").isEmpty():
            return up.select("word", "root")
    raise RuntimeError(f"forms were not followed to the end in {max_rounds} rounds")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every one of ``words(word, n)``."""
    pairs = storage.materialize(near_pairs(words), "near-words")
    a, b = F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    near = pairs.select(F.explode(F.array(a, b)).alias("p")).select("p.*")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    has = -F.col("best.less") >= ratio * F.col("n")
    formed = storage.materialize(joined.select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n")
    ), "forms")
    roots = _roots(formed.filter("form is not null"))
    storage.drop(pairs)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs(doc_id, text)``."""
    return variants(vocabulary(docs, min_length, min_count), ratio)
