"""Spelling variants against a plain count and all deletions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from parallaxis.llm import queries, spelling

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    c = Counter()
    for d, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = r.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            c[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_definition(words):
    near, hole = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            hole[k, w[:k] + w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in hole.values():
        for a in group:
            near[a] |= group - {a}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return sorted(out, key=repr)


def test_query_by_definition(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op13_spelling_variants(spark, sf_dir)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    want = by_definition(counted(rows))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(w[1] for w in want) and any(w[1] != w[2] for w in want if w[1])


def test_pairs_of_all_edits(spark):
    """Every place of an edit, few letters, lengths from one on; each pair once."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("aébß", k=rng.randint(1, 12))) for _ in range(700)})
    words = sorted({*words, *(w[:k] + x + w[k + cut :] for w in words[::6] for k in range(len(w)) for x in ("", "a", "ÿ") for cut in (0, 1))} - {""})
    frame = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long")
    got = [(r.a, r.b) for r in spelling.near_pairs(frame).select("a", "b").collect()]
    assert len(got) == len(set(map(frozenset, got)))
    assert set(map(frozenset, got)) == {frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) <= 1 and one_edit(a, b)}
    assert all(len(a) <= len(b) for a, b in got)


def test_awkward_texts(spark):
    rows = [
        (1, None), (2, ""), (None, "apples APPLES Apples"), (3, "apples appless appless appless"), (3, "apples appless appless appless"), (4, "1234 -- !!"),
        (5, "ÀPPLES ÀPPLES ÀPPLES àpples"), (6, "lonely lonely lonely"), (7, "x" * 700_000 + " " + "apples " * 300_000), (8, "tiny tiny tiny tiny\x00tiny"), (9, "naïve naive " * 5),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(3)).withColumn("length", F.lit(None).cast("int"))
    got = spelling.spelling_variants(frame).collect()
    assert sorted(map(tuple, got), key=repr) == by_definition(counted(rows))


def test_ties_and_long_chains(spark):
    """Forms are followed through several words; of near words with equal counts the smallest is the form."""
    chain = [("abcdef" + "g" * k, 3**k) for k in range(1, 14)]
    words = dict([*chain, ("tiesa", 10), ("tiesb", 10), ("tiesc", 4), ("alone", 7)])
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(map(tuple, spelling.variants(frame).collect()), key=repr)
    assert got == by_definition(words)
    assert ("tiesc", "tiesa", "tiesa", 4, 2, 10) in got and next(r for r in got if r[0] == "abcdefg")[2] == chain[-1][0]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(none).collect() == []
