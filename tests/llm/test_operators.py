"""Each operator against a brute-force version, on the smallest tables and on rows made to be awkward."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parallaxis.llm import chat, components, decontaminate, jaccard_join, line_dedup, multi_index, packing, pii, queries, storage, token_counts, tokens, toxicity, warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
SPACE = "\x20\t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    long_line = "one very long line of words " * 4000
    rows = [
        (1, None, "en", "a", 7), (2, "", None, None, None), (3, "same line here\nand another one", "en", "a", 1),
        (4, "Same Line Here \nunlike any other", "en", "b", 2), (3, "same line here\nand another one", "en", "a", 1),
        (5, long_line, "en", "a", 3), (6, long_line + " end", "en", "a", 4), (None, "same line here", "en", None, 5),
        (7, "short\n\n\n  same line here  ", "de", "b", 6), (8, "x", "fr", "c", 7), (9, "\n", "fr", "c", 8),
        (10, "Ünïcödé lïnë hérè — ok\nsame  line here", "fr", "c", 9),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumn("key", F.lit("k")).withColumn("n", F.lit(3)).withColumn("_id", F.lit(4)).withColumn("hi", F.lit(1)).withColumn("score", F.lit(0.5))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def both(docs, awkward):
    return [docs.select("doc_id", "text", "lang", "source", "n_chars"), awkward]


# 1 -----------------------------------------------------------------------------------------------------------------


def nearest(rows, is_query, k):
    """Exact neighbours: largest inner product in double precision, ties to the smaller id."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in ok:
        if is_query(q):
            out[q] = sorted(((-float((x * y).sum()), i) for i, y in ok if i != q))[:k]
    return out


def test_multi_index_recall_and_scores(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    exact = nearest(rows, lambda i: i % 20 == 0, 20)
    got = defaultdict(list)
    for r in queries.op1_multi_index_search(spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    vec = {i: np.array(v, float) for i, v in rows}
    assert got.keys() == exact.keys()
    hits = 0
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(abs(r.score - float(vec[q] @ vec[r.vec_id])) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & {i for _, i in exact[q]})
    assert hits >= 0.9 * 20 * len(got)


def test_multi_index_awkward_vectors(spark):
    base = [1.0, 0.0, 0.5, 0.25]
    rows = [(i, base) for i in range(0, 60)] + [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 1.0, 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0, 1.0]), (105, []), (106, [1.0, 2.0]), (None, base), (7, base)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("asks", F.lit(1))
    got = multi_index.search(frame, F.col("vec_id") % 20 == 0, k=20).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append(r.vec_id)
    assert by[0] == [1, 2, 3, 4, 5, 6, 7, 7, *range(8, 20)]
    assert by[20][:3] == [0, 1, 2] and 100 not in by
    few = multi_index.search(frame.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, k=20)
    assert [r.vec_id for r in few.orderBy("rank").collect()] == [1, 2]
    assert multi_index.search(frame.limit(0), F.lit(True)).count() == 0


def test_multi_index_unequal_norms(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 7)) * rng.uniform(0.1, 5, size=(400, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    exact = nearest([(i, v.tolist()) for i, v in enumerate(x)], lambda i: i % 20 == 0, 10)
    got = defaultdict(set)
    for r in multi_index.search(frame, F.col("vec_id") % 20 == 0, k=10, block=64).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in e}) for q, e in exact.items()) >= 0.9 * 10 * len(exact)


# 2 -----------------------------------------------------------------------------------------------------------------


def lines_without_repeats(rows):
    key = lambda s: s.strip(SPACE).translate(ASCII_LOWER)
    small = lambda d: -(1 << 63) if d is None else d
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(small(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 2 and min(holders[key(x)]) != small(d))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark, docs, awkward):
    for frame in both(docs, awkward):
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(frame).collect()]
        assert sorted(got, key=repr) == lines_without_repeats([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])


def test_line_dedup_is_reversible(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    old, new = docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0")
    store = line_dedup.LineStore(spark, filter_keys=50, probe_rows=100).insert(old).insert(new).delete(docs.filter("doc_id % 5 = 1").select("doc_id"))
    left = docs.filter("doc_id % 5 <> 1")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in store.apply(left).collect()]
    assert sorted(got, key=repr) == lines_without_repeats([(d, t) for d, t in rows if d % 5 != 1])
    fresh = line_dedup.LineStore(spark).insert(left)
    as_set = lambda s: {(r.hi, r.lo, r.n_docs, r.first_doc, r.last_doc) for r in s.refs.collect()}
    assert as_set(store) == as_set(fresh)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(-(1 << 62), 1 << 62, (2, 20_000))
    own = line_dedup.CuckooFilter.sized(len(hi))
    assert own.insert(hi, lo) and own.contains(hi, lo).all()
    assert own.contains(*rng.integers(-(1 << 62), 1 << 62, (2, 20_000))).mean() < 0.01
    own.delete(hi[:5000], lo[:5000])
    assert own.contains(hi[5000:], lo[5000:]).all() and own.contains(hi[:5000], lo[:5000]).mean() < 0.01
    small = line_dedup.CuckooFilter(2)
    assert not small.insert(hi[:100], lo[:100])
    assert (line_dedup.CuckooFilter.load(own.dump()).table == own.table).all()


def test_line_dedup_empty(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


# 3 -----------------------------------------------------------------------------------------------------------------


def passes_luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(only(m)) <= 19 and passes_luhn(only(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(only(m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m.group())] for k, (p, ok) in kinds.items()}


PII_TEXTS = [
    "mail a.b+c@x-y.co.uk, a@b.c_d@e.f and a@b.c@d.e; x@y no; @z.com; a@b..c",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.0255 1.2.3 0000000000.1.1.1 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 11111111; 79927398713 5500005555555559 63040000000000000000",
    "+1 (415) 555-0100, +49 30 1234567. +12 +1-2 ++33 1 23 45 67 89) +123456789012345678",
    "é😀 x@y.zz 😀 +44 20 7946 0958 DE89370400440532013000 IBAN GB82WEST12345698765432 ssn 123-45-6789 and 123-45-6789",
    None, "", "9" * 4000, "1." * 3000, "a" * 3000 + "@b" + ".c" * 20_000, "x@y.z " * 3000,
]


def test_pii(spark, docs):
    extra = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(PII_TEXTS)], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(extra).withColumn("email", F.lit(1)).withColumn("spans", F.lit("x"))
    texts = {r.doc_id: r.text or "" for r in frame.select("doc_id", "text").collect()}
    seen = 0
    for r in pii.digest(pii.find_pii(frame)).collect():
        spans = base_spans(texts[r.doc_id])
        assert {k: r[f"n_{k}"] for k in spans} == {k: len(v) for k, v in spans.items()}, r.doc_id
        listed = [f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        found = [x for x in r.spans.split(",") if x]
        assert [x for x in found if x.split(":")[0] in spans] == listed
        seen += len(listed)
        if r.doc_id == 10_004:
            t = texts[r.doc_id]
            added = [t[int(x.split(":")[1]) : int(x.split(":")[2])] for x in found if x.split(":")[0] in ("iban", "ssn")]
            assert added == ["DE89370400440532013000", "GB82WEST12345698765432", "123-45-6789", "123-45-6789"]  # both numbers are within CONTEXT of the word
    assert seen > 3000


def test_pii_is_native(docs):
    plan = pii.digest(pii.find_pii(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_pii_empty(empty):
    assert pii.digest(pii.find_pii(empty)).count() == 0


# 4 -----------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in queries.op4_toxicity_scores(spark, sf_dir).collect()]
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.95
    assert np.mean([p for _, y, p in held if y]) > 0.85 and np.mean([p for _, y, p in held if not y]) < 0.02


def test_toxicity_locates_sentences(spark, awkward, empty):
    rng = random.Random(4)
    words = [a + b for a in "ka lo mi ne ru".split() for b in "ta so vi de".split()]
    sentence = lambda bad: " ".join(rng.choice(words) for _ in range(8)) + (" vilest" if bad else "")
    rows = []
    for k in range(300):
        bad = k % 3 == 0
        parts = [sentence(False) for _ in range(6)]
        if bad:
            parts[k % 6] = sentence(True)
        rows.append((k, ". ".join(parts), int(bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    for r in toxicity.score(frame, model, keep=("toxic",)).join(frame.select("doc_id", "text"), "doc_id").collect():
        assert (r.score > 0.5) == bool(r.toxic)
        assert ["vilest" in r.text[s.start : s.end] for s in r.offending] == [True] * r.toxic
    scored = toxicity.score(awkward.drop("score"), model)
    assert scored.count() == awkward.count() and scored.filter("score >= 0.3").count() == 0
    assert toxicity.score(empty, model).count() == 0
    one_class = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", F.lit(0).alias("toxic")))
    assert {r.score for r in toxicity.score(frame, one_class).collect()} == {0.0}
    assert toxicity.fit(frame, frame.select("doc_id", "toxic").limit(0)).constant == 0.0


def test_toxicity_of_long_clean_texts(spark):
    model = toxicity.NoisyOr({"=vilest": 14.0, "=clean": -1.0, "=sentence": 0.01}, toxicity.MAX_BIAS)
    clean = "a clean sentence. " * 100_000
    rows = [(1, clean), (2, clean + "the vilest words."), (3, clean.replace(". ", "\n")), (4, "the vilest words."), (5, None)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert max(got[k].score for k in (1, 3, 5)) == 0 and got[1].offending == got[3].offending == []
    assert got[2].score == got[4].score > 0.9 and [s.start for s in got[2].offending] == [len(clean) - 1]
    assert (got[1].n_sentences, got[3].n_sentences, got[5].n_sentences) == (100_001, 100_000, 1)


# 5 -----------------------------------------------------------------------------------------------------------------


def plain_tiles(a, b, shortest):
    """Greedy string tiling by its definition: mark the longest common unmarked string, first in a, then in b."""
    ua, ub, tiles = [x < 0 for x in a], [x < 0 for x in b], []
    while True:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ua[i + k] and not ub[j + k]:
                k += 1
            if k > best[2]:
                best = (i, j, k)
        i, j, k = best
        if k < shortest:
            return tiles
        ua[i : i + k] = ub[j : j + k] = [True] * k
        tiles.append(best)


def test_tiling_against_its_definition():
    rng = random.Random(2)
    for _ in range(150):
        a = [rng.randint(1, 4) for _ in range(rng.randint(0, 30))]
        b = [rng.choice([-1, 1, 2, 3, 4]) for _ in range(rng.randint(0, 40))]
        got, want = decontaminate.tile(a, b, 3), plain_tiles(a, b, 3)
        assert all(a[i : i + k] == b[j : j + k] and k >= 3 for i, j, k in got)
        assert len({x for i, _, k in got for x in range(i, i + k)}) == sum(k for _, _, k in got)
        assert len({x for _, j, k in got for x in range(j, j + k)}) == sum(k for _, _, k in got)
        assert (max((k for _, _, k in got), default=0), bool(got)) == (max((k for _, _, k in want), default=0), bool(want))
        assert sum(k for _, _, k in got) >= 0.6 * sum(k for _, _, k in want)


def test_decontamination(spark, awkward, docs, sf_dir):
    item = "the quick brown fox jumps over a lazy dog while seven wizards mix potions under old stone bridges at dawn"
    w = item.split()
    moved = " ".join([*w[12:], "pause", *w[:6], "and so", *w[6:12]])
    rows = [(1, f"before {item.upper()} after"), (2, moved), (3, " ".join(w[:6]) + " other words follow here"), (4, None), (5, ""), (6, "x " * 50_000 + item), (7, " ".join(sorted(w))), (1, item)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("coverage", F.lit(1))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "too short"), (4, "")], "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in decontaminate.contaminated(frame, bench).collect())
    assert got == [(1, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (6, 1, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.clean(frame, bench).collect()) == [3, 4, 5, 7]
    assert decontaminate.contaminated(frame, bench, block_chars=40).count() == 4
    assert decontaminate.contaminated(awkward, bench.limit(0)).count() == 0
    real = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, real).collect()}
    items = {r.item_id: re.findall(r"\w+", r.text.lower()) for r in real.collect()}
    want = set()
    for r in docs.collect():
        t = " ".join(re.findall(r"\w+", r.text.lower()))
        want |= {(r.doc_id, i) for i, x in items.items() if f" {' '.join(x)} " in f" {t} "}
    assert want and want <= found
    assert decontaminate.contaminated(docs.limit(0), real).count() == 0


# 6 and 10 ----------------------------------------------------------------------------------------------------------


def test_word_encoder_equals_the_tokenizer():
    own = tokens.WordEncoder(tokens.default_vocabulary(), cache_bytes=60_000)
    rng = random.Random(5)
    parts = [*"abAB éÉßΣσİıǅ,.'s<|>endoftext  \t\n\x1c\x85\xa0　́̀½²٣日本ﬁKÅ😀-—ªº", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "'S", "don't ", "Don'T, "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want and own.encode([None, ""]) == [b"", b""]


def test_word_encoder_hands_over_many_words_at_once():
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.given = tokenizer, 0

        def encode_batch_fast(self, texts, **how):
            self.given += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **how)

    own = tokens.WordEncoder(tokens.default_vocabulary(), cache_bytes=60_000)
    rng = random.Random(6)
    endings = ["", "", ",", ".", ".%%%", "!!", "&&&", "'", "<", "\u0301", "\u0301.", "\u0338"]
    words = ["".join(rng.choice("abcdeéßÉÀ") for _ in range(rng.randint(3, 9))) + rng.choice(endings) for _ in range(6000)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 6000, 100)] + ["ÀÉ. × µ! ªº, İ. Σ. ΑΣ, ǅ. Å. क़. क़, </w> a</w> ﬁ."]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    odd = len([w for w in words if w[-1] in "'<\u0301\u0338" or w.endswith("\u0301.")])
    own.bare, own.tokenizer = Counted(own.bare), Counted(own.tokenizer)
    assert own.encode(texts) == want
    assert own.bare.given + own.tokenizer.given < odd + 60 < 3000


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_vocabulary())


def check_packing(rows, texts, tokenizer, window=4096):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert sum(r.length for r in pieces) <= window and all(r.length > 0 for r in pieces)
    ids_of = defaultdict(list)
    for d, t in texts:
        ids_of[d].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    assert by_doc.keys() == ids_of.keys()
    for d, copies in ids_of.items():
        assert sum(r.length for r in by_doc[d]) == sum(map(len, copies))
        for r in by_doc[d]:
            assert any(r.doc_tokens == len(c) and r.ids_crc32 == zlib.crc32(c[r.start : r.start + r.length].tobytes()) for c in copies)
        if len(copies) == 1:
            got = sorted((r.start, r.length) for r in by_doc[d])
            assert [a for a, _ in got] == [0, *np.cumsum([n for _, n in got])[:-1]]
    lengths = [sum(r.length for r in p) for p in by_sequence.values()]
    assert all(n == window or n & (n - 1) == 0 for n in lengths)
    return by_sequence


def test_packing(docs, awkward, tokenizer):
    for frame in both(docs, awkward):
        texts = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        check_packing(packing.pack(frame).collect(), texts, tokenizer)
        check_packing(packing.pack(frame, block_tokens=5000, window=512).collect(), texts, tokenizer, 512)


def test_packing_keeps_the_mixture(spark, tokenizer):
    rows = [(k, "word " * (40 + k % 7), "ab"[k % 2] if k % 10 else "c") for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = packing.pack(frame, block_tokens=20_000, window=1024, with_ids=True)
    got = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), *(F.sum(F.when(F.col("source") == s, F.col("length")).otherwise(0)).alias(s) for s in "abc")).filter("n = 1024").toPandas()
    total = pieces.groupBy("source").agg(F.sum("length").alias("n")).toPandas().set_index("source")["n"]
    for s in "abc":
        want = total[s] / total.sum()
        assert abs(got[s].sum() / got["n"].sum() - want) < 0.02
        assert ((got[s] / 1024 - want).abs() < 0.15).mean() > 0.8
    assert pieces.filter(F.octet_length("ids") != 4 * F.col("length")).count() == 0


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


def test_capacities():
    assert packing.capacities(4096 * 2 + 1000, 4096) == [4096, 4096, 512, 256, 128, 64, 32, 8]
    assert packing.capacities(0, 4096) == []


def test_token_counts(spark, docs, awkward, empty, tokenizer):
    vocab = {"v1": tokens.default_vocabulary(), None: tokens.default_vocabulary()}
    vocab.pop(None)
    for frame in both(docs, awkward):
        ledger = token_counts.TokenLedger(spark, storage.scratch(spark, "ledger"))
        counts = token_counts.count_tokens(frame, vocab)
        assert ledger.totals().count() == 0
        assert ledger.commit("first", token_counts.inserted(counts)) and not ledger.commit("first", token_counts.inserted(counts))
        want = defaultdict(lambda: [0, 0])
        for r in frame.select("source", "lang", "text").collect():
            cell = want[r.source, r.lang, "v1"]
            cell[0] += 1
            cell[1] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        as_dict = lambda: {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in ledger.totals().collect()}
        assert as_dict() == want
        gone = counts.filter("doc_id % 2 = 0")
        assert ledger.commit("second", token_counts.deleted(gone))
        assert ledger.commit("third", token_counts.revised(counts.filter("doc_id = 3"), counts.filter("doc_id = 3").withColumn("n_tokens", F.col("n_tokens") + 5)))
        n3 = frame.filter("doc_id = 3").count()
        assert sum(t for _, t in as_dict().values()) == sum(r.n_tokens for r in counts.filter("doc_id is null or doc_id % 2 <> 0").collect()) + 5 * n3
        assert ledger.commit("fourth", token_counts.inserted(counts.limit(0)))
        assert ledger.commit("fifth", token_counts.inserted(gone)) and sum(n for n, _ in as_dict().values()) == frame.count()


# 7 -----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    evil = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 5
    extra = [(9001, "http://a.example/x y\r\nWARC-Type: evil", evil), (9000, None, evil), (9003, "http://a.example/", None), (9002, "HTTP://WWW.A.example:80/?q=1#f", ""), (9004, "http://[bad", "é" * 60), (9005, "u", "é" * 60), (9006, "u", "z" * 99), (9007, "u", "z" * 99), (9008, "u", "big" * 400_000), (9008, "u", "big" * 400_000), (9009, "u", "big" * 400_000), (None, "u", "big" * 400_000), (None, "n", "only")]
    frame = pages.unionByName(spark.createDataFrame(extra, pages.schema)).withColumn("digest", F.lit("x")).withColumn("n", F.lit(0))
    rows = [(r.page_id, (r.html or "").encode()) for r in frame.collect()]
    first = {}
    for p, b in rows:
        if p is not None:
            first[b] = min(first.get(b, p), p)
    want = []
    for p, b in rows:
        again = len(b) >= 100 and b in first and first[b] != p
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    got = warc.round_trip(frame).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.payload_intact for r in got)
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.key_range, r.place))]
    assert order == sorted(order)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(8)
    for k in range(0, 12):
        runs = [sorted((rng.randint(0, 9), rng.randint(0, 3)) for _ in range(rng.randint(0, 15))) for _ in range(k)]
        got = [runs[r][i] for r, i in warc.LoserTree(runs)]
        assert got == sorted(itertools.chain(*runs))


# 8 -----------------------------------------------------------------------------------------------------------------


def conversation_digests(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    long_ = [(-5, k, ["system", "user", "assistant"][0 if k == 0 else 1 + k % 2], "word " * (k * 37 % 900)) for k in range(120)]
    odd = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (-2, None, None, None), (-2, 1, "assistant", "a\\b<\\p<|\\n\\"), (-2, 1, "assistant", "a\\b<\\p<|\\n\\"), (-3, 0, "ro\nle<|", ""), (None, 2, "assistant", "x"), (-4, 0, "system", "only the system"), (-6, 0, "assistant", "y" * 100_000), (-6, 1, "system", "late"), (-6, 2, "assistant", "<")]
    frame = real.unionByName(spark.createDataFrame(long_ + odd, real.schema)).withColumn("window", F.lit(1)).withColumn("tokens", F.lit(2))
    for budget, history in ((2048, 512), (300, 100)):
        made = chat.windows(frame, budget, history)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made).collect()}
        assert got == conversation_digests([(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()])
        for r in made.filter("conv_id = -5").collect():
            assert r.formatted.startswith("<|im_start|>system\n")
            turns = r.formatted.count("<|im_start|>")
            assert r.n_tokens <= budget or turns - r.n_repeated == 1
        assert made.filter("conv_id = -5 and n_repeated > 1").count() > 3
    assert chat.read_back(chat.windows(frame.limit(0))).count() == 0
    plan = chat.read_back(chat.windows(real))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


# 9 -----------------------------------------------------------------------------------------------------------------


def near_groups(rows, words, num, den):
    split = [(d, [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER)) if x]) for d, t in rows]
    sets = [frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []) for _, w in split]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("frequent", [0, 2, 64])
def test_jaccard_join(docs, awkward, frequent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    for frame, words, num in ((docs, 4, 85), (awkward, 5, 80)):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame, words, num, 100).collect()]
        assert sorted(got, key=repr) == near_groups([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()], words, num, 100)


def test_jaccard_join_near_copies_and_shared_passages(spark, monkeypatch):
    """A chain of near copies, and short texts dominated by one common passage: dense and combined signatures."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 5)
    monkeypatch.setattr(jaccard_join, "COMBINED", 6)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage, base = [word() for _ in range(60)], [word() for _ in range(90)]
    rows = []
    for k in range(90):
        base = list(base)
        base[rng.randrange(90)] = word()
        rows.append((k, " ".join(base)))
    for k in range(90, 190):
        rows.append((k, " ".join([*(word() for _ in range(k % 25)), *passage, *(word() for _ in range(k % 7))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for words, num in ((4, 85), (2, 90), (5, 80)):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame, words, num, 100).collect()]
        assert sorted(got, key=repr) == near_groups(rows, words, num, 100)


def test_jaccard_join_names_no_pairs_of_long_texts_that_do_not_link(spark, monkeypatch):
    """Long texts that share half of their words meet in many signatures, and digests of one length let all pairs pass."""
    rng = random.Random(5)
    shared = [f"s{k}" for k in range(900)]
    rows = [(d, " ".join(shared + [f"w{rng.randrange(10**9)}" for _ in range(700)])) for d in range(60)]
    rows += [(100 + d, rows[d][1] + " more") for d in range(0, 60, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    named, materialize = [], storage.materialize

    def counted(df, label):
        out = materialize(df, label)
        if out.columns == ["a", "b"]:
            named.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "FREQUENT", 100)
    monkeypatch.setattr(storage, "materialize", counted)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame, 4, 85, 100).collect()]
    assert sorted(got, key=repr) == near_groups(rows, 4, 85, 100)
    assert max(named[6:]) <= len(rows)  # three tables of pairs for each of the first two rounds


def test_packing_tokenizes_few_documents_at_once(spark, monkeypatch):
    """Batches of 10,000 texts stood beside the cached chunks, on both sides of the pipe."""
    blocks, most = packing._blocks, 512

    def watched(*args):
        def run(batches):
            def seen():
                for b in batches:
                    assert b.num_rows <= most
                    yield b

            return blocks(*args)(seen())

        return run

    monkeypatch.setattr(packing, "_blocks", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    frame = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"), F.lit("s").alias("source"))
    got = packing.pack(frame).agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert got == (3000 * 4, 3000)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_bitmaps_differ_as_pair_by_pair():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (2, 2, 30, 31, 40, 200, 1500, 1501, 9000)]
    maps = [jaccard_join.parity_bitmap(s) for s in sets]
    x, y = (k.ravel() for k in np.meshgrid(np.arange(len(maps)), np.arange(len(maps))))
    assert jaccard_join.Bitmaps(maps).apart(x, y).tolist() == [jaccard_join.bitmap_difference(maps[a], maps[b]) for a, b in zip(x, y)]


def test_jaccard_join_empty(empty):
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}
