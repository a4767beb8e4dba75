"""Personal data spans from regular expressions, checksum validators and context words, in SQL functions only.

For each kind a pattern proposes leftmost non-overlapping spans. Splitting the text at the pattern gives what lies
between the spans, so their places are prefix sums of lengths in code points. Validators confirm or drop a span
(Luhn for cards, mod-97 for IBANs, ranges for addresses, digit counts for phones). A validator raises a span's score,
and so does a context word, in one of four languages, that stands by itself in the ``CONTEXT`` code points on either
side of it. Kinds of the base set are kept whatever their score; the added kinds, IBANs (as one word or in groups of
four) and social security numbers, are kept at ``THRESHOLD`` or more.

A pattern's matches split the text, and context is put together again from as many of the neighbouring matches, and
what lies between them, as ``CONTEXT`` code points can hold; so it costs the same however long the text is.

Patterns are written so that matching is linear: possessive loops, and starts only at the edge of a run of the
characters that the pattern begins with, or where the last match ended.

The plan is one projection: no shuffle, nothing that grows beyond one text.

Edge cases: a null or empty text has no spans; equal rows give equal rows; an empty table gives an empty result;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
THRESHOLD = 0.8

LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){1,2}(?:\x20[0-9]{4}){1,5}(?:\x20[0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Context words in English, German, French and Spanish, in lower case.
WORDS = {
    "email": "e-?mails?|contact|write to|reach|kontakt|courriel|correo",
    "ip": "ip|address|hosts?|servers?|adresse|rechner|serveur|direcci.n|servidor",
    "card": "cards?|visa|master|mastercard|credit|payment|kreditkarte|karte|carte|tarjeta",
    "phone": "phone|telephone|tel|calls?|mobile|fax|telefon|handy|t.l.phone|tel.fono|m.vil",
    "iban": "iban|accounts?|bank|transfer|konto|.berweisung|compte|virement|cuenta|banco",
    "ssn": "ssn|social security",
}
#: Code points of a kind's shortest match, valid or not.
SHORTEST = {"email": 5, "ip": 7, "card": 2, "phone": 4, "iban": 15, "ssn": 11}
#: Score of a proposed span, and what a passed validator adds; a context word adds CONTEXT_GAIN.
PROPOSED, CONFIRMED, CONTEXT_GAIN = 0.4, 0.4, 0.2
BASE = ("email", "ip", "card", "phone")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: as a lambda's variable it is not an expression to repeat."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_sums(values: Column) -> Column:
    """Running sums of an int array, in chunks of about the square root of its length."""

    def chunked(v: Column) -> Column:
        n = F.size(v)
        w = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.ceil(n / w).cast("int") - 1), lambda c: F.slice(v, c * w + 1, w))

    def bases(chunks: Column) -> Column:
        return F.aggregate(F.transform(chunks, _sum), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def within(chunks: Column, at: Column) -> Column:
        running = lambda chunk, c: let(F.get(at, c), lambda base: F.transform(chunk, lambda _, i: base + _sum(F.slice(chunk, F.lit(1), i + 1))))
        return F.flatten(F.transform(chunks, running))

    summed = lambda v: let(chunked(v), lambda chunks: let(bases(chunks), lambda at: within(chunks, at)))
    return let(values, lambda v: F.when(F.size(v) > 0, summed(v)).otherwise(F.array().cast("array<int>")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(value)

    def one(i: Column) -> Column:
        d = F.substr(value, n - i + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, doubled).otherwise(d)

    return _sum(F.transform(F.sequence(F.lit(1), n), one)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's rearranged digits leave 1 modulo 97."""
    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code <= 57, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    turned = F.concat(F.substr(value, F.lit(5)), F.substring(value, 1, 4))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return F.when(F.length(bare) > 3, False).when(F.length(bare) == 0, True).otherwise(bare.cast("int") <= 255)

    return F.forall(F.split(value, r"\."), small)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": lambda m: let(digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)),
    "phone": lambda m: F.length(digits(m)).between(8, 15),
    "iban": lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))),
    "ssn": lambda m: ~(F.substring(m, 1, 3).isin("000", "666") | m.startswith("9") | (F.substring(m, 5, 2) == "00") | (F.substring(m, 8, 4) == "0000")),
}


def alone(words: str) -> str:
    """A pattern for the words where no letter from a to z is beside them, in any dialect."""
    return f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"


def spans(text: Column, kind: str) -> Column:
    """array<struct<start int, end int, score double>> of a kind's spans, in code points, end exclusive."""
    pattern = PATTERNS[kind]
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    none = F.array().cast("array<struct<start:int,end:int,score:double>>")
    near = -(-CONTEXT // SHORTEST[kind])

    def located(pieces: Column, matches: Column) -> Column:
        before = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.concat(p, m))
        after = F.zip_with(matches, F.slice(pieces, F.lit(2), F.size(matches)), lambda m, p: F.concat(m, p))
        ends = prefix_sums(F.transform(before, lambda x: F.length(x)))

        def one(x: Column, i: Column, before: Column, after: Column) -> Column:
            left = F.concat(F.array_join(F.slice(before, F.greatest(F.lit(1), i - near + 1), F.least(i, F.lit(near))), ""), F.get(pieces, i))
            right = F.concat(F.get(pieces, i + 1), F.array_join(F.slice(after, i + 2, F.lit(near)), ""))
            return F.struct((x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), x["m"].alias("m"), F.right(left, F.lit(CONTEXT)).alias("left"), F.left(right, F.lit(CONTEXT)).alias("right"))

        return let(before, lambda b: let(after, lambda a: F.transform(F.arrays_zip(matches.alias("m"), ends.alias("e")), lambda x, i: one(x, i, b, a))))

    # binding both arrays to lambda variables makes each pattern run once over the text
    bound = let(pieces, lambda p: let(matches, lambda m: located(p, m)))
    kept = F.filter(bound, lambda s: VALID[kind](s["m"]))

    def scored(s: Column) -> Column:
        beside = F.lower(F.concat_ws(" ", s["left"], s["right"]))
        sure = PROPOSED + (CONFIRMED if kind in ("card", "iban", "ip", "phone") else 0.2)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(beside.rlike(alone(WORDS[kind])), min(1.0, sure + CONTEXT_GAIN)).otherwise(sure).alias("score"))

    found = F.transform(kept, scored)
    if kind not in BASE:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    tried = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(tried, found).otherwise(none)


def _listed(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id and an array of scored spans for each kind."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", *(spans(text, kind).alias(kind) for kind in PATTERNS))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    base = F.array_join(F.concat(*map(_listed, BASE)), ",")
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.concat(*map(_listed, PATTERNS)), ",").alias("spans"),
        F.array_join(F.transform(F.flatten(F.array(*(F.transform(F.col(k), lambda s: s["score"]) for k in PATTERNS))), lambda x: F.format_number(x, 2)), ",").alias("scores"),
    )
