"""Personal data in whole texts, by DataFrame functions alone.

Regular expressions propose spans, checks confirm them (ranges, digit counts,
the Luhn sum, the remainder modulo 97), and words shortly before a span raise
its score.  Base kinds are reported at any score; social security numbers and
secrets (keys, tokens) only where such words stand before them.  No pattern takes more than linear time: starts inside a run that
has just failed are excluded, and what can't need backtracking is possessive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: int  # per cent, once valid
    context: str  # words that raise the score by CONTEXT_GAIN
    base: bool = True


CONTEXT_CHARS, CONTEXT_GAIN, LEAST_SCORE = 40, 20, 60
LEAST_MATCH = 5  # characters of the shortest match of any kind


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of 10."""
    d = F.reverse(digits(m))

    def add(total: Column, i: Column) -> Column:
        x = F.ascii(F.substr(d, i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.when(F.length(d).between(13, 19), F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0).otherwise(False)


def mod97(m: Column) -> Column:
    """15 to 34 characters that, the first four moved to the end and letters read as 10 to 35, leave 1 modulo 97."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    s = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(s, i, F.lit(1)))
        return F.when(c < 65, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.when(F.length(s).between(15, 34), F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add) == 1).otherwise(False)


#: Patterns, scores and context words.  A start inside a run is tried only where a match has just ended (\G).
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 80, "e-?mail|mail|contact|correo|courriel|kontakt"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"), 60, "ip|address|server|host|adresse|servidor"),
    Kind("card", r"(?=[0-9](?:[\x20-]?[0-9]){12})[0-9](?:[\x20-]?[0-9])++", luhn, 80, "card|visa|mastercard|credit|tarjeta|carte|karte"),
    Kind("phone", r"(?=\+[0-9](?:[\x20().-]*+[0-9]){8})\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(9, 15), 60, "phone|tel|call|mobile|telefon|tel[eéÉ]fono|t[eéÉ]l[eéÉ]phone"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[0-9]{1,3})?)(?![A-Za-z0-9])", mod97, 80, "iban|account|konto|compte|cuenta|bank", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 40, "ssn|social security|social-security", base=False),
    Kind("secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+", lambda m: (F.length(m) <= 128) & m.rlike("[0-9]") & m.rlike("[A-Za-z]"), 40, "tokens?|secrets?|api[ _-]?keys?|access[ _-]?keys?|private[ _-]?keys?|passwords?|passwd|credentials?", base=False),
)


def running_total(lengths: Column, block: int = 256) -> Column:
    """Prefix sums of an array, by blocks: an array that grows by appending costs its length each time."""
    fold = lambda xs, start: F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    part = lambda b: F.slice(lengths, b * block + 1, F.lit(block))
    numbers = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))
    before = fold(F.transform(numbers, lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: a + x)), F.lit(0))
    whole = F.flatten(F.transform(numbers, lambda b: F.slice(fold(part(b), F.get(before, b)), 2, block)))
    short = F.slice(fold(lengths, F.lit(0)), 2, block)
    return F.when(F.size(lengths) <= block, short).otherwise(whole)


def _pairs(found: Column, between: Column) -> Column:
    """Each match with its length, that of the text since the one before, and the ``CONTEXT_CHARS`` before it."""
    tail = lambda c: F.coalesce(F.right(c, F.lit(CONTEXT_CHARS)), F.lit(""))
    back = range(CONTEXT_CHARS // LEAST_MATCH, 0, -1)  # so many matches before it can lie in them

    def pair(m: Column, i: Column) -> Column:
        crowded = F.concat(*[tail(F.get(c, i - k)) for k in back for c in (between, found)], tail(F.get(between, i)))
        before = F.when(F.length(F.get(between, i)) >= CONTEXT_CHARS, tail(F.get(between, i))).otherwise(tail(crowded))
        return F.struct(m.alias("m"), F.length(m).alias("n"), F.length(F.get(between, i)).alias("gap"), before.alias("before"))

    return F.transform(found, pair)


def near(k: Kind, before: Column) -> Column:
    """Whether a context word, A-Z lower-cased, stands between others than letters a-z, digits and underscores."""
    return ascii_lower(before).rlike(f"(?:^|[^a-z0-9_])(?:{k.context})(?:[^a-z0-9_]|$)")


def _spans(k: Kind, pairs: Column, ends: Column) -> Column:
    """Array of (start, end, score) of the valid matches."""
    good = F.filter(F.arrays_zip(pairs.alias("p"), ends.alias("e")), lambda s: k.valid(s["p"]["m"]))
    score = lambda s: F.lit(k.score) + F.when(near(k, s["p"]["before"]), CONTEXT_GAIN).otherwise(0)
    out = F.transform(good, lambda s: F.struct((s["e"] - s["p"]["n"]).alias("start"), s["e"].alias("end"), score(s).alias("score")))
    none = F.array().cast("array<struct<start:int,end:int,score:int>>")
    return F.when(F.size(pairs) > 0, F.filter(out, lambda s: F.lit(True) if k.base else s["score"] >= LEAST_SCORE)).otherwise(none)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per document: spans of personal data by kind, as an array per kind.

    Spans are in code points, the end exclusive.  A null text is empty: no
    spans.  Ids are only carried along; repeated rows give repeated rows.  Only
    ``doc_id`` and ``text`` are read, nothing is shuffled, and a document's
    memory follows its own length.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("text"))
    # a cheap test of the whole text first: few texts have an @, a + or a digit
    sure = {"email": "@", "phone": "+"}
    test = lambda k: F.instr(F.col("text"), sure[k.name]) > 0 if k.name in sure else F.col("text").rlike("[0-9]")
    names = [k.name for k in kinds]
    # Step by step: an array that functions of its elements refer to is a column by then, made once.
    step = read.select("*", *[F.when(test(k), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"m_{k.name}") for k in kinds])
    step = step.select("doc_id", *[f"m_{n}" for n in names], *[F.when(F.size(f"m_{k.name}") > 0, F.split("text", k.pattern, -1)).alias(f"g_{k.name}") for k in kinds])
    step = step.select("doc_id", *[_pairs(F.col(f"m_{n}"), F.col(f"g_{n}")).alias(f"p_{n}") for n in names])
    step = step.select("*", *[F.transform(f"p_{n}", lambda p: p["gap"] + p["n"]).alias(f"l_{n}") for n in names])
    step = step.select("*", *[running_total(F.col(f"l_{n}")).alias(f"e_{n}") for n in names])
    return step.select("doc_id", *[_spans(k, F.col(f"p_{k.name}"), F.col(f"e_{k.name}")).alias(k.name) for k in kinds])


def report(docs: DataFrame) -> DataFrame:
    """Counts by base kind and of all spans, a digest of the base spans, all spans, and their scores."""
    found = find(docs)
    one = lambda k: F.transform(F.col(k.name), lambda s: F.concat(F.lit(f"{k.name}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    scored = lambda k: F.transform(F.col(k.name), lambda s: s["score"].cast("string"))
    base = [k for k in KINDS if k.base]
    join = lambda kinds, f=one: F.array_join(reduce(F.concat, map(f, kinds)), ",")
    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base]
    n_spans = reduce(lambda a, b: a + b, [F.size(k.name) for k in KINDS])
    return found.select("doc_id", *counts, n_spans.cast("long").alias("n_spans"), F.sha2(join(base), 256).alias("base_sha256"), join(KINDS).alias("spans"), join(KINDS, scored).alias("scores"))
