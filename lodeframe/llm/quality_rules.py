"""Quality rules: each document's own, and verdicts on hosts from their documents' failures.

Failures are counted by host (``source``).  Small hosts have noisy rates, so a
host's rate is shrunk towards all hosts' by a beta prior.  Its parameters are
the beta-binomial moments of the hosts, weighted by their documents, less the
noise that small hosts' rates would show even if all hosts were alike.  A host
whose shrunk rate is too high is rejected with all its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, Scratch

WORD = f"[^{WORD_SPACE}]"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 20  # symbols to words
    max_dup_line_percent: int = 50
    word_chars: tuple[int, int] = (2, 14)  # mean length of a word
    soft_failures: int = 2  # of the last three rules, to reject a document
    host_rate: float = 0.6  # shrunk failure rate above which a host is rejected


def features(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, ``carry`` and the base counts of each whole text; in-row, without a shuffle.

    ``n_repeat_words`` compares 3-word windows by 64-bit hashes: they are sorted
    with their positions, equal neighbours mark a repeat, and the covered words
    follow from the gaps of the marked positions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = ["doc_id", *carry]
    step = docs.select(*keep, text.alias("text"))
    step = step.select(
        *keep,
        F.regexp_extract_all("text", F.lit(f"{WORD}+"), F.lit(0)).alias("words"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
    )
    word = lambda i: F.get(F.col("words"), i)
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    keep += ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    step = step.select(
        *keep[: len(keep) - 5],
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, windows).otherwise(F.array().cast("array<long>")).alias("windows"),
    )
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    step = step.select(*keep, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).alias("placed"))
    same = lambda x, other: F.coalesce(x["h"] == F.get(F.col("placed"), other)["h"], F.lit(False))
    marked = F.filter("placed", lambda x, i: same(x, i - 1) | same(x, i + 1))
    step = step.select(*keep, F.sort_array(F.transform(marked, lambda x: x["at"])).alias("at"))
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("at"), i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return step.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed(limits: Limits = Limits()) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def soft_failures(limits: Limits = Limits()) -> Column:
    low, high = limits.word_chars
    rules = [
        100 * F.col("n_symbols") > limits.max_symbol_percent * F.col("n_words"),
        100 * F.col("n_dup_lines") > limits.max_dup_line_percent * F.col("n_lines"),
        (F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words")),
    ]
    return sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))


def shrunk_rates(judged: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """host, n_docs, n_failed, host_rate: the mean of the beta posterior.

    With m the share of all documents that fail, hosts that all fail at rate m
    have an expected sum of n_docs * (rate - m)^2 / (m (1 - m)) of one less than
    their number.  What the sum has beyond that, divided by the most it could
    have, is the correlation c of failures within hosts, and the prior's weight
    is 1 / c - 1.  Where nothing is beyond it, as with one document a host or
    the same rate everywhere, the rate is m.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    n, bad = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    count, docs, failed, squares, spread = hosts.agg(F.count(F.lit(1)), F.sum("n_docs"), F.sum("n_failed"), F.sum(n * n), F.sum(bad * bad / n)).first()  # one row
    if not docs:
        return hosts.withColumn("host_rate", F.lit(None).cast("double"))
    m = failed / docs
    most = docs - squares / docs - (count - 1)
    beyond = (spread - docs * m * m) / (m * (1 - m)) - (count - 1) if 0 < failed < docs else 0.0
    if most <= 0 or beyond <= 0:
        return hosts.withColumn("host_rate", F.lit(m))
    weight = 1 / min(1.0, beyond / most) - 1
    return hosts.withColumn("host_rate", (F.col("n_failed") + m * weight) / (F.col("n_docs") + weight))


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: base counts, whether a base rule failed, the host's shrunk rate, and the verdict.

    Kept are documents without a base failure and with fewer than
    ``soft_failures`` others, on hosts whose shrunk rate is at most
    ``host_rate``.  A null text has no words (base failure); documents with a
    null ``source`` are one host.  Ids are only carried along, so repeated rows
    are judged each and counted each; an empty table gives no rows.  A very long
    text takes memory for its words and windows, in its own row.

    The texts are read once; the counts are stored, aggregated by host with
    partial sums, and joined with the hosts' verdicts.  Spark broadcasts the
    hosts only below its size threshold and splits a frequent host otherwise.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    counts = features(docs.withColumn("host", F.col("source").cast("string")) if "host" not in docs.columns else docs.drop("host").withColumn("host", F.col("source").cast("string")), "host")
    counts = counts.withColumn("base_failed", base_failed(limits)).withColumn("soft", soft_failures(limits))
    judged = scratch.write(counts.withColumn("failed", F.col("base_failed") | (F.col("soft") >= limits.soft_failures)), "counts")
    hosts = shrunk_rates(judged, limits).select(F.col("host").alias("__host"), "host_rate")
    both = judged.join(hosts, judged["host"].eqNullSafe(hosts["__host"])).drop("__host")
    return both.withColumn("kept", ~F.col("failed") & (F.col("host_rate") <= limits.host_rate))


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that are kept, all columns as they were.

    The counts are made once: a row that passes its own rules is stored with its
    host, and one that fails as its host alone, so verdicts need no ids and
    texts that go anyway aren't stored.  Only host names and rates meet in a join.
    """
    names = docs.columns
    at = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in names])).select("__row", *[F.col(f"`{c}`") for c in ("doc_id", "text")], F.col("source").cast("string").alias("host"))
    counts = features(at, "host", "__row").withColumn("failed", base_failed(limits) | (soft_failures(limits) >= limits.soft_failures))
    judged = Scratch(docs.sparkSession, "quality").write(counts.select("host", "failed", F.when(~F.col("failed"), F.col("__row")).alias("__row")), "judged")
    bad = shrunk_rates(judged.select("host", "failed"), limits).where(F.col("host_rate") > limits.host_rate).select(F.col("host").alias("__host"))
    return judged.where(~F.col("failed")).join(bad, F.col("host").eqNullSafe(F.col("__host")), "left_anti").select("__row.*")
