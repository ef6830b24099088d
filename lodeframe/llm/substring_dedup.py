"""Substring removal by hashing of normalised units: lines, and the sentences inside them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows

#: Spans are start:end of the original text in code points, comma-joined.
REPORT = "n_units int, n_removed_units int, n_removed_chars int, removed_spans string, kept_text string"

#: A unit ends after a line feed, or after a blank that follows the end of a sentence.
UNIT_END = r"(?<=\n)|(?<=[.!?][ \t])"


def units(text: Column) -> Column:
    """The text cut into units; joined again they are the text."""
    return F.split(F.coalesce(text, F.lit("")), UNIT_END, -1)


def normalised(unit: Column) -> Column:
    """Lower case, each run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(unit), r"\s+", " "))


def repeats(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """(doc_id, at) of each unit of ``min_words`` or more that occurs earlier, by doc_id and place.

    The units' digests are stored: texts are cut once, and the join with each
    digest's first place can split a frequent digest.
    """
    scratch = Scratch(docs.sparkSession, "units")
    each = docs.select("doc_id", F.posexplode(units(F.col("text"))).alias("at", "unit"))
    each = each.select("doc_id", "at", normalised(F.col("unit")).alias("unit")).where(F.length("unit") - F.length(F.replace("unit", F.lit(" "), F.lit(""))) >= min_words - 1)
    # 128 bits: two hashes whose seeds differ
    each = each.select("doc_id", "at", F.xxhash64("unit").alias("h1"), F.xxhash64(F.lit(1), "unit").alias("h2"))
    each = scratch.write(each, "each")
    first = each.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return each.join(scratch.write(first, "first").hint("merge"), ["h1", "h2"]).where(~F.struct("doc_id", "at").eqNullSafe(F.col("first"))).select("doc_id", "at")


def deduplicate(docs: DataFrame, min_words: int = 5, min_run_words: int = 0) -> DataFrame:
    """One row per document: units, removed spans by original offsets, and the text that is left.

    A unit of ``min_words`` words or more is repeated if one that is equal after
    normalising starts earlier, in a smaller ``doc_id`` or before it in its own
    document.  Adjacent repeated units, with shorter units between two of them,
    form a run, and runs are removed, so that the earliest occurrence stays.  With
    ``min_run_words`` shorter runs stay too.

    Null texts are empty: one unit, nothing removed.  Rows that share a
    ``doc_id`` count as one place, so neither makes the other a repeat; a null id
    sorts first.  A very long text is cut to units in its row; an empty table
    gives no rows.  Only ``doc_id`` and ``text`` are read.  Grouping is by digest
    with partial aggregation, and what joins back is a plain equi-join that
    adaptive execution splits where a digest is frequent.
    """
    found = repeats(docs, min_words).groupBy("doc_id").agg(F.collect_set("at").alias("repeated"))  # at most the units of a document
    base = docs.select("doc_id", "text").alias("d")
    both = base.join(found.hint("merge").alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left").select("d.doc_id", units(F.col("d.text")).alias("units"), "repeated")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(both, lambda rows: (remove(*r, min_words, min_run_words) for r in rows), f"doc_id {kind}, {REPORT}", flush_rows=512)


def remove(doc_id, cut: list[str], repeated: list[int] | None, min_words: int, min_run_words: int) -> tuple:  # noqa: ANN001
    spans: list[tuple[int, int, int]] = []  # first unit, end unit, words
    if repeated:
        words = [len(u.encode("utf-8", "surrogatepass").split()) for u in cut]  # by ASCII white space, as in ``normalised``
        for at in sorted(repeated):
            if spans and all(words[k] < min_words for k in range(spans[-1][1], at)):
                spans[-1] = spans[-1][0], at + 1, spans[-1][2] + sum(words[spans[-1][1] : at + 1])
            else:
                spans.append((at, at + 1, words[at]))
        spans = [x for x in spans if x[2] >= min_run_words]
    starts = list(accumulate(map(len, cut), initial=0)) if spans else []
    kept, done = [], 0
    for first, end, _ in spans:
        kept += cut[done:first]
        done = end
    text = "".join(kept + cut[done:])
    offsets = ",".join(f"{starts[a]}:{starts[b]}" for a, b, _ in spans)
    return doc_id, len(cut), sum(b - a for a, b, _ in spans), sum(starts[b] - starts[a] for a, b, _ in spans), offsets, text
