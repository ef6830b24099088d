"""Line dedup on windows of two lines, or on content-defined chunks of lines.

Windows: each two neighbouring lines are a unit, so every passage of two or more
whole lines that occurs earlier is covered by units that occur earlier and goes
whole, wherever it starts.

Chunks: a rolling hash over the hashes of neighbouring lines picks the chunk
ends, so an inserted or dropped line moves only the ends near it and equal
passages in different documents mostly fall into equal chunks.

Units of several lines that occur again anywhere in the corpus go, all but the
first, once their bytes were compared.

Whole (``clean``): chunks come first, and a chunk that occurs earlier settles the
windows within it.  Only the other windows, those of first chunks and those
across chunk ends, are searched one by one.  What goes is what windows alone
would cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows, unused

MASK = (1 << 64) - 1
#: The odd multiplier of the rolling hash, and lines that it spans.
MULTIPLIER, SPAN = 0x9E3779B97F4A7C15, 2
#: Bytes of a unit's digest.
DIGEST = 16

Units = Callable[[str], list[tuple[int, int]]]


def chunks(text: str) -> list[tuple[int, int]]:
    """(first line, end line) of each chunk: two or three lines, or the one line of a text.

    The gaps between lines become chunk ends in the order of the rolling hash of
    the ``SPAN`` lines around them, all that leave no chunk of one line.  That
    is as dense as ends of chunks of several lines can be.
    """
    hashes = [xxhash.xxh3_64_intdigest(x) for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
    n = len(hashes)
    rolling = [((a * MULTIPLIER + b) * MULTIPLIER & MASK) >> 32 for a, b in zip(hashes, hashes[1:], strict=False)]
    ends = bytearray(n + 1)
    ends[0] = ends[n] = 1
    for gap in sorted(range(2, n - 1), key=lambda g: rolling[g - 1]):
        if not (ends[gap - 1] or ends[gap + 1]):
            ends[gap] = 1
    at = [i for i, end in enumerate(ends) if end]
    return list(zip(at, at[1:], strict=False))


def windows(text: str) -> list[tuple[int, int]]:
    """(first line, end line) of each two neighbouring lines."""
    return [(i, i + 2) for i in range(text.count("\n"))]


def _digests(text: str | None, units: Units, min_lines: int = 2) -> Iterator[tuple[int, int, int, bytes, str]]:
    """(number, first line, end line, digest, content) of each unit of several lines."""
    if not text or "\n" not in text:
        return
    lines = text.split("\n")
    for k, (a, b) in enumerate(units(text)):
        if b - a >= min_lines:
            content = "\n".join(lines[a:b])
            if content.strip("\n"):
                yield k, a, b, xxhash.xxh3_128_digest(content.encode("utf-8", "surrogatepass")), content


def _split(text: str | None, units: Units) -> Iterator[tuple[int, bool, bytes]]:
    """(first line, whether within a unit, digests of its windows) of each unit and of each window across a unit's end.

    The units adjoin.  Windows of nothing but line feeds are left out; one within a unit parts it.
    """
    digests = {k: digest for k, _, _, digest, _ in _digests(text, windows)}
    for a, b in units(text) if digests else ():
        run = b""
        for k in range(a, b):
            if k < b - 1 and k in digests:
                run += digests[k]
            elif run:
                yield k - len(run) // DIGEST, True, run
                run = b""
        if b - 1 in digests:
            yield b - 1, False, digests[b - 1]


def _firsts(made: DataFrame, key: str) -> DataFrame:
    """The place of the first occurrence of each key that occurs again."""
    return made.groupBy(key).agg(F.min(F.struct("doc_id", "k")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def _each_window(made: DataFrame) -> DataFrame:
    """A row for each window of a row of several, with its own place and, if there is one, its own first place."""
    i = F.col("i")
    rows = made.withColumn("i", F.explode(F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1)))
    first = F.when(F.col("first").isNotNull(), F.struct(F.col("first.doc_id").alias("doc_id"), (F.col("first.k") + i).alias("k")))
    return rows.select(F.substring("digests", i * DIGEST + 1, F.lit(DIGEST)).alias("digest"), "doc_id", (F.col("k") + i).alias("k"), first.alias("first"))


def _unit_members(texts: DataFrame, scratch: Scratch, units: Units) -> DataFrame:
    """(digest, doc_id, k, first place) of each unit whose digest occurs again."""

    def number(rows: list) -> Iterator[tuple]:
        for doc_id, text in rows:
            for k, _, _, digest, _ in _digests(text, units):
                yield doc_id, k, digest

    kind = texts.schema["doc_id"].dataType.simpleString()
    made = scratch.write(map_rows(texts, number, f"doc_id {kind}, k int, digest binary"), "units")
    first = scratch.write(_firsts(made, "digest"), "first")  # stored, so that the join can split a frequent digest
    return made.join(first.hint("merge"), "digest")


def _window_members(texts: DataFrame, scratch: Scratch, units: Units) -> DataFrame:
    """(digest, doc_id, k, first place) of each window whose digest occurs again, the later ones of a unit's found by the unit.

    Equal units are equal window by window, so those of a later unit need no
    search.  The first unit and all that lies across ends are searched as windows.
    """

    def number(rows: list) -> Iterator[tuple]:
        for doc_id, text in rows:
            for k, within, digests in _split(text, units):
                yield doc_id, k, within, digests

    kind = texts.schema["doc_id"].dataType.simpleString()
    made = scratch.write(map_rows(texts, number, f"doc_id {kind}, k int, within boolean, digests binary"), "units")
    within = made.where("within").drop("within")
    first = scratch.write(_firsts(within, "digests"), "unit-first")  # stored, as below
    placed = scratch.write(within.join(first.hint("merge"), "digests", "left"), "placed")
    later = F.col("first").isNotNull() & ~F.struct("doc_id", "k").eqNullSafe(F.col("first"))
    across = made.where("not within").select(F.col("digests").alias("digest"), "doc_id", "k")
    rest = _each_window(placed.where(~later)).drop("first").unionByName(across)
    first = scratch.write(_firsts(rest, "digest"), "first")
    return rest.join(first.hint("merge"), "digest").unionByName(_each_window(placed.where("first is not null")))


def repeated_units(docs: DataFrame, scratch: Scratch, units: Units, whole: bool = False) -> DataFrame:
    """(doc_id, k, digest) of the units to remove: those that a byte-equal unit precedes; if ``whole``, of windows."""
    texts = docs.select("doc_id", "text")
    members = scratch.write((_window_members if whole else _unit_members)(texts, scratch, units), "members")
    units = windows if whole else units

    # Byte comparison: the least and the greatest content under a digest are the same, or the digest is not used.
    wanted = members.groupBy("doc_id").agg(F.collect_set("k").alias("ks"))
    both = texts.alias("d").join(wanted.hint("merge").alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("text", "ks")

    def fetch(rows: list) -> Iterator[tuple]:
        for text, ks in rows:
            ks = set(ks)
            for k, _, _, digest, content in _digests(text, units):
                if k in ks:
                    yield digest, content

    contents = map_rows(both, fetch, "digest binary, content string", flush_rows=1024)
    differ = scratch.write(contents.groupBy("digest").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").select("digest"), "differ")
    out = members.where(~F.struct("doc_id", "k").eqNullSafe(F.col("first"))).join(differ, "digest", "left_anti")
    return out.select("doc_id", "k", "digest")


def _join_back(docs: DataFrame, scratch: Scratch, units: Units, whole: bool = False) -> DataFrame:
    """The documents' rows and, as a last column, the number and digest of each unit that goes as one string, null where nothing goes."""
    key, last = unused("id", docs.columns), unused("gone", docs.columns)
    gone = repeated_units(docs, scratch, units, whole).groupBy(F.col("doc_id").alias(key)).agg(F.array_join(F.collect_set(F.concat_ws(":", "k", F.hex("digest"))), ",").alias(last))
    scratch.keep("members", "differ")
    # Merge joins at every size: no side here has a bound, and the plan for much data is the plan for little.
    return docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(gone[key]), "left").drop(key)


def _cut(text: str | None, gone: str | None, units: Units) -> tuple[str, list[tuple[int, int]]]:
    """The text left and the line spans removed, overlapping ones as one; a unit goes only where number and digest both fit."""
    if not gone:
        return text or "", []
    wanted = set(gone.split(","))
    spans: list[tuple[int, int]] = []
    for k, a, b, digest, _ in _digests(text, units):
        if f"{k}:{digest.hex().upper()}" in wanted:
            if spans and a < spans[-1][1]:
                a = spans.pop()[0]
            spans.append((a, b))
    if not spans:
        return text or "", []
    lines, left, done = (text or "").split("\n"), [], 0
    for a, b in spans:
        left += lines[done:a]
        done = b
    return "\n".join(left + lines[done:]), spans


def deduplicate(docs: DataFrame, units: Units = chunks) -> DataFrame:
    """One row per document: lines, what was removed by original line numbers, and the text left.

    The order of occurrences is by ``doc_id`` and then by place.  Units of one
    line and units of nothing but line feeds are never removed.  The first
    occurrence of a line always stays.  A null text is empty (one line).  Rows
    that share a ``doc_id`` count as one place, so neither makes the other's
    units repeats; a null id sorts first.  A very long text takes memory for its
    lines, one text at a time.  An empty table gives no rows.  Other columns are
    ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _join_back(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "line-dedup"), units)

    def report(rows: list) -> Iterator[tuple]:
        for doc_id, text, gone in rows:
            kept, spans = _cut(text, gone, units)
            yield doc_id, 1 + (text or "").count("\n"), sum(b - a for a, b in spans), ",".join(f"{a}:{b}" for a, b in spans), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept

    return map_rows(rows, report, f"doc_id {kind}, n_lines int, n_removed_lines int, removed_lines string, kept_sha256 string, kept_text string", flush_rows=512)


def clean(docs: DataFrame, units: Units = chunks, whole: bool = False) -> DataFrame:
    """The documents with their repeated units cut out, all columns kept; a text that is cut out whole takes its row with it.

    If ``whole``, the repeated windows that no repeated unit holds go too; the
    units must adjoin, as chunks do.  Null and empty texts stay; for the rest as
    ``deduplicate``.
    """
    names = docs.columns
    at = names.index("text")
    rows = _join_back(docs, Scratch(docs.sparkSession, "line-dedup"), units, whole)
    units = windows if whole else units

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            new, stays = [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                left, spans = _cut(text, gone, units)
                new.append(left if spans else text)
                stays.append(not spans or bool(left.strip("\n")))
            columns = [*batch.columns[: len(names)]]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)
