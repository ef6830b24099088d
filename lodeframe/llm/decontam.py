"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words.  A table of shifts, keyed
by blocks of two words, says how far a search window can move; where it says
zero, a table keyed by the window's last and first block gives the few patterns
that direct comparison then confirms or refutes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows, unused

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

#: Every byte that can't stand in a word becomes a blank, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, letters a-z and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class WuManber:
    """All patterns of one length in words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]) -> None:
        self.length, self.block = length, min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ends: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                block, move = p[end - self.block : end], length - end
                self.shift[block] = min(self.shift.get(block, self.skip), move)
            self.ends[p[-self.block :]][p[: self.block]].append((list(p), items))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of each occurrence."""
        length, b, shift, skip = self.length, self.block, self.shift, self.skip
        at, n = length - 1, len(text)
        while at < n:
            block = (text[at - 1], text[at]) if b == 2 else (text[at],)
            move = shift.get(block, skip)
            if move:
                at += move
                continue
            start = at - length + 1
            for p, items in self.ends[block].get(tuple(text[start : start + b]), ()):
                if text[start : at + 1] == p:
                    yield start, items
            at += 1


def pattern_blocks(benchmark: DataFrame, window: int, per_block: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """The benchmark's windows, streamed to the driver partition by partition, in blocks of at most ``per_block`` pairs of a window and an item."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        w = words(row["text"])
        name = set() if row["item_id"] is None else {str(row["item_id"])}
        for i in range(max(1, len(w) - window + 1) if w else 0):
            if size >= per_block:
                yield dict(found)
                found.clear()
                size = 0
            found[tuple(w[i : i + window])] |= name
            size += 1
    if found:
        yield dict(found)


def _tables(block) -> Callable[[], list[WuManber]]:  # noqa: ANN001
    """Makes a broadcast block's search tables when they are first asked for."""
    made: list[WuManber] = []

    def tables() -> list[WuManber]:
        if not made:
            by_length: dict[int, dict] = defaultdict(dict)
            for p, items in block.value.items():
                by_length[len(p)][p] = items
            made.extend(WuManber(n, p) for n, p in sorted(by_length.items()))
        return made

    return tables


def _hits(w: list[bytes], tables: list[WuManber]) -> tuple[bytearray, set[str]]:
    """A mark for each word inside an occurrence, and the items that occur."""
    marks, items = bytearray(len(w)), set()
    for t in tables:
        for start, named in t.search(w):
            marks[start : start + t.length] = b"\1" * t.length
            items |= named
    return marks, items


def _earlier_passes(texts: DataFrame, blocks: Iterator[dict], scratch: Scratch) -> tuple[dict, DataFrame | None]:
    """(the last block, what the others hit): (digest, block, marks, items) of each text that a block before the last one hits.

    One pass over the texts for each of those blocks.  Its table of hits is
    stored and its broadcast destroyed before the next block is taken, so one
    block is alive at a time.  What a block hits follows from the text alone, so
    its SHA-256 names it, and equal texts are one row.
    """
    last, passes = next(blocks, {}), 0
    hits = "digest string, marks binary, items array<string>"
    for block in blocks:
        sent = texts.sparkSession.sparkContext.broadcast(last)
        tables = _tables(sent)

        def scan(rows: list, tables=tables) -> Iterator[tuple]:  # noqa: ANN001
            for digest, text in rows:
                marks, items = _hits(words(text), tables())
                if any(marks):
                    yield digest, bytes(marks), sorted(items)

        found = map_rows(texts.select("digest", "text"), scan, hits, flush_rows=256)
        scratch.write(found.groupBy("digest").agg(F.first("marks").alias("marks"), F.first("items").alias("items")), f"block={passes}")
        sent.destroy()
        last, passes = block, passes + 1
    if not passes:
        return last, None
    return last, texts.sparkSession.read.schema(f"{hits}, block int").parquet(scratch.path)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, per_block: int = 200_000) -> DataFrame:
    """One row per document: words, words inside any occurrence of a window, items that occur.

    Broadcasts at most ``per_block`` pairs of a window and an item at a time.  A
    benchmark of one block is searched in one narrow pass without a shuffle.  A
    larger one is searched block after block; the passes before the last store
    what they hit, one row per hit text, which then joins the last pass.

    Null or empty texts have no words and no hits; a null ``doc_id`` passes
    through (others are cast to long, null if that can't be); repeated rows give
    repeated report rows; an item without words has no window; windows of an item
    with a null id count as hits, unnamed; with an empty benchmark nothing is
    hit.  A very long text takes memory for its words.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.expr("try_cast(doc_id as long)").alias("doc_id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    last, earlier = _earlier_passes(texts, pattern_blocks(benchmark, window, per_block), Scratch(spark, "hits"))
    tables = _tables(spark.sparkContext.broadcast(last))

    def report(doc_id: int | None, n_words: int, marks: bytes, items: set[str]) -> tuple:
        n_hit = marks.count(1)
        return doc_id, n_words, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0

    if earlier is None:

        def scan(rows: list) -> Iterator[tuple]:
            for doc_id, text in rows:
                w = words(text)
                yield report(doc_id, len(w), *_hits(w, tables()))

        return map_rows(texts.select("doc_id", "text"), scan, REPORT)

    def scan_last(rows: list) -> Iterator[tuple]:
        for doc_id, digest, text in rows:
            w = words(text)
            marks, items = _hits(w, tables())
            yield doc_id, digest, len(w), bytes(marks) if any(marks) else b"", sorted(items)

    def joined(rows: list) -> Iterator[tuple]:
        for doc_id, n, marks, items, before in rows:
            all_items, all_marks = set(items), int.from_bytes(marks, "big")
            for b in before or ():
                all_items.update(b["items"])
                all_marks |= int.from_bytes(b["marks"], "big")
            yield report(doc_id, n, all_marks.to_bytes(n, "big"), all_items)

    # at most one row a block for each text
    hit = earlier.groupBy(F.col("digest").alias("h")).agg(F.collect_list(F.struct("marks", "items")).alias("before"))
    rows = map_rows(texts.select("doc_id", "digest", "text"), scan_last, "doc_id long, digest string, n long, marks binary, items array<string>", flush_rows=1024)
    rows = rows.join(hit.hint("merge"), F.col("digest") == F.col("h"), "left").select("doc_id", "n", "marks", "items", "before")
    return map_rows(rows, joined, REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, per_block: int = 200_000) -> DataFrame:
    """The documents, all columns kept, that no window of the benchmark occurs in.

    The verdict of the last block travels with its row: no join and no shuffle
    for a benchmark of one block.  Texts that earlier blocks hit are known by
    their SHA-256 and leave by an anti-join.  Rows are judged by their text
    alone, so repeated rows and null ids need no special case; null and empty
    texts stay.
    """
    spark, names = docs.sparkSession, docs.columns
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    last, earlier = _earlier_passes(docs.select("text", digest.alias("digest")), pattern_blocks(benchmark, window, per_block), Scratch(spark, "hits"))
    if earlier is not None:
        known = unused("digest", names)
        gone = earlier.select(F.col("digest").alias(known)).distinct()
        docs = docs.join(gone.hint("merge"), digest == F.col(known), "left_anti")
    return docs.mapInArrow(_keeper(_tables(spark.sparkContext.broadcast(last)), names.index("text")), docs.schema)


def _keeper(tables: Callable[[], list[WuManber]], at: int):  # noqa: ANN202
    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            clean = [not any(_hits(words(t), tables())[0]) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
