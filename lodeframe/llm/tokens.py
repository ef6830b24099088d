"""Byte-pair ids of whole texts, and counts of tokens in flat token files."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, _arrow_schema, map_rows

#: Fixed values of the vocabulary: its one special token.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


@cache
def _fast(ranks_path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _plain(path: str, special: bool):  # noqa: ANN202
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = not special
    return made


@cache
def encoder(path: str | None = None, ranks_path: str | None = None, special: bool = True):  # noqa: ANN201
    """text -> ids (uint32), as the tokenizer file gives them without added special tokens.

    The same vocabulary as a table of ranks encodes five times faster; the
    tokenizer file itself takes over for texts which that encoder gives up on.
    The special token's string, where a text contains it, is its id, or ordinary
    text if ``special`` is false.
    """
    import public_tokenizers as public

    fast, pattern = _fast(ranks_path or public.path("byte_bpe_50k.tiktoken"), public.PATTERN), path or public.path("byte_bpe_50k.json")

    def encode(text: str) -> np.ndarray:
        try:
            if not special or SPECIAL not in text:
                return np.asarray(fast.encode_ordinary(text), np.uint32)
            parts: list[int] = []
            for k, part in enumerate(text.split(SPECIAL)):
                parts += [SPECIAL_ID] * (k > 0) + fast.encode_ordinary(part)
            return np.asarray(parts, np.uint32)
        except BaseException as e:  # noqa: BLE001  its panics aren't Exceptions
            if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return np.asarray(_plain(pattern, special).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


#: Token files: little-endian unsigned 16-bit ids, each document closed by ``END``, nothing else.
DTYPE, END = "<u2", SPECIAL_ID
SEPARATOR = int(END).to_bytes(2, "little").decode("latin-1")


def write_token_files(docs: DataFrame, path: str) -> None:
    """Flat token files under ``path``/kind=tokens, and beside them under kind=ids which documents they hold, in order.

    One pass: each task writes its documents' ids into a file of its own, and
    Spark's text writer, given the separator's bytes as the line end, puts the
    separators in.  So files can go to any store that Spark writes to, and a
    task that is run again replaces its file.
    """

    def encode(rows: list) -> Iterator[tuple]:
        ids_of = encoder(special=False)
        for doc_id, at, text in rows:
            yield "tokens", at, ids_of(text or "").astype(DTYPE).tobytes()
            yield "ids", at, (b"" if doc_id is None else b"%d" % doc_id)

    numbered = docs.select(F.expr("try_cast(doc_id as long)").alias("doc_id"), F.monotonically_increasing_id().alias("at"), "text")
    made = map_rows(numbered, encode, "kind string, at long, value binary", flush_rows=256)
    # binary to string keeps the bytes as they are
    made = made.select("kind", "at", F.col("value").cast("string").alias("value")).sortWithinPartitions("kind", "at")
    made.select("kind", "value").write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR).text(path)


def _pieces(spark: SparkSession, path: str, separator: bytes) -> DataFrame:
    """(file, split, size, value): the files' bytes between occurrences of the separator's bytes.

    Spark's text reader moves the bytes: it splits files of any size by the
    session's ``maxPartitionBytes``, reads from any store, and a row is no longer
    than what lies between two separators.  ``split`` is where a task's part of
    the file begins.
    """
    lines = spark.read.option("lineSep", separator.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return lines.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _by_split(batches: Iterator) -> Iterator[tuple[tuple[str, int, int], list[bytes] | None]]:
    """((file, split, size), its next pieces), and None where a split has ended."""
    at = None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        values, first = batch.column(3).to_pylist(), 0
        while first < len(keys):
            end = first
            while end < len(keys) and keys[end] == keys[first]:
                end += 1
            if at is not None and at != keys[first]:
                yield at, None
            at = keys[first]
            yield at, values[first:end]
            first = end
    if at is not None:
        yield at, None


ENDS = "file string, split long, size long, phase int, k long, before long, at long, n_bytes long, counts array<long>, lasts array<long>, head binary, tail binary"
PLACED = "file string, split long, base long, own int, first long, open long, a long, b long"
MARK = b"\xef\xbb\xbf"  # what Spark's reader takes off a file's start


def _searched(separator: bytes, line_end: bytes, arrow):  # noqa: ANN001, ANN202
    """Places of the separator in each split, counted from where its own bytes begin.

    A split doesn't know how many bytes came before it, so it can't tell which
    places are those of whole tokens.  It gives the places of each phase, modulo
    the width of a token, with their numbers and predecessors in that phase, and
    at its end one summary row: its bytes, each phase's count and last place, and
    the bytes at its edges, in which a separator can begin or end.
    """
    width = len(separator)
    edge = width - 1

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        def rows(key: tuple, n: int, **columns) -> pa.RecordBatch:  # noqa: ANN003
            given = dict(zip(("file", "split", "size"), ([x] * n for x in key), strict=True)) | columns
            return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        carry = None
        for key, pieces in _by_split(batches):
            if pieces is None:
                yield rows(key, 1, n_bytes=[done], counts=[counts], lasts=[lasts], head=[head], tail=[carry])
                carry = None
                continue
            if carry is None:
                carry, head, done, counts, lasts = b"", b"", 0, [0] * width, [None] * width
            data = carry + line_end.join(pieces) + line_end
            b = np.frombuffer(data, np.uint8)
            hit = np.ones(max(0, len(b) - edge), bool)
            for k, byte in enumerate(separator):
                hit &= b[k : k + len(hit)] == byte
            found = np.flatnonzero(hit) + (done - len(carry))
            for phase in range(width):
                at = found[found % width == phase]
                if len(at):
                    before = [lasts[phase], *at[:-1].tolist()]
                    yield rows(key, len(at), phase=np.full(len(at), phase), k=counts[phase] + np.arange(len(at)), before=before, at=at)
                    counts[phase] += len(at)
                    lasts[phase] = int(at[-1])
            head = head if len(head) == edge else (head + data[len(carry) :])[:edge]
            done += len(data) - len(carry)
            carry = data[max(0, len(data) - edge) :]

    return run


def _stitched(separator: bytes, line_end: bytes):  # noqa: ANN202
    """The prefix scan over a file's summary rows: where each split begins, its phase, and the documents before it; and the documents that end across splits or aren't closed."""
    width = len(separator)

    def run(splits):  # noqa: ANN001, ANN202
        import pandas as pd

        splits = splits.sort_values("split")
        file, size = splits["file"].iloc[0], int(splits["size"].iloc[0])
        extra = int(splits["n_bytes"].sum()) - size  # a line end that isn't there, or a mark that was taken off
        seen = MARK if extra in (-3, len(line_end) - 3) else b""
        base, first, start, out = len(seen), 0, 0, []
        for split, n, counts, lasts, head, tail in zip(*(splits[c] for c in ("split", "n_bytes", "counts", "lasts", "head", "tail")), strict=True):
            edge = seen + head
            for p in range(base - len(seen), base):
                if p % width == 0 and edge[p - base + len(seen) :][:width] == separator:
                    out.append((file, None, None, None, first, None, start, p))
                    first, start = first + 1, p + width
            own = -base % width
            out.append((file, int(split), base, own, first, start, None, None))
            if counts[own]:
                first, start = first + int(counts[own]), base + int(lasts[own]) + width
            base += int(n)
            seen = (seen + tail)[-(width - 1) :]
        if size - start >= width:
            out.append((file, None, None, None, first, None, start, size))
        return pd.DataFrame({c: pd.array([r[k] for r in out], "string" if c == "file" else "Int64") for k, c in enumerate(x.split()[0] for x in PLACED.split(", "))})

    return run


def scan_token_files(spark: SparkSession, path: str, end: int = END, dtype: str = DTYPE, block: float | None = None) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of each document in flat token files that have no index.

    Files are read in splits, of ``block`` tokens if that is given, else of the
    session's ``spark.sql.files.maxPartitionBytes``, and each is searched for
    itself: a vectorised comparison gives the places of ``end``.  What a split
    can't know, how many bytes and documents and which unfinished one came before
    it, is a prefix scan over one summary row a split.  So a file may be of any
    size; a task holds an Arrow batch, and one document's tokens must fit a row
    (2 GiB).

    ``n_tokens`` leaves the separator out.  Tokens after a file's last separator
    are a last document that isn't closed; a trailing partial token is ignored;
    empty files give no rows.
    """
    separator = int(end).to_bytes(np.dtype(dtype).itemsize, "little")
    width = len(separator)
    # Where a separator can overlap itself, two splits could cut a run of them differently; a single byte can't.
    line_end = separator[:1] if any(separator[:k] == separator[-k:] for k in range(1, width)) else separator
    scratch = Scratch(spark, "ends")
    setting = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(setting)
    try:
        if block:
            spark.conf.set(setting, str(int(block * width)))
        found = _pieces(spark, path, line_end).mapInArrow(_searched(separator, line_end, _arrow_schema(spark, ENDS)), ENDS)
        ends = scratch.write(found, "ends")
    finally:
        spark.conf.set(setting, kept)
    summaries = ends.where("n_bytes is not null").drop("phase", "k", "before", "at")
    placed = scratch.write(summaries.groupBy("file").applyInPandas(_stitched(separator, line_end), PLACED), "placed")
    splits = placed.where("a is null").select(F.col("file").alias("f"), F.col("split").alias("s"), "base", "own", "first", "open")
    each = ends.where("at is not null").join(splits, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")) & (F.col("phase") == F.col("own")))
    each = each.select("file", (F.col("first") + F.col("k")).alias("ordinal"), F.coalesce(F.col("base") + F.col("before") + width, F.col("open")).alias("a"), (F.col("base") + F.col("at")).alias("b"), (F.col("base") + F.col("at") + width <= F.col("size")).alias("closed"))
    sizes = summaries.groupBy(F.col("file").alias("f")).agg(F.max("size").alias("size"))
    across = placed.where("a is not null").join(sizes, F.col("file") == F.col("f"))
    across = across.select("file", F.col("first").alias("ordinal"), "a", "b", (F.col("b") + width <= F.col("size")).alias("closed"))
    every = each.unionByName(across).where(f"closed or b - a >= {width}")
    return every.select("file", "ordinal", F.expr(f"a div {width}").alias("start"), F.expr(f"(b - a) div {width}").alias("n_tokens"), "closed")


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, doc_id) as written beside the token files, numbered by splits and a prefix scan as those are."""
    schema = "file string, split long, k long, doc_id long, n long"
    arrow = _arrow_schema(spark, schema)

    def number(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        done = 0
        for (file, split, _), pieces in _by_split(batches):
            if pieces is None:
                columns, done = ([file], [split], [None], [None], [done]), 0
            else:
                n = len(pieces)
                columns = [file] * n, [split] * n, list(range(done, done + n)), [int(x) if x else None for x in pieces], [None] * n
                done += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    made = Scratch(spark, "ids").write(_pieces(spark, path, SEPARATOR.encode("latin-1")).mapInArrow(number, schema), "ids")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = made.where("n is not null").select(F.col("file").alias("f"), F.col("split").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    each = made.where("k is not null").join(splits, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    return each.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")


def counts(docs: DataFrame) -> DataFrame:
    """Tokens per document: writes the documents to flat token files and scans those.

    A null or empty text has 0 tokens.  Each row of the input is a document of
    its own, so repeated and null ids come back as often as they went in; ids are
    cast to long, null if that can't be.  A very long text is encoded whole, and
    its tokens must fit a row.  An empty table gives no rows.  Other columns are
    ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    write_token_files(docs, f"{scratch.path}/flat")
    try:
        found = scan_token_files(spark, f"{scratch.path}/flat/kind=tokens")
        names = documents_of(spark, f"{scratch.path}/flat/kind=ids")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "doc_id long, n_tokens long")  # nothing was written
    return found.join(names.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
