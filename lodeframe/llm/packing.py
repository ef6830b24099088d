"""Best-fit packing of tokenised documents into sequences of bounded length.

What is packed is the *histogram* of piece lengths, which never has more than
``capacity`` entries however large the corpus is.  Martello-Toth dominance
reduction fixes lengths that provably belong together, best-fit places the rest,
and the outcome is a small table of slots that each row then finds its place in
by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, map_rows
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """The pieces of each document's ids and a closing id 0; only the first may be short."""

    def cut(rows: list) -> Iterator[tuple]:
        encode = encoder()
        for doc_id, text in rows:
            ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
            first = len(ids) % capacity or capacity
            ends = range(first, len(ids) + 1, capacity)
            for k, end in enumerate(ends):
                start = 0 if k == 0 else end - capacity
                yield doc_id, k, start, end - start, zlib.crc32(ids[start:end].tobytes())

    return map_rows(docs.select(F.expr("try_cast(doc_id as long)").alias("doc_id"), "text"), cut, PIECES)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction on a histogram: bins that some optimal packing contains, and what is left.

    Takes lengths from the largest.  A length that nothing fits beside stands
    alone.  Else let ``k`` be the largest that fits beside it: the pair dominates
    every other set with that length if it fills the bin, or if no two further
    pieces fit beside the length together (then at most one can, and ``k`` is the
    largest), or if any two that fit have a sum of at most ``k``.
    """
    left, fixed = dict(counts), []
    order = sorted(left)
    for big in sorted(left, reverse=True):
        while left.get(big, 0):
            room = capacity - big
            small = [x for x in order[: bisect.bisect_right(order, room)] if left[x] > (x == big)]
            if not small:
                bins, n = (big,), left[big]
            else:
                k = small[-1]
                if k < room and not _no_better_pair(small, left, k, room, big):
                    break
                bins = (big, k)
                n = left[big] // 2 if k == big else min(left[big], left[k])
            fixed.append((bins, n))
            for x in bins:
                left[x] -= n
        order = [x for x in order if left[x]]
    return fixed, {x: n for x, n in left.items() if n}


def _no_better_pair(small: list[int], left: dict[int, int], k: int, room: int, big: int) -> bool:
    """No two of the rest that fit in ``room`` together sum to more than ``k``, and no three fit."""
    free = lambda x: left[x] - (x == big)
    least: list[int] = []
    for x in small[:3]:
        least += [x] * min(3, free(x))
    if len(least) >= 3 and sum(least[:3]) <= room:
        return False
    i, j, most = 0, len(small) - 1, 0
    while i <= j:
        if small[i] + small[j] > room:
            j -= 1
            continue
        if i < j or free(small[i]) > 1:
            most = max(most, small[i] + small[j])
        i += 1
    return most <= k


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: opens a bin with the largest length and fills its room.

    Each bin's pattern repeats while its lengths last, so a pattern ends at least
    one length and there are no more patterns than lengths.
    """
    left = np.zeros(capacity + 1, np.int64)
    for x, n in counts.items():
        left[x] = n
    out: list[tuple[tuple[int, ...], int]] = []
    while left.any():
        free, room, pattern = left.copy(), capacity, []
        while room and (fits := np.flatnonzero(free[: room + 1])).size:
            x = _best(free, room, int(fits[-1])) if pattern else int(fits[-1])
            pattern.append(x)
            free[x] -= 1
            room -= x
        used = np.bincount(pattern, minlength=capacity + 1)
        n = int((left[used > 0] // used[used > 0]).min())
        left -= n * used
        out.append((tuple(pattern), n))
    return out


def _best(free: np.ndarray, room: int, largest: int) -> int:
    """The largest length that fits, unless another and a partner fill the room exactly and it can't."""
    if largest == room:
        return room
    ends = (free[: room + 1] > 0) & (free[room::-1] > 0)  # x and room - x
    if room % 2 == 0 and free[room // 2] < 2:
        ends[room // 2] = False
    exact = np.flatnonzero(ends)
    return int(exact[-1]) if exact.size else largest


def pack(made: DataFrame, scratch: Scratch, capacity: int = 2048, key: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored rows that have a length of 1 to ``capacity``.

    Ranks come from two levels: a window over (length, salt), with a salt for
    each shuffle partition so that a hot length spreads over all of them, and a
    prefix sum of the salts' counts, joined on the window's own partitioning.
    The slot table has an entry for each length of each pattern, at most some
    ``capacity`` patterns of at most sqrt(2 * capacity) lengths: bounded by
    ``capacity``, not by the rows, so it is broadcast.
    """
    spark = made.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = scratch.write(made.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(salts))), "salted")
    cells = salted.groupBy(F.col(key).alias("__len"), "__salt").agg(F.count(F.lit(1)).alias("__n"))
    counts = {r[0]: r[1] for r in cells.groupBy("__len").agg(F.sum("__n")).collect()}  # at most ``capacity`` rows
    fixed, rest = reduce_by_dominance(counts, capacity)
    slots, base, seen = [], 0, dict.fromkeys(counts, 0)
    for pattern, n in [*fixed, *best_fit(rest, capacity)]:
        at = 0
        for x in dict.fromkeys(pattern):
            m = pattern.count(x)
            slots.append((x, seen[x], n * m, m, base, at))
            seen[x] += n * m
            at += m * x
        base += n
    slots = spark.createDataFrame(slots, "__len long, __first long, __rows long, __each long, __base long, __at long")
    before = Window.partitionBy("__len").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(key, "__salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("__rank", F.row_number().over(within) - 1).alias("r").join(cells.hint("merge").alias("c"), (F.col(f"r.{key}") == F.col("c.__len")) & (F.col("r.__salt") == F.col("c.__salt")))
    ranked = ranked.select("r.*", (F.col("__rank") + F.col("__before")).alias("__place"))
    s = F.broadcast(slots)
    joined = ranked.join(s, (ranked[key] == s["__len"]) & (ranked["__place"] >= s["__first"]) & (ranked["__place"] < s["__first"] + s["__rows"]))
    return joined.select(*made.columns, F.expr("__base + (__place - __first) div __each").alias("sequence_id"), F.expr("__at + (__place - __first) % __each * __len").alias("offset"))


def packed(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row per piece of each document, with its sequence and place there.

    A null text is empty: its only id is the closing 0, so each document has at
    least one piece.  Documents with null or repeated ids are packed each for
    itself; equal pieces have equal ranks in some order, whichever is as good.
    Ids are cast to long, null if that can't be.  A very long text is encoded
    whole, one at a time, and gives as many pieces as it needs.  An empty table
    gives no rows.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(pieces(docs, capacity), scratch, capacity)
