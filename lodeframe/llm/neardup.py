"""MinHash near-duplicate detection.

Documents with the same set of word shingles form a class; a class has one
representative.  Representatives that agree on a band of their signatures are
candidates.  A candidate pair is compared batch by batch of its signature and
given up once the posterior probability of enough similarity is below the
chosen miss probability; what survives is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import lgamma

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows, unused

#: A-Z become a-z, white space a blank; other bytes stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))

SIGNATURE, BANDS = 128, 32  # bands of 4: a pair at the limit of 0.85 misses all with probability 5e-11
BATCH, MISS = 16, 1e-9


@cache
def _multipliers() -> np.ndarray:
    """Odd multipliers, from a fixed seed."""
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when it grows past a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word ``n``-grams; fewer words are one shingle, none give none."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    grams = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        grams = _mix(grams ^ h[i : len(h) - n + 1 + i])
    return np.unique(grams)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word (the public splitmix64 finaliser and an odd step)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(grams: np.ndarray, block: int = 256) -> np.ndarray:
    """Least values under ``SIGNATURE`` hash functions, the upper 32 bits of each."""
    out = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), block):
        np.minimum(out, (grams[at : at + block, None] * _multipliers()).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, -1)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed=k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def _beta_tail(a: float, b: float, x: float) -> float:
    """P(X >= x) of a beta variable, by integration on a fine grid in logs."""
    t = np.linspace(x, 1, 2001)[:-1] + (1 - x) / 4000
    ln = (a - 1) * np.log(t) + (b - 1) * np.log1p(-t) + lgamma(a + b) - lgamma(a) - lgamma(b)
    return float(np.exp(ln).sum() * (1 - x) / 2000)


@cache
def prune_below(limit: float, miss: float = MISS) -> tuple[int, ...]:
    """For each number of batches, the least matches with which a pair goes on.

    The prior of the similarity is uniform; after ``m`` matches in ``n`` places
    its posterior is beta(m + 1, n - m + 1).  A pair is given up when the
    posterior probability of ``limit`` or more is under ``miss``.
    """
    return tuple(next((m for m in range(n + 1) if _beta_tail(m + 1, n - m + 1, limit) >= miss), n) for n in range(BATCH, SIGNATURE + 1, BATCH))


def likely(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two signatures pass every batch."""
    matches = (a == b).reshape(-1, BATCH).sum(1).cumsum()
    return bool((matches >= prune_below(percent / 100)).all())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|; sizes that rule it out spare the comparison."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, sig binary"


def features(docs: DataFrame, n: int = 5) -> DataFrame:
    """Set size, a 128-bit digest of the set, and the signature, of each whole text."""

    def make(rows: list) -> Iterator[tuple]:
        for doc_id, text in rows:
            grams = shingles(text, n)
            d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64)
            yield doc_id, len(grams), int(d1), int(d2), signature(grams).tobytes() if len(grams) else None

    return map_rows(docs.select("doc_id", "text"), make, FEATURES)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, scratch: Scratch, name: str, per_cell: int = 512) -> DataFrame:
    """The pairs (a, b) that link.

    Each ``b`` is a hub; its pairs are dealt into cells of some ``per_cell``, and
    the hub's text goes to each of its cells once.  A cell is streamed: the hub
    comes first and stays in memory, its partners pass by.
    """
    hubs = scratch.write(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / per_cell).cast("int").alias("cells")), f"{name}-hubs")  # stored, so that the join can split a frequent hub
    dealt = pairs.join(hubs.hint("merge"), "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("cells")).cast("int").alias("cell"))
    partner = dealt.join(texts.hint("merge"), F.col("a") == F.col("doc_id")).select("b", "cell", "doc_id", "sig", "text")
    hub = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")).join(texts.hint("merge"), F.col("b") == F.col("doc_id")).select("b", "cell", "doc_id", "sig", "text")
    # a cell has a hub's partners and, first, the hub itself
    rows = hub.withColumn("role", F.lit(0)).unionByName(partner.withColumn("role", F.lit(1))).repartition("b", "cell").sortWithinPartitions("b", "cell", "role")

    def stream(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        own = None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for b, cell, doc_id, sig, text, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if role == 0:
                    own = b, np.frombuffer(sig, np.uint32), shingles(text)
                elif own is not None and own[0] == b and likely(own[1], np.frombuffer(sig, np.uint32), percent) and similar(own[2], shingles(text), percent):
                    out.append((doc_id, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(stream, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the least node that edges (a, b) reach from each node that has one.

    Each round takes the least label among a node and its neighbours and then
    that label's label, so chains shorten by more than half; the rounds are
    stored tables.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct()
    both = scratch.write(both, f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), f"{name}-0")
    at = 0
    while True:
        at += 1
        near = both.join(labels.hint("merge"), F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = scratch.write(step, f"{name}-step-{at}")  # stored, so that the join can split a frequent label
        up = step.select(F.col("node").alias("up"), F.col("label").alias("upper"))
        least = F.least("label", "upper")
        step = step.join(up.hint("merge"), F.col("label") == F.col("up")).select("node", least.alias("label"), (least < F.col("old")).alias("moved"))
        step = scratch.write(step, f"{name}-{at}")
        settled = step.where("moved").isEmpty()
        labels = step.drop("moved")
        scratch.drop(f"{name}-{at - 1}"), scratch.drop(f"{name}-step-{at}")
        if settled:
            return labels


class _Cell:
    """Members of a bucket that meet: minor ones in memory, others passing by."""

    def __init__(self, band: int, percent: int) -> None:
        self.band, self.least = band, np.array(prune_below(percent / 100))
        self.ids: list[int] = []
        self.labels: list[int] = []
        self.sigs: list[np.ndarray] = []
        self.table: tuple | None = None

    def add(self, doc_id: int, label: int, sig: bytes) -> None:
        self.ids.append(doc_id)
        self.labels.append(label)
        self.sigs.append(np.frombuffer(sig, np.uint32))

    def partners(self, doc_id: int, label: int, sig: bytes, in_major: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of the minor members, of other labels, that a member may link with, and how many values of the signature agree.

        A pair that shares several buckets counts in the first only.
        """
        if not self.ids:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if self.table is None:
            self.table = np.stack(self.sigs), np.array(self.ids), np.array(self.labels)
        sigs, ids, labels = self.table
        same = sigs == np.frombuffer(sig, np.uint32)
        good = labels != label if in_major else (labels != label) & (ids < doc_id)
        good &= same.reshape(len(ids), BANDS, -1).all(2).argmax(1) == self.band
        matches = same.reshape(len(ids), -1, BATCH).sum(2).cumsum(1)
        good &= (matches >= self.least).all(1)
        at = np.flatnonzero(good)
        return at, matches[at, -1]


CELL = ("band", "key", "i", "j")


def _mixed_cells(buckets: DataFrame, labels: DataFrame, scratch: Scratch, block: int) -> DataFrame | None:
    """(band, key, i, j, role, doc_id, label, in_major): cells of the buckets whose members have several labels.

    The members outside a bucket's most frequent label (role 0) meet all members
    (role 1), block by block: a cell has some ``block`` members of each role.
    """
    placed = buckets.join(labels.hint("merge"), F.col("doc_id") == F.col("node"), "left").select("band", "key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    placed = scratch.write(placed, "placed")
    by_label = placed.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_label.groupBy("band", "key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1 and n > 2")
    mixed = mixed.select(F.col("band").alias("mb"), F.col("key").alias("mk"), "n", F.col("most.label").alias("major"), (F.col("n") - F.col("most.n")).alias("minor"))
    mixed = scratch.write(mixed, "mixed")
    if mixed.isEmpty():
        return None
    members = placed.join(mixed.hint("merge"), (F.col("band") == F.col("mb")) & (F.col("key") == F.col("mk"))).drop("mb", "mk")
    count = lambda c: F.ceil(F.col(c) / block).cast("int")
    members = members.withColumn("i", F.pmod(F.xxhash64("doc_id"), count("minor")).cast("int")).withColumn("j", F.pmod(F.xxhash64(F.lit(7), "doc_id"), count("n")).cast("int"))
    own = members.where("label <> major").withColumn("j", F.explode(F.sequence(F.lit(0), count("n") - 1))).withColumn("role", F.lit(0))
    others = members.withColumn("i", F.explode(F.sequence(F.lit(0), count("minor") - 1))).withColumn("role", F.lit(1))
    return scratch.write(own.unionByName(others).select(*CELL, "role", "doc_id", "label", (F.col("label") == F.col("major")).alias("in_major")), "cells")


def _streamed(cells: DataFrame, *payload: str) -> DataFrame:
    return cells.select(*CELL, "role", "doc_id", "label", "in_major", *payload).repartition(*CELL).sortWithinPartitions(*CELL, "role")


def _cross_candidates(cells: DataFrame, reps: DataFrame, percent: int, dense: int = 4) -> DataFrame:
    """Pairs (a, b, matches) of different labels that their signatures don't rule out, and cells with too many such pairs.

    A cell gives at most ``dense`` pairs for each of its members as rows; one
    with more is named by its place, with null ``a``, to be verified as it is.
    """
    sigs = reps.select(F.col("doc_id").alias("sig_id"), "sig")
    rows = _streamed(cells.join(sigs.hint("merge"), F.col("doc_id") == F.col("sig_id")), "sig")

    def stream(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        types = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()
        names = ["a", "b", "matches", *CELL]
        place, cell, members, pairs, out = None, None, 0, [], []

        def close() -> None:
            # a list that stopped growing isn't whole, so its cell is verified in place whatever its members
            out.extend(pairs if len(pairs) <= min(dense * members, most) else [(None, None, None, *place)])
            pairs.clear()

        for batch in batches:
            for *at, role, doc_id, label, in_major, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    if place:
                        close()
                    place, cell, members = at, _Cell(at[0], percent), 0
                members += 1
                if role == 0:
                    cell.add(doc_id, label, sig)
                elif len(pairs) <= most:
                    pairs += [(cell.ids[k], doc_id, int(m), *place) for k, m in zip(*cell.partners(doc_id, label, sig, in_major), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)
            out.clear()
        if place:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)

    most = 1 << 16  # pairs in memory
    return rows.mapInArrow(stream, "a long, b long, matches int, band int, key long, i int, j int")


def _dense_links(cells: DataFrame, places: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join labels, verified inside the cells named by ``places``; pairs that a cell's links have joined by then are passed over."""
    named = places.select(*[F.col(c).alias(f"p_{c}") for c in CELL])
    wanted = cells.join(named.hint("merge"), [F.col(c) == F.col(f"p_{c}") for c in CELL])
    rows = _streamed(wanted.join(texts.select(F.col("doc_id").alias("t"), "sig", "text").hint("merge"), F.col("doc_id") == F.col("t")), "sig", "text")

    def stream(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        place, cell, sets, above = None, None, [], {}

        def top(label: int) -> int:
            while (up := above.get(label, label)) != label:
                above[label] = above.get(up, up)
                label = up
            return label

        for batch in batches:
            out: list[tuple[int, int]] = []
            for *at, role, doc_id, label, in_major, sig, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    place, cell, sets, above = at, _Cell(at[0], percent), [], {}
                if role == 0:
                    cell.add(doc_id, label, sig)
                    sets.append(shingles(text))
                    continue
                own = None
                for k in cell.partners(doc_id, label, sig, in_major)[0]:
                    if top(cell.labels[k]) == top(label):
                        continue
                    own = shingles(text) if own is None else own
                    if similar(sets[k], own, percent):
                        out.append((cell.ids[k], doc_id))
                        above[top(cell.labels[k])] = top(label)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(stream, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, n: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id that links reach), kept.

    1. Features of each text are stored.  Equal sets make a class, whose least
       doc_id stands for it; only these go on.
    2. In each bucket of a band every member is paired with the least member and
       verified.  That star joins most of a large group with few pairs.
    3. Where a bucket's members still have different labels, the pairs between
       labels are compared by signatures, block by block.  Where most pairs of a
       cell of two blocks aren't pruned, the cell is verified in place; else its
       pairs are: first the most promising of each document and foreign label,
       then all that labels haven't joined by then.

    So a link is lost only if a pair shares no band or is pruned, with the
    probabilities at the top of this module.

    A null text or one without words has no shingles and is linked with nothing.
    A row with a null ``doc_id`` can't be named in a link: it is linked with
    nothing and kept; ids are cast to long, null if that can't be.  Rows that
    repeat a ``doc_id`` are one document.  A very long text takes memory for its
    words and shingles, one text at a time.  An empty table gives no rows.  Only
    ``doc_id`` and ``text`` are read.

    Sets are sets of 64-bit hashes of shingles: two different shingles of a pair
    of documents with 10,000 each have equal hashes with probability 1e-11.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    docs = docs.select(F.expr("try_cast(doc_id as long)").alias("doc_id"), "text")
    made = scratch.write(features(docs, n), "features")
    full = made.where("doc_id is not null and n_shingles > 0")
    classes = scratch.write(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")  # stored, so that the join can split a large class
    member = full.select("doc_id", "d1", "d2").join(classes.hint("merge"), ["d1", "d2"]).groupBy("doc_id").agg(F.min("rep").alias("rep"))
    member = scratch.write(member, "members")
    reps = full.join(member.where("doc_id = rep").select(F.col("doc_id").alias("r")).hint("merge"), F.col("doc_id") == F.col("r")).select("doc_id", "sig").dropDuplicates(["doc_id"])
    reps = scratch.write(reps, "representatives")

    def band_rows(rows: list) -> Iterator[tuple]:
        for doc_id, sig in rows:
            for k, key in enumerate(bands(np.frombuffer(sig, np.uint32)).tolist()):
                yield k, key, doc_id

    in_bands = map_rows(reps, band_rows, "band int, key long, doc_id long", flush_rows=1 << 15)
    in_bands = scratch.write(in_bands, "bands")
    least = scratch.write(in_bands.groupBy("band", "key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "hubs")
    buckets = scratch.write(in_bands.join(least.hint("merge"), ["band", "key"]), "buckets")
    pairs = scratch.write(buckets.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    wanted = buckets.select("doc_id").distinct().join(reps.hint("merge"), "doc_id").select(F.col("doc_id").alias("w"), "sig")
    texts = docs.join(wanted.hint("merge"), F.col("doc_id") == F.col("w")).select("doc_id", "sig", "text")
    texts = scratch.write(texts.dropDuplicates(["doc_id"]) if _repeats(full) else texts, "texts")
    links = scratch.write(_verified(pairs, texts, percent, scratch, "star"), "links")
    labels = components(links, scratch, "star")
    cells = _mixed_cells(buckets, labels, scratch, block=256)
    if cells is not None:
        cross = scratch.write(_cross_candidates(cells, reps, percent), "cross")
        places = cross.where("a is null")
        if not places.isEmpty():
            links = links.unionByName(scratch.write(_dense_links(cells, places, texts, percent), "dense"))
            labels = components(links, scratch, "dense")
        few = cross.where("a is not null").select("a", "b", "matches")
        labels = _joined(scratch.write(few.join(pairs.hint("merge"), ["a", "b"], "left_anti"), "few"), links, labels, texts, percent, scratch)
    labels = scratch.write(labels, "labels")
    scratch.keep("features", "members", "labels")
    known = member.join(labels.hint("merge"), F.col("rep") == F.col("node"), "left").select(F.col("doc_id").alias("m"), F.coalesce("label", "rep").alias("component"))
    out = made.join(known.hint("merge"), F.col("doc_id") == F.col("m"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _repeats(full: DataFrame) -> bool:
    return not full.groupBy("doc_id").count().where("count > 1").isEmpty()


def _joined(cross: DataFrame, links: DataFrame, labels: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Labels after verifying the pairs of ``cross``: the best per document and foreign label, then all that is still apart."""
    for at in range(2):
        if cross.isEmpty():
            break
        name = lambda side: labels.select(F.col("node").alias(f"n{side}"), F.col("label").alias(f"l{side}")).hint("merge")
        apart = cross.join(name("a"), F.col("a") == F.col("na"), "left").join(name("b"), F.col("b") == F.col("nb"), "left")
        apart = apart.select("a", "b", "matches", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).where("la <> lb")
        apart = scratch.write(apart, f"apart-{at}")
        if at == 0:
            chosen = apart.groupBy("a", "lb").agg(F.max(F.struct("matches", "b")).alias("best")).select("a", "best.b")
        else:
            chosen = apart.select("a", "b")
        found = scratch.write(_verified(chosen.distinct(), texts, percent, scratch, f"cross-{at}"), f"found-{at}")
        cross = scratch.write(apart.select("a", "b", "matches").join(chosen.hint("merge"), ["a", "b"], "left_anti"), f"cross-{at}") if at == 0 else cross
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links, scratch, f"cross-{at}")
    return labels


def clean(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, its columns as they were; a repeated id stays once, rows without an id stay all."""
    judged = near_duplicates(docs, percent)
    key = unused("kept", docs.columns)
    keep = judged.where("kept and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    own = F.expr("try_cast(doc_id as long)")
    out = docs.join(keep.hint("merge"), own == F.col(key), "left_semi")
    if _repeats(docs.select("doc_id").where("doc_id is not null")):
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where(own.isNull()))
