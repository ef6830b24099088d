"""Exact removal of repeated byte strings by a distributed merge sort of anchored suffixes.

A byte is removed if a string of ``LENGTH`` bytes (a window) that covers it also
starts earlier in the corpus.  Sorting a suffix for each byte would ship the
corpus a hundred times over, so suffixes are taken at *anchors*: each window
elects, of the ``GRAM``-byte strings inside it, the one of least hash.  The
choice depends on the window's bytes alone, so equal windows elect equal grams
at the same place, and each window belongs to one anchor.  An anchor's entry is
the suffix from it on, to the end of the last window that it owns, and after it
the bytes before the anchor, read backwards.

1. Hashes of grams find the anchors that can be left out: one whose gram occurs
   nowhere else owns no repeated window.  That is all that hashes decide.
2. The other anchors' entries are dealt by gram to cells, as front-coded sorted
   runs: each entry has the length of the prefix that it shares with the one
   before.  A cell's runs are merged by a loser tree that keeps the prefixes
   already known to be shared and compares bytes beyond them only.  The shared
   lengths give the verdicts: two entries that share all are one context, and
   all but its first place go; where neighbours share at least a gram, the
   shared lengths before and behind the anchor bound the windows that both have.
3. A gram with very many different contexts is wide, which the counts of step 1
   tell.  Each of its windows is an entry by itself, dealt by its own bytes, and
   the same merge brings equal ones together, one place in memory at a time.

Whatever is removed was compared byte by byte with an earlier place.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows

LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1  # in a window
BUFFER, SEGMENT = 1 << 19, 1 << 18  # bytes hashed at once, and of a long text
CELL = 1 << 23  # bytes of text whose anchors meet in one cell, on average
CROWD, WIDE = 64, 4096  # different contexts of a gram in one batch, and in all, from which on it is wide
HELD = 1 << 17  # entries of a batch that are sorted at once
NO_ID = -(1 << 63)  # stands for a null doc_id, and sorts first
TIE = 30  # hexadecimal digits of a text's SHA-256 that tell documents of one id apart

REPEATED, SHARED, SPREAD = 1, 2, 3  # what is known of an anchor; 0: its gram is nowhere else


# --- anchors ---------------------------------------------------------------


@dataclass
class Anchors:
    doc: np.ndarray  # index of the text
    number: np.ndarray  # of the anchor in its text
    at: np.ndarray  # place of the gram in the text
    lo: np.ndarray  # first and last start of the windows that it owns
    hi: np.ndarray
    gram: np.ndarray  # hashes of the gram and of the context
    context: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    up, down = np.full(BUFFER, base, np.uint64), np.full(BUFFER, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def anchors(texts: list[bytes]) -> Anchors:
    """The anchors of each text, in order.  Long texts are taken in segments of window starts, at places that depend on the text alone."""
    pieces = [(d, s, t[s : s + SEGMENT + LENGTH - 1]) for d, t in enumerate(texts) for s in range(0, max(1, len(t) - LENGTH + 1), SEGMENT) if len(t) >= LENGTH]
    found, at = [], 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and size + len(pieces[end][2]) <= BUFFER:
            size += len(pieces[end][2])
            end += 1
        found.append(_in_buffer(pieces[at:end]))
        at = end
    cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    doc, place, lo, hi, gram, context = cols
    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
    number = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
    return Anchors(doc, number, place, lo, hi, gram, context)


def _in_buffer(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    b = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    n = len(b)
    up, down = _powers()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    gram = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # least hash in each window, the leftmost on ties: hash and place in one number, minima from both sides of blocks
    mask = np.uint64(BUFFER - 1)
    key = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
    blocks = np.concatenate([key, np.full(-len(key) % GRAMS, np.iinfo(np.uint64).max)]).reshape(-1, GRAMS)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    elected = (np.minimum(back[:windows], ahead[GRAMS - 1 : GRAMS - 1 + windows]) & mask).astype(np.int64)
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(pieces)), sizes)[:windows]
    inside = np.flatnonzero(np.arange(windows) + LENGTH <= ends[owner])  # windows in one piece
    new = np.flatnonzero(np.concatenate([[True], (np.diff(elected[inside]) != 0) | (np.diff(inside) != 1)]))
    lo, hi = inside[new], inside[np.append(new[1:], len(inside)) - 1]
    place, piece = elected[lo], owner[lo]
    size = (hi - lo + LENGTH).astype(np.uint64)
    context = _mix((sums[hi + LENGTH] - sums[lo]) * down[lo] + _mix((place - lo).astype(np.uint64) << np.uint64(32) | size))
    docs, bases = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
    shift = bases[piece] - starts[piece]
    return docs[piece], place + shift, lo + shift, hi + shift, gram[place], context


# --- blobs of equally long arrays --------------------------------------------


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of integers with their least sufficient unsigned types, or 64 signed bits."""
    out = []
    for c in columns:
        c = c.astype(np.int64 if len(c) and int(c.min()) < 0 else np.min_scalar_type(int(c.max()) if len(c) else 0))
        out.append(struct.pack("<cI", c.dtype.char.encode(), c.nbytes) + c.tobytes())
    return b"".join(out)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n = struct.unpack_from("<cI", blob, at)
        at += 5
        out.append(np.frombuffer(blob, np.dtype(kind.decode()), n // np.dtype(kind.decode()).itemsize, at).astype(np.int64))
        at += n
    return out


def _ties(ties: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The halves of hexadecimal ties, as numbers in the same order; zero for empty ones."""
    halves = [(int(t[: TIE // 2], 16), int(t[TIE // 2 :], 16)) if t else (0, 0) for t in ties]
    return tuple(np.array([h[k] for h in halves], np.int64) for k in (0, 1))


def _tie(high: int, low: int) -> str:
    return f"{high:0{TIE // 2}x}{low:0{TIE // 2}x}" if high or low else ""


# --- 1: grams ---------------------------------------------------------------


def _dealt(gram: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, 40 bits of another hash) of elected grams, whose own hashes are all small."""
    mixed = _mix(gram + np.uint64(0x9E3779B97F4A7C15))
    return ((mixed >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64), mixed & np.uint64((1 << 40) - 1)


def _sent_grams(cells: int, crowd: int):  # noqa: ANN202
    def run(rows: list) -> Iterator[tuple]:
        rows = sorted(((d, tie, t.encode("utf-8", "surrogatepass")) for d, tie, t in rows), key=lambda r: r[:2])
        nth: dict[tuple[int, str], int] = {}  # rows that share an id and a tie share a text
        for d, tie, _ in rows:
            nth.setdefault((d, tie), len(nth))
        own = {nth[d, tie]: t for d, tie, t in rows}
        texts = [own[k] for k in range(len(nth))]
        ids = np.array([k[0] for k in nth], np.int64)
        high, low = _ties([k[1] for k in nth])
        a = anchors(texts)
        order = np.lexsort((a.context, a.gram))  # stable: by document and place within equal contexts
        gram, context = a.gram[order], a.context[order]
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, bool)
        new = new_gram.copy()
        new[1:] |= context[1:] != context[:-1]
        again = np.flatnonzero(~new)
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[again]] if len(again) else again
        places = a.doc, a.lo, a.hi
        columns = [p[x].tolist() for x in (order[again], first) for p in places]
        # equal hashes: the bytes tell
        differ = [k for k, (d, i, j, e, u, v) in enumerate(zip(*columns, strict=True)) if texts[d][i : j + LENGTH] != texts[e][u : v + LENGTH]]
        new[again[differ]] = True
        gone = order[~new]
        group = np.cumsum(new_gram) - 1
        wide = np.bincount(group, weights=new)[group] >= crowd if len(gram) else np.empty(0, bool)
        sent, spread = order[new & ~wide], order[new & wide]
        codes: dict[int, list[int]] = {}
        for state, xs in ((REPEATED, gone), (SPREAD, spread)):
            for d, n in zip(a.doc[xs].tolist(), a.number[xs].tolist(), strict=True):
                codes.setdefault(d, []).append(4 * n + state)
        for d, tie, t in rows:
            k = nth[d, tie]
            yield None, d, tie, len(t), hashlib.sha256(t).digest(), codes.get(k, []), None
        if not len(gram):
            return
        marks = gram[new_gram & wide]  # number 0: the gram is wide in this batch
        at, rest = _dealt(np.concatenate([a.gram[sent], marks]), cells)
        base = int(ids[0])
        doc, none = a.doc[sent], np.zeros(len(marks), np.int64)
        columns = [rest, np.concatenate([(a.context[sent] >> np.uint64(48)).astype(np.int64), none]), *(np.concatenate([c, none]) for c in (ids[doc] - base, high[doc], low[doc], a.number[sent] + 1))]
        o = np.argsort(at, kind="stable")
        columns, at = [c[o] for c in columns], at[o]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            rest, *others = (c[i:j] for c in columns)
            yield int(at[i]), base, None, None, None, None, _packed((rest >> np.uint64(32)).astype(np.int64), (rest & np.uint64(0xFFFFFFFF)).astype(np.int64), *others)

    return run


SENT = "cell int, doc_id long, tie string, n_bytes long, sha binary, codes array<long>, run binary"
TOLD = "doc_id long, tie string, n_bytes long, sha binary, codes array<long>"


def _compared_grams(wide: int):  # noqa: ANN202
    """Rows of documents pass; a cell's runs are put together and answered by (document, codes)."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.string()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("codes", pa.list_(pa.int64()))])

        def answer(runs: list[tuple[int, bytes]]) -> pa.RecordBatch:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for base, blob in runs:
                top, rest, c, d, high, low, x = _unpacked(blob)
                for to, col in zip(cols, (top << 32 | rest, c, d + base, high, low, x), strict=True):
                    to.append(col)
            g, c, d, high, low, x = map(np.concatenate, cols)
            o = np.lexsort((c, g))
            g, c, d, high, low, x = g[o], c[o], d[o], high[o], low[o], x[o]
            new = np.concatenate([[True], g[1:] != g[:-1]])
            group = np.cumsum(new) - 1
            differs = new.copy()
            differs[1:] |= c[1:] != c[:-1]
            mark = x == 0
            spread = (np.bincount(group, weights=mark)[group] > 0) | (np.bincount(group, weights=differs)[group] >= wide)
            state = np.where(spread, SPREAD, np.where(np.bincount(group)[group] > 1, SHARED, 0))
            tell = np.flatnonzero((state > 0) & ~mark)
            o = tell[np.lexsort((low[tell], high[tell], d[tell]))]
            d, high, low, code = d[o], high[o], low[o], 4 * (x[o] - 1) + state[o]
            first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(d) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(d)), pa.int32()), pa.array(code, pa.int64()))
            ties = pa.array([_tie(h, w) for h, w in zip(high[first].tolist(), low[first].tolist(), strict=True)], pa.string())
            n = len(first)
            return pa.RecordBatch.from_arrays([pa.array(d[first], pa.int64()), ties, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), lists], schema=schema)

        runs: dict[int, list] = {}
        for batch in batches:
            own = pc.is_null(batch.column("cell"))
            docs = batch.filter(own)
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([docs.column(f.name).cast(f.type) for f in schema], schema=schema)
            rest = batch.filter(pc.invert(own))
            for cell, base, blob in zip(rest.column("cell").to_pylist(), rest.column("doc_id").to_pylist(), rest.column("run").to_pylist(), strict=True):
                runs.setdefault(cell, []).append((base, blob))
        while runs:
            yield answer(runs.popitem()[1])

    return run


# --- 2: front-coded runs of entries, and their merge ------------------------------


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8 if x else n


def front_coded(entries: list[tuple[bytes, list[int]]], columns: int) -> bytes:
    """A sorted run: for each string the length it shares with the one before, its length and its other bytes; then the columns of its data."""
    prefix, sizes, rest, before = [], [], [], b""
    for s, _ in entries:
        known = shared(before, s, 0)
        prefix.append(known)
        sizes.append(len(s) - known)
        rest.append(s[known:])
        before = s
    data = [np.array([e[1][k] for e in entries], np.int64) for k in range(columns)]
    return _packed(np.array(prefix, np.int64), np.array(sizes, np.int64), np.frombuffer(b"".join(rest), np.uint8), *data)


def decoded(blob: bytes) -> Iterator[tuple[bytes, int, tuple[int, ...]]]:
    """(string, length shared with the one before, data)."""
    prefix, sizes, rest, *data = _unpacked(blob)
    rest, before, at = rest.astype(np.uint8).tobytes(), b"", 0
    for known, n, *own in zip(prefix.tolist(), sizes.tolist(), *(c.tolist() for c in data), strict=True):
        before = before[:known] + rest[at : at + n]
        at += n
        yield before, known, tuple(own)


def merged(runs: list[Iterator[tuple[bytes, int, tuple]]]) -> Iterator[tuple[bytes, int, int, tuple]]:
    """Merges sorted runs: (string, length shared with the last, run, data).

    A loser tree whose entries know how much they share with the last string
    out.  Of two entries the one that shares more is less; only if both share
    the same length are bytes compared, from there on.  The loser then knows
    what it shares with the winner, and stays where that winner passes next.
    """
    k = len(runs)
    heads: list = [next(r, None) for r in runs]
    known = [0] * k
    losers = [-1] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser)"""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        n = shared(a[0], b[0], known[i])
        if a[0][n:] < b[0][n:] or (len(a[0]) == n == len(b[0]) and i < j):
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    if not k:
        return
    winner = build(1) if k > 1 else 0
    while (head := heads[winner]) is not None:
        yield head[0], known[winner], winner, head[2]
        heads[winner] = following = next(runs[winner], None)
        known[winner] = following[1] if following else 0
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _entry(b: bytes, at: int, lo: int, hi: int) -> bytes:
    """An anchor's suffix, the bytes before it backwards, and the suffix's length, which keeps different cuts of the same bytes apart."""
    return b[at : hi + LENGTH] + b[lo:at][::-1] + bytes([hi + LENGTH - at])


def _sent_entries(cells: int, held: int = HELD):  # noqa: ANN202
    """Of a batch of (doc_id, tie, text, codes): ranges of window starts that are known to be repeated, and runs of entries."""

    def run(rows: list) -> Iterator[tuple]:
        rows = sorted(((d, tie, t.encode("utf-8", "surrogatepass"), codes) for d, tie, t, codes in rows), key=lambda r: r[:2])
        base = rows[0][0] if rows[-1][0] - rows[0][0] < 1 << 62 else 0
        contexts: dict[bytes, tuple] = {}
        windows: dict[bytes, tuple] = {}

        def flushed() -> Iterator[tuple]:
            dealt: dict[tuple[int, int], list] = {}
            for s, (cell, *data) in contexts.items():
                dealt.setdefault((cell, SHARED), []).append((s, data))
            for w, data in windows.items():
                dealt.setdefault((xxhash.xxh3_64_intdigest(w) * cells >> 64, SPREAD), []).append((w, data))
            contexts.clear(), windows.clear()
            for (cell, kind), entries in dealt.items():
                entries.sort()
                yield cell, base, None, None, None, kind, front_coded(entries, 6 if kind == SHARED else 4)

        every = anchors([r[2] for r in rows])
        starts = np.searchsorted(every.doc, np.arange(len(rows) + 1))
        for k, (doc_id, tie, b, codes) in enumerate(rows):
            code = np.unique(np.asarray(codes, np.int64))
            number, state = code >> 2, code & 3
            # the last code of an anchor counts; codes of an equal row can repeat
            last = np.append(number[1:] != number[:-1], True)
            number, state = number[last], state[last]
            at, lo, hi = (c[starts[k] : starts[k + 1]][number] for c in (every.at, every.lo, every.hi))
            cell, _ = _dealt(every.gram[starts[k] : starts[k + 1]][number], cells)
            (high,), (low,) = (c.tolist() for c in _ties([tie]))
            gone: list[tuple[int, int]] = []
            for s, a, i, j, c in zip(state.tolist(), at.tolist(), lo.tolist(), hi.tolist(), cell.tolist(), strict=True):
                if s == REPEATED:
                    gone.append((i, j))
                elif s == SHARED:
                    own = (c, doc_id - base, high, low, i, j, a - i)
                    if contexts.setdefault(_entry(b, a, i, j), own)[1:5] != own[1:5]:
                        gone.append((i, j))
                else:
                    for p in range(i, j + 1):
                        own = (doc_id - base, high, low, p)
                        if windows.setdefault(b[p : p + LENGTH], own) != own:
                            gone.append((p, p))
                if len(contexts) + len(windows) >= held:
                    yield from flushed()
            for i, j in _joined(gone):
                yield None, doc_id, tie, i, j, None, None
        yield from flushed()

    return run


def _joined(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Ranges of starts, those that touch put together."""
    ranges.sort()
    first = last = None
    for i, j in ranges:
        if first is None:
            first, last = i, j
        elif i <= last + 1:
            last = max(last, j)
        else:
            yield first, last
            first, last = i, j
    if first is not None:
        yield first, last


RUNS = "cell int, doc_id long, tie string, first long, last long, kind int, run binary"
FOUND = "doc_id long, tie string, first long, last long"


class _Group:
    """The different contexts of one gram, in the order of the merge."""

    def __init__(self) -> None:
        self.entries: list[tuple[bytes, int, int]] = []  # entry, length of its suffix, length shared with the one before
        self.places: list[tuple[int, int, int, int, int, int]] = []  # the first place: document, tie, first and last window, bytes before the anchor

    def repeated(self) -> Iterator[tuple[tuple, int, int]]:
        """(place, first, last): windows that an earlier place has too."""
        if len(self.entries) > 8:
            yield from self._by_length()
        elif len(self.entries) > 1:
            yield from self._by_pairs()

    def _own(self, k: int) -> tuple[int, int]:
        """Least and greatest number of bytes before the anchor in the windows that a place owns."""
        *_, i, j, left = self.places[k]
        return left - (j - i), left

    def _by_pairs(self) -> Iterator[tuple[tuple, int, int]]:
        for k in range(len(self.entries)):
            behind = self.entries[k][1]
            for m in range(k + 1, len(self.entries)):
                s, size, both = self.entries[m]
                behind = min(behind, both)
                reach = min(behind, size)  # bytes that both suffixes share
                (a, b), (c, d) = self._own(k), self._own(m)
                before = shared(self.entries[k][0][self.entries[k][1] : -1], s[size:-1], 0)
                low, high = max(LENGTH - reach, a, c), min(before, b, d)
                if low <= high:
                    later = max(self.places[k], self.places[m])
                    anchor = later[3] + later[5]
                    yield later, anchor - high, anchor - low

    def _by_length(self) -> Iterator[tuple[tuple, int, int]]:
        """For each number of bytes before the anchor: neighbours that share the rest of the window behind it form runs, and equal bytes before it classes in a run."""
        own = [self._own(k) for k in range(len(self.entries))]
        for n in range(min(a for a, _ in own), max(b for _, b in own) + 1):
            firsts: dict[tuple[int, bytes], tuple] = {}
            nth = 0
            for (s, size, both), place, (a, b) in zip(self.entries, self.places, own, strict=True):
                nth += both < LENGTH - n
                if not a <= n <= b:
                    continue
                key = nth, s[size : size + n]
                first = firsts.setdefault(key, place)
                if first is not place:
                    firsts[key], later = (first, place) if first < place else (place, first)
                    yield later, later[3] + later[5] - n, later[3] + later[5] - n


def compared_contexts(runs: list[tuple[int, bytes]]) -> Iterator[tuple[tuple, int, int]]:
    """(place, first, last) of the windows in merged runs of contexts that an earlier place has too."""
    bases, group = [r[0] for r in runs], _Group()
    for s, known, r, (d, *rest) in merged([decoded(r[1]) for r in runs]):
        place = (d + bases[r], *rest)
        if known == len(s) and group.entries:  # the same context: all but the first place go
            first = group.places[-1]
            if place[:4] != first[:4]:
                group.places[-1], later = (first, place) if first < place else (place, first)
                yield later, later[3], later[4]
            continue
        if known < GRAM:
            yield from group.repeated()
            group = _Group()
        group.entries.append((s, s[-1], known))
        group.places.append(place)
    yield from group.repeated()


def compared_windows(runs: list[tuple[int, bytes]]) -> Iterator[tuple[tuple, int, int]]:
    """The same of merged runs of single windows; one place is held."""
    bases, first = [r[0] for r in runs], None
    for s, known, r, (d, *rest) in merged([decoded(r[1]) for r in runs]):
        place = (d + bases[r], *rest)
        if known < len(s) or first is None:
            first = place
        elif place != first:
            first, later = (first, place) if first < place else (place, first)
            yield later, later[3], later[3]


def _compared_entries(batches):  # noqa: ANN001, ANN202
    import pyarrow as pa

    types = pa.int64(), pa.string(), pa.int64(), pa.int64()
    out: list[tuple] = []

    def rows() -> pa.RecordBatch:
        by_doc: dict[tuple, list] = {}
        for place, i, j in out:
            by_doc.setdefault(place[:3], []).append((i, j))
        out.clear()
        made = [(d, _tie(high, low), i, j) for (d, high, low), found in by_doc.items() for i, j in _joined(found)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], t) for i, t in enumerate(types)], names=["doc_id", "tie", "first", "last"])

    runs: dict[tuple[int, int], list] = {}
    for batch in batches:
        own = batch.filter(batch.column("cell").is_null())
        if own.num_rows:
            yield own.select(["doc_id", "tie", "first", "last"])
        rest = batch.filter(batch.column("cell").is_valid())
        for cell, doc_id, kind, run in zip(*(rest.column(c).to_pylist() for c in ("cell", "doc_id", "kind", "run")), strict=True):
            runs.setdefault((cell, kind), []).append((doc_id, run))
    while runs:
        (_, kind), parts = runs.popitem()
        for found in (compared_contexts if kind == SHARED else compared_windows)(parts):
            out.append(found)
            if len(out) > 100_000:
                yield rows()
    yield rows()


# --- the operator -----------------------------------------------------------


def _cut(rows: list) -> Iterator[tuple]:
    for doc_id, text, ranges in rows:
        b = text.encode("utf-8", "surrogatepass")
        spans: list[list[int]] = []
        for i, j in sorted((r["first"], r["last"]) for r in ranges):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], j + LENGTH)
            else:
                spans.append([i, j + LENGTH])
        kept, done = hashlib.sha256(), 0
        for i, j in spans:
            kept.update(b[done:i])
            done = j
        kept.update(b[done:])
        yield (None if doc_id == NO_ID else doc_id), len(b), sum(j - i for i, j in spans), len(spans), kept.hexdigest(), [x for s in spans for x in s]


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def deduplicate(docs: DataFrame, crowd: int = CROWD, wide: int = WIDE, cell_bytes: int = CELL) -> DataFrame:
    """One row per document: bytes, bytes removed, maximal removed runs, digest of what is left, and the runs' ends.

    Earlier is by ``doc_id``, then by start; strings never cross documents and
    are judged on the input.  Texts are UTF-8.  A null or empty text has no
    bytes; texts under ``LENGTH`` bytes lose nothing.  ``doc_id`` is cast to
    long; null, and what can't be cast, sorts before all others.  Documents that
    share a ``doc_id`` but not the text come in the order of their texts' SHA-256.
    Rows that share both are one place: they lose the same bytes, and none to
    each other.  An empty table gives no rows.  Other columns are ignored.

    Cells grow in number with the bytes of all texts, so that a task holds the
    runs of some ``cell_bytes`` of text at any size of the corpus; what equal
    contexts or windows add to a cell is at most one entry a batch.  A very long
    text is hashed in segments, and the entries of a batch are sorted and sent
    ``HELD`` at a time; a task holds the texts of an Arrow batch, or one text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    base = docs.select(F.coalesce(F.expr("try_cast(doc_id as long)"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 + n_bytes // cell_bytes
    # Ids that several rows have are told apart by their texts.
    several = scratch.write(base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("s")), "several")
    if several.isEmpty():
        texts = base.select("doc_id", F.lit("").alias("tie"), "text")
    else:
        tie = F.when(F.col("s").isNotNull(), F.left(F.sha2("text", 256), F.lit(TIE))).otherwise(F.lit(""))
        texts = base.join(several, base["doc_id"] == several["s"], "left").select("doc_id", tie.alias("tie"), "text")
    deal = lambda df: df.repartitionById(cells, F.coalesce("cell", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(cells)).cast("int")))
    told = deal(map_rows(texts, _sent_grams(cells, crowd), SENT, flush_rows=64)).mapInArrow(_compared_grams(wide), TOLD)
    known = told.groupBy("doc_id", "tie").agg(F.flatten(F.collect_list("codes")).alias("codes"), F.max("n_bytes").alias("n_bytes"), F.count("n_bytes").alias("n"), F.first("sha", ignorenulls=True).alias("sha"))
    known = scratch.write(known, "known")
    on = lambda side: [F.col("doc_id") == F.col(f"{side}_id"), F.col("tie") == F.col(f"{side}_tie")]
    named = lambda df, side, *cols: df.select(F.col("doc_id").alias(f"{side}_id"), F.col("tie").alias(f"{side}_tie"), *cols)
    coded = texts.join(named(known.where(F.size("codes") > 0), "k", "codes").hint("merge"), on("k")).select("doc_id", "tie", "text", "codes")
    found = deal(map_rows(coded, _sent_entries(cells), RUNS, flush_rows=256)).mapInArrow(_compared_entries, FOUND)
    ranges = scratch.write(found.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "ranges")
    # a text without a repeat is done
    whole = known.join(named(ranges, "r").hint("merge"), on("r"), "left_anti")
    whole = whole.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lower(F.hex("sha")).alias("kept_sha256"), F.array().cast("array<long>").alias("spans"), F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")
    rows = texts.join(named(ranges, "r", "ranges").hint("merge"), on("r")).select("doc_id", "text", "ranges")
    return whole.unionByName(map_rows(rows, _cut, REPORT))
