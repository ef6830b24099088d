"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 13 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
}


def pii(text: str | None) -> dict[str, list[tuple[int, int]]]:
    return {k: [m.span() for m in re.finditer(p, text or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))] for k, (p, ok) in PII.items()}


def pii_base(text: str | None) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, spans in pii(text).items() for a, b in spans)


def quality(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def suffixes(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()
    return out


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    w = WORD.findall(low(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple]:
    sets = {d: shingle_set(t) for d, t in docs}
    least = {d: d for d in sets}

    def find(x: int) -> int:
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text: str | None, items: list[tuple], window: int = 10) -> tuple:
    w, hit, named = BENCH.findall(low(text or "")), set(), set()
    for item, t in items:
        p = BENCH.findall(low(t or ""))
        n = min(window, len(p))
        for i in range(len(p) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == p[i : i + n]:
                    hit |= set(range(j, j + n))
                    named.add(str(item))
    return len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit)


def substrings(docs: list[tuple[int, str | None]], min_words: int = 5, min_run: int = 0) -> dict[int, tuple[str, str]]:
    """doc_id -> (spans, text left)"""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        units = re.split(r"(?<=\n)|(?<=[.!?][ \t])", t or "")
        norm = [re.sub(r"[ \t\n\x0b\f\r]+", " ", u.lower()).strip(" ") for u in units]
        words = [len(n.split(" ")) if n else 0 for n in norm]
        again = []
        for n, k in zip(norm, words, strict=True):
            again.append(k >= min_words and n in seen)
            if k >= min_words:
                seen.add(n)
        gone, spans, i = set(), [], 0
        while i < len(units):
            if not again[i]:
                i += 1
                continue
            j = last = i
            while j + 1 < len(units) and (again[j + 1] or words[j + 1] < min_words):
                j += 1
                last = j if again[j] else last
            if sum(words[i : last + 1]) >= min_run:
                gone |= set(range(i, last + 1))
                a = sum(map(len, units[:i]))
                spans.append(f"{a}:{a + sum(map(len, units[i:last + 1]))}")
            i = last + 1
        out[d] = ",".join(spans), "".join(u for k, u in enumerate(units) if k not in gone)
    return out


def chunk_bounds(every: list[str]) -> list[int]:
    """Ends of chunks: gaps by the rolling hash of the two lines beside them, each taken that leaves no chunk of one line."""
    n = len(every)
    hashes = [xxhash.xxh3_64_intdigest(x.encode()) for x in every]
    order = []
    for gap in range(1, n):
        h = 0
        for line in (gap - 1, gap):
            h = (h + hashes[line]) * 0x9E3779B97F4A7C15 % 2**64
        order.append((h // 2**32, gap))
    taken = {0, n}
    for _, gap in sorted(order):
        if not taken & {gap - 1, gap, gap + 1}:
            taken.add(gap)
    return sorted(taken)


def lines(docs: list[tuple[int, str | None]]) -> dict[int, str]:
    """doc_id -> text left without the chunks that occur earlier"""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        every, left = (t or "").split("\n"), []
        bounds = chunk_bounds(every)
        for a, b in zip(bounds, bounds[1:], strict=False):
            c = "\n".join(every[a:b])
            if b - a > 1 and c.strip("\n"):
                if c in seen:
                    continue
                seen.add(c)
            left += every[a:b]
        out[d] = "\n".join(left)
    return out


def passages(docs: list[tuple[int, str | None]]) -> dict[int, str]:
    """doc_id -> text left without the passages of two lines or more that start earlier too; of empty lines, those beside others go with them"""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        every = (t or "").split("\n")
        gone = set()
        for i in range(len(every) - 1):
            for j in range(i + 2, min(len(every), i + 13) + 1):
                p = tuple(every[i:j])
                if p in seen:
                    gone |= {k for k in range(i, j) if any(every[max(i, k - 1) : min(j, k + 2)])}
            for j in range(i + 2, min(len(every), i + 13) + 1):
                seen.add(tuple(every[i:j]))
        out[d] = "\n".join(x for k, x in enumerate(every) if k not in gone)
    return out


def host_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return low(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host: str, path: str, rules) -> tuple[str | None, str | None]:  # noqa: ANN001
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


class UrlModel:
    """Logistic regression on hashed 3- to 5-grams, refitted by Newton's steps in the space of the rows."""

    def __init__(self, rows: list[tuple[str, str, int]], dims: int = 1 << 13, l2: float = 1e-5) -> None:
        self.dims = dims
        self.x = np.stack([self.vector(h, p) for h, p, _ in rows])
        y = np.array([r[2] for r in rows], float)
        share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        gram = self.x @ self.x.T
        a, b = np.zeros(len(y)), 0.0  # w = x.T @ a
        for _ in range(40):
            p = 1 / (1 + np.exp(-(gram @ a + b)))
            weight = np.maximum(share * p * (1 - p), 1e-12)
            # least squares on the working response, with b unpenalised
            z = gram @ a + b + share * (y - p) / weight
            system = np.block([[gram + np.diag(l2 / weight), np.ones((len(y), 1))], [np.ones((1, len(y))), np.zeros((1, 1))]])
            solved = np.linalg.solve(system, np.append(z, 0))
            a, b = solved[:-1], solved[-1]
        self.w, self.b = self.x.T @ a, b

    def vector(self, host: str, path: str) -> np.ndarray:
        out = np.zeros(self.dims)
        for text in (f"h^{host}$", f"p{path}$"):
            for n in (3, 4, 5):
                for i in range(1, len(text) - n + 1):
                    out[zlib.crc32((text[0] + text[i : i + n]).encode()) % self.dims] += 1
        return out / (np.linalg.norm(out) or 1)

    def score(self, host: str, path: str) -> float:
        return 1 / (1 + np.exp(-(self.vector(host, path) @ self.w + self.b)))


def texts_with_copies(rng, n: int = 60, words: int = 60, sep: str = " ") -> list[tuple[int, str]]:  # noqa: ANN001
    """Made-up texts, some of them copies, edits or mixtures of others."""
    vocabulary = ["".join(rng.choice("aeioutrnslé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out: list[list[str]] = []
    for _ in range(n):
        kind = rng.random()
        w = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(rng.randint(1, 2 * words))]
        if out and kind < 0.2:
            w = list(rng.choice(out))
        elif out and kind < 0.5:
            w = list(rng.choice(out))
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif out and kind < 0.7:
            w = w[: len(w) // 2] + rng.choice(out)[-40:] + w[len(w) // 2 :]
        out.append(w)
    return list(enumerate(sep.join(w) for w in out))


def grouped(pairs) -> dict:  # noqa: ANN001
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
