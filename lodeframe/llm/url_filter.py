"""URL verdicts: longest matching rule, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, map_rows

#: Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Words of unwanted and of wanted hosts and pages, from which the small labelled table is made.
UNWANTED = "casino poker jackpot betting slots lottery roulette bingo gambling wager pills pharmacy viagra cialis tramadol steroids discount replica counterfeit payday loans bitcoin-doubler free-money get-rich adult xxx porn escort webcam hookup torrent warez crack keygen serial nulled proxy-list followers clickbait popup tracker".split()
WANTED = "news library museum university school science journal weather garden kitchen travel history music forum docs wiki health council research archive blog therapy nation thread recipes physics biology railway parliament theatre orchestra cycling hiking gallery bakery pottery astronomy geology hospital village".split()

#: Shapes of host and path, as they are common on the web; {w} and {v} are words, {n} a number, {y} a year.
SHAPES = (
    ("www.{w}.com", "/"),
    ("{w}.org", "/{v}/{y}/{n}"),
    ("www.{w}-{v}.co.uk", "/articles/{w}-{n}.html"),
    ("blog.{w}.net", "/{y}/05/{v}-{w}/"),
    ("{w}{n}.info", "/index.php"),
    ("shop.{w}.de", "/p/{n}-{w}"),
    ("the{w}{v}.com", "/category/{w}"),
    ("m.{w}online.com", "/view/{n}"),
    ("cdn.{v}.io", "/{w}/{w}.html"),
    ("best-{w}.biz", "/{v}"),
    ("{w}.{v}.com", "/en/{n}"),
    ("my{w}.fr", "/{y}/{w}.htm"),
)


def neutral_names(n: int) -> list[str]:
    """Made-up names of two to four syllables, a consonant and a vowel each, from a fixed seed."""
    rng = np.random.Generator(np.random.PCG64(7))
    return ["".join(rng.choice(list("bcdfghklmnprstvwz")) + rng.choice(list("aeiou")) + rng.choice(["", "", "n", "r", "s"]) for _ in range(rng.integers(2, 5))) for _ in range(n)]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table (url, label 1 = unwanted, word): each word in nine shapes, and made-up names in two as wanted ones."""
    rows = []
    for label, own in ((1, UNWANTED), (0, WANTED), (0, neutral_names(300))):
        for i, w in enumerate(own):
            v = own[(i + 7) % len(own)]
            for k in range(9 if len(own) < 100 else 2):
                host, path = SHAPES[(5 * i + 7 * k) % len(SHAPES)]
                values = {"w": w, "v": v, "n": (37 * i + 211 * k) % 997, "y": 2005 + (i + k) % 20}
                rows.append((f"https://{host.format(**values)}{path.format(**values)}", label, w))
    return spark.createDataFrame(rows, "url string, label int, word string")


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null or for no ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def by_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and starts the path; else nulls."""
    ranked = sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ranked]
    chain = lambda values: reduce(lambda c, x: c.when(*x), zip(fits, map(F.lit, values), strict=True), F)
    if not ranked:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return chain([f"{h}{p}" for _, h, p in ranked]), chain([v for v, _, _ in ranked])


class NgramModel:
    """Logistic regression on counts of hashed character n-grams, scaled to unit length."""

    def __init__(self, dims: int = 1 << 13, grams: tuple[int, ...] = (3, 4, 5)) -> None:
        self.dims, self.grams, self.w, self.b = dims, grams, np.zeros(dims), 0.0

    def features(self, host: str, path: str) -> np.ndarray:
        found = []
        for mark, part in (("h", f"^{host}$"), ("p", f"{path}$")):
            found += [zlib.crc32(f"{mark}{part[i:i + n]}".encode()) % self.dims for n in self.grams for i in range(len(part) - n + 1)]
        return np.asarray(found, np.int64)

    def _vector(self, host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.unique(self.features(host, path), return_counts=True)
        return at, n / np.sqrt((n * n).sum() or 1)

    def fit(self, rows: list[tuple[str, str, int]], rounds: int = 600, rate: float = 4.0, l2: float = 1e-5) -> NgramModel:
        """Accelerated full-batch gradient descent, both labels with the same weight in all: the same rows in any order give the same model, but for rounding."""
        x = np.zeros((len(rows), self.dims))
        for i, (host, path, _) in enumerate(rows):
            at, v = self._vector(host, path)
            x[i, at] = v
        y = np.array([r[2] for r in rows], float)
        share = np.where(y > 0, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum())) / 2
        w, b = self.w, self.b
        for k in range(rounds if len(rows) else 0):
            miss = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
            before = self.w, self.b
            self.w, self.b = w - rate * (x.T @ miss + l2 * w), b - rate * miss.sum()
            pull = k / (k + 3)
            w, b = self.w + pull * (self.w - before[0]), self.b + pull * (self.b - before[1])
        return self

    def score(self, host: str, path: str) -> float:
        at, v = self._vector(host, path)
        return float(1 / (1 + np.exp(-(self.w[at] @ v + self.b))))


def fit(labelled: DataFrame, max_rows: int = 2000) -> NgramModel:
    """Fits on at most ``max_rows`` labelled URLs, the documented bound of what comes to the driver: for each label half of them, the distinct ones of least hash."""
    host, path = parts(F.col("url"))
    known = labelled.select(host.alias("host"), path.alias("path"), "label").distinct()
    rows = [known.where(F.col("label") == label).orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_rows // 2) for label in (0, 1)]
    return NgramModel().fit([tuple(r) for r in rows[0].union(rows[1]).collect()])


def judge(pages: DataFrame, model: NgramModel, rules: Iterable[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """One row per page: host, path, the longest rule that fits, the verdict, and the model's score where no rule fits.

    Only ``page_id`` and ``url`` are read.  A null url or one without ``://`` has
    an empty host and path; no rule fits it and, as there is nothing to judge, it
    is allowed with score 0.  Repeated rows give repeated rows, an empty table
    none.  A very long url is cut to n-grams in its row.  No shuffle.  The
    broadcast model has ``dims`` weights.
    """
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def score(rows: list) -> Iterator[tuple]:
        model = sent.value
        for page_id, host, path, rule, verdict in rows:
            p = None if rule is not None else model.score(host, path) if host or path else 0.0
            yield page_id, host, path, rule, verdict or ("block" if p >= threshold else "allow"), p

    return map_rows(ruled, score, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")
