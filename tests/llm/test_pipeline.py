"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from lodeframe.llm import oracles, queries
from lodeframe.llm.common import Scratch

from . import plain
from .test_operators import check_packing, frame, planted


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(5)]
    docs: list[tuple[int, str]] = []
    for i in range(150):
        body = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 20))) for _ in range(rng.randint(3, 14))]
        kind = rng.random()
        if docs and kind < 0.1:
            body = rng.choice(docs)[1].split("\n")
        elif docs and kind < 0.3:
            body = " ".join(rng.choice(docs)[1].split("\n")).split(" ")
            body[rng.randrange(len(body))] = "changed"
            body = [" ".join(body)]
        elif kind < 0.4:
            body.insert(1, rng.choice(items)[1])
        elif kind < 0.5:
            body = ["too short"]
        elif docs and kind < 0.6:
            body[1:1] = rng.choice(docs)[1].split("\n")
        docs.append((i, "\n".join(body)))
    spark.createDataFrame([(d, t, "en", f"src{d % 3}", len(t)) for d, t in docs] + [(900, None, None, None, None), (901, "", None, "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), dict([*docs, (900, None), (901, "")]), items


def test_stages(spark, folder):
    root, docs, items = folder
    df = spark.read.parquet(f"{root}/documents.parquet")
    columns = df.schema
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, root)
        assert out.schema.names == columns.names
        out.write.parquet(f"{root}/{name}")
        df = spark.read.parquet(f"{root}/{name}")
        before, docs = docs, {r.doc_id: r.text for r in df.collect()}
        if name == "quality rules":
            want = {d: t for d, t in before.items() if not plain.quality(t)[-1]}
        elif name == "line dedup":
            left = plain.passages(list(before.items()))
            want = {d: t for d, t in left.items() if t == before[d] or t.strip("\n")}
        elif name == "MinHash near-dedup":
            kept = plain.near(list(before.items()), 80)
            want = {d: t for d, t in before.items() if kept[d][2]}
        else:
            want = {d: t for d, t in before.items() if not plain.contamination(t, items)[-1]}
        assert docs == want
        seen.append(len(before) > len(docs) or any(before[d] != t for d, t in docs.items()))
    assert all(seen)
    name, stage = corpus_pipeline.STAGES[-1]
    last = stage(spark, df, root).collect()
    check_packing(last, list(docs.items()), 2048)
    ran = corpus_pipeline.run(spark, root).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(ran) == key(last)


def test_lines_go_by_chunks(spark, monkeypatch):
    """Chunks that a rolling hash ends are found first, and what lies in a later one is not searched again; the rest goes all the same."""
    tables, write = {}, Scratch.write

    def spy(self, df, name):  # noqa: ANN001, ANN202
        out = write(self, df, name)
        tables[name] = out.collect()
        return out

    monkeypatch.setattr(Scratch, "write", spy)
    docs, _ = planted(random.Random(3), lengths=range(2, 9), trials=5)
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame(spark, docs), "").collect()} == plain.passages(docs)
    first, later, windows = {}, {}, {}
    for d, t in docs:
        every = t.split("\n")
        bounds = plain.chunk_bounds(every)
        for a, b in zip(bounds, bounds[1:], strict=False):
            at = first.setdefault(tuple(every[a:b]), (d, a))
            if at != (d, a):
                later[d, a] = at
                windows |= {(d, a + i): [(at[0], at[1] + i)] for i in range(b - a - 1)}
    assert later and {(r.doc_id, r.k): tuple(r.first) for r in tables["placed"] if r.first and tuple(r.first) != (r.doc_id, r.k)} == later
    members = plain.grouped(((r.doc_id, r.k), tuple(r.first)) for r in tables["members"])
    assert {at: members[at] for at in windows} == windows


def test_queries_against_sql(spark, folder):
    import duckdb

    root, docs, _ = folder
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{root}/{t}.parquet/*.parquet'")
    for name, sql in oracles.oracle_sql().items():
        mine, other = queries.queries()[name](spark, root).toPandas(), con.sql(sql).df()
        columns = sorted(mine.columns)
        assert columns == sorted(other.columns)
        key = lambda df: sorted(map(str, df[columns].astype(str).itertuples(index=False, name=None)))  # noqa: E731, B023
        assert key(mine) == key(other), name


def test_every_operator_is_registered():
    assert [int(q[2:].split("_")[0]) for q in queries.queries()] == list(range(1, 11))
