from __future__ import annotations

import pytest
from pyspark.sql import types as T

from lodeframe.errors import UnknownNameError
from lodeframe.functions import Count, Fold, Max
from lodeframe.operators import block_product, chunk_scan, group_by, index_join, index_select, materialize, merge_join, product, project, select, sort
from lodeframe.plans import estimate
from lodeframe.plans.ast import Term, column, constant
from lodeframe.plans.predicate import Predicate

MEMBERS = [(1, "ada", 10, 1984), (2, "ben", 20, 1984), (3, "cyd", 10, 1985), (4, "dov", 20, 1985), (5, "eli", 30, 1983), (6, "fay", 20, 1971), (7, "gus", 30, 1984), (8, "hal", 20, 1971), (9, "ivy", 10, 1984)]
DEPTS = [(10, "cs"), (20, "math"), (40, "gus")]


@pytest.fixture(scope="module")
def member(spark):
    return spark.createDataFrame(MEMBERS, "mid int, mname string, team int, joined int")


@pytest.fixture(scope="module")
def dept(spark):
    return spark.createDataFrame(DEPTS, "did int, dname string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_project(member):
    assert project(member, ["mname", "mid", "mname"]).columns == ["mname", "mid"]
    assert project(member, ["joined"]).count() == 9
    with pytest.raises(UnknownNameError):
        project(member, ["x"])


def test_select(member):
    eq = lambda a, b: [Term(column(a), constant(b))]
    assert rows(project(select(member, eq("joined", 1971)), ["mname"])) == [("fay",), ("hal",)]
    assert select(member, eq("mname", 5)).count() == 0
    assert select(member, eq("joined", "1971")).count() == 0
    assert select(member, [Term(constant(1), constant(1))]).count() == 9
    assert select(member, [Term(constant(1), constant(2))]).count() == 0
    assert select(member, []).count() == 9
    with pytest.raises(UnknownNameError):
        select(member, eq("x", 1))


def test_unknown_is_false(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    p = Predicate((Term(column("a"), constant(1)),))
    assert df.filter(p.column(df.schema)).count() == 1 and df.filter(~p.column(df.schema)).count() == 1


def test_product_left_wins(member, spark):
    other = spark.createDataFrame([(100, "x"), (200, "y")], "mid int, z string")
    out = product(member, other)
    assert out.columns == ["mid", "mname", "team", "joined", "z"] and out.count() == 18
    assert {r.mid for r in out.collect()} == set(range(1, 10))
    assert product(member, member).count() == 81
    assert product(member.where("mid < 0"), other).count() == 0
    assert rows(block_product(member, other)) == rows(out)
    assert "CartesianProduct" in plan_of(block_product(member, other))


def test_joins(member, dept):
    want = sorted((s, n, m, g, dict(DEPTS)[m]) for s, n, m, g in MEMBERS if m in dict(DEPTS))
    for join in (merge_join, index_join):
        out = join(member, dept, "team", "did")
        assert rows(project(out, ["mid", "mname", "team", "joined", "dname"])) == want
    assert "SortMergeJoin" in plan_of(merge_join(member, dept, "team", "did"))
    assert merge_join(member, dept, "team", "dname").count() == 0  # a number is no text
    same = dept.withColumnRenamed("did", "team").withColumnRenamed("dname", "mname")
    assert rows(merge_join(member, same, "team", "team")) == sorted(r for r in MEMBERS if r[2] in dict(DEPTS))


def test_join_of_selected_product_is_a_hash_or_merge_join(member, dept):
    out = select(product(member, dept), [Term(column("team"), column("did"))])
    assert out.count() == 7 and "Cartesian" not in plan_of(out) and "NestedLoop" not in plan_of(out)


def test_index_select_reaches_the_scan(member, spark, tmp_path):
    member.write.parquet(str(tmp_path / "s"))
    out = index_select(spark.read.parquet(str(tmp_path / "s")), "team", 20)
    assert out.count() == 4 and "EqualTo(team,20)" in plan_of(out)


def test_chunks(member, spark, tmp_path):
    member.repartition(3).write.parquet(str(tmp_path / "s"))
    files = sorted(str(p) for p in (tmp_path / "s").glob("part*"))
    assert chunk_scan(spark, files, 0, 0).count() + chunk_scan(spark, files, 1, len(files) - 1).count() == 9


def test_sort(member):
    assert [r.mname for r in sort(member, ["joined", "mname"]).collect()] == ["fay", "hal", "eli", "ada", "ben", "gus", "ivy", "cyd", "dov"]
    assert sort(member.where("mid < 0"), ["mid"]).collect() == []


def test_group(member):
    assert rows(group_by(member, ["team"], [Count("mid"), Max("joined")])) == [(10, 3, 1985), (20, 4, 1985), (30, 2, 1984)]
    out = group_by(member, ["team"], [Max("mname")])
    assert rows(out) == [(10, "ivy"), (20, "hal"), (30, "gus")] and out.columns == ["team", "maxofmname"]
    assert rows(group_by(member, ["team"])) == [(10,), (20,), (30,)]
    assert rows(group_by(member, [], [Count("mid"), Max("mid")])) == [(9, 9)]
    none = member.where("mid < 0")
    assert group_by(none, [], [Count("mid"), Max("mid")]).count() == 0
    assert group_by(none, ["team"], [Count("mid")]).count() == 0
    assert "partial_count" in plan_of(group_by(member, ["team"], [Count("mid")]))


def test_count_counts_rows(spark):
    df = spark.createDataFrame([(1, None), (1, 2)], "k int, v int")
    assert rows(group_by(df, ["k"], [Count("v")])) == [(1, 2)]


def test_fold(member):
    longest = Fold("mname", "years", T.LongType(), lambda v: 1, lambda s, v: s + 1, lambda s: 10 * s)
    assert rows(group_by(member, ["team"], [longest, Count("mid"), Max("joined")])) == [(10, 30, 3, 1985), (20, 40, 4, 1985), (30, 20, 2, 1984)]
    assert rows(group_by(member, [], [longest])) == [(90,)]
    assert group_by(member.where("mid < 0"), [], [longest]).count() == 0


def test_materialize(member):
    out = materialize(member.where("team = 20"))
    assert out.count() == 4 and "ExistingRDD" in plan_of(out)


def test_predicates():
    p = Predicate((Term(column("a"), constant(1)), Term(column("b"), column("c")), Term(constant("x"), column("d"))))
    assert str(p.within({"a", "b"})) == "a = 1" and p.within({"z"}) is None
    assert str(p.joining({"b"}, {"c"})) == "b = c" and p.joining({"a"}, {"d"}) is None
    assert p.constant_for("a") == 1 and p.constant_for("d") == "x" and p.constant_for("b") is None
    assert p.field_for("b") == "c" and p.field_for("c") == "b" and p.field_for("a") is None
    assert len(p.conjoin(p).terms) == 6


def test_estimates():
    a, b = estimate.table(900, {"a", "k"}, 60), estimate.table(90, {"b", "k"}, 60)
    assert (a.blocks, a.records, a.distinct("a")) == (150, 900, 301)
    one = Predicate((Term(column("a"), constant(1)),))
    s = estimate.select(a, one)
    assert (s.blocks, s.records, s.distinct("a"), s.distinct("k")) == (150, 2, 1, 2)
    assert estimate.select(a, Predicate((Term(constant(1), constant(2)),))).records == 0
    assert estimate.select(a, Predicate((Term(constant(1), constant(1)),))).records == 900
    both = estimate.select(estimate.product(a, b), Predicate((Term(column("a"), column("b")),)))
    assert both.records == 81000 // 301 and both.distinct("a") == 31
    assert estimate.product(a, b).blocks == 150 + 900 * 15
    assert estimate.merge_join(a, b, "a", "b").records == 81000 // 301
    assert estimate.index_select(a, "a").records == 2
    assert estimate.index_join(a, b, "b").records == 900 * (90 // 31)
    assert estimate.group_by(a, ["a", "k"], {"n"}).records == 301 * 301
    assert estimate.materialize(a, 60).blocks == 135
    assert estimate.block_product(a, b, 15, 5).blocks == 15 + 150 * 3
    assert (estimate.best_root(8, 100), estimate.best_factor(8, 100), estimate.btree_search(100, 10)) == (5, 8, 3)
    assert [estimate.best_root(a, 100) for a in (0, 1, 2, 3, 9, 10, 11, 1000)] == [1, 1, 2, 3, 5, 10, 10, 10]
    assert [estimate.best_root(8, n) for n in (0, 1, 2, 6, 64, 65)] == [0, 1, 2, 3, 8, 5]


def test_stateless_operators_take_streams(member, spark, tmp_path):
    member.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(member.schema).parquet(str(tmp_path / "in"))
    out = project(select(stream, [Term(column("joined"), constant(1971))]), ["mname"])
    q = out.writeStream.format("memory").queryName("early").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("early")) == [("fay",), ("hal",)]
