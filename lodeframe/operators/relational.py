"""The operator algebra.

Each function declares a plan; Catalyst pushes filters and column lists to the
scans, reorders, and picks the physical form.  Hints are given only where the
operator is about a physical form, and a side is broadcast only if Spark's own
size estimate is under the session's broadcast threshold.

Where both sides of a product or join have a field of the same name, the left
one's value stays.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnknownNameError
from ..functions.aggregates import AggregationFn
from ..plans.ast import Term, column, constant
from ..plans.predicate import Predicate
from ..shared import shared_root


def _known(df: DataFrame, fields: Iterable[str]) -> list[str]:
    fields = list(dict.fromkeys(fields))
    if missing := [f for f in fields if f not in df.columns]:
        raise UnknownNameError(f"no field {', '.join(missing)}")
    return fields


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def table_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def chunk_scan(spark: SparkSession, paths: list[str], first: int, last: int) -> DataFrame:
    """Files ``first`` to ``last`` of a table, in the order given: the unit that scans are split by."""
    return spark.read.parquet(*paths[first : last + 1])


def project(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """The named fields, a repeated name once, duplicates of rows kept."""
    return df.select(*map(_q, _known(df, fields)))


def select(df: DataFrame, predicate: Predicate | Iterable[Term]) -> DataFrame:
    """Rows that satisfy all terms."""
    p = predicate if isinstance(predicate, Predicate) else Predicate(tuple(predicate))
    return df.filter(p.filter(df.schema)) if p else df


def _apart(left: DataFrame, right: DataFrame) -> DataFrame:
    return right.drop(*[c for c in right.columns if c in left.columns])


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs.  With a selection above it Catalyst makes a join of it."""
    return left.crossJoin(_apart(left, right))


def block_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs, the right side in blocks that every left block meets, neither side held whole.

    Spark's cartesian product of partitions; a shuffle-and-replicate hint keeps
    it from broadcasting a side.
    """
    return left.join(_apart(left, right).hint("shuffle_replicate_nl"), how="cross")


def _bounded(df: DataFrame) -> bool:
    """Whether Spark's estimate of ``df`` is within the session's broadcast threshold."""
    spark = df.sparkSession
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def _equi_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str, hint: str | None) -> DataFrame:
    _known(left, [left_field]), _known(right, [right_field])
    key = "__right_key"
    side = right.withColumn(key, _q(right_field)).drop(*[c for c in right.columns if c in left.columns])
    side = side.hint(hint) if hint else side
    p = Predicate((Term(column(left_field), column(key)),))
    schema = T.StructType([*left.schema, T.StructField(key, right.schema[right_field].dataType)])
    return left.join(side, p.filter(schema), "inner").drop(key)


def index_select(df: DataFrame, field: str, value: int | str) -> DataFrame:
    """Rows where an indexed field has a value: an equality that reaches the scan's filters and skips by its statistics."""
    return select(df, (Term(column(*_known(df, [field])), constant(value)),))


def index_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str) -> DataFrame:
    """Inner equi-join that looks left rows up in the right table: by broadcast while that has a small estimate, else as adaptive execution decides."""
    return _equi_join(left, right, left_field, right_field, "broadcast" if _bounded(right) else None)


def merge_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str) -> DataFrame:
    """Inner equi-join of sorted sides; skewed keys are split by adaptive execution."""
    return _equi_join(left, right, left_field, right_field, "merge")


def sort(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Ascending by the fields in turn; texts by code point."""
    return df.orderBy(*[_q(f).asc() for f in _known(df, fields)])


def group_by(df: DataFrame, fields: Iterable[str], fns: Iterable[AggregationFn] = ()) -> DataFrame:
    """The group fields, then a field per function.

    Without functions the distinct groups.  Without fields one group, or none if
    there are no rows.  Built-in functions are combined before the shuffle.
    """
    fields, fns = _known(df, fields), list(fns)
    _known(df, [fn.field for fn in fns])
    if not fns:
        return project(df, fields).distinct() if fields else df.limit(1).select()
    folds = [fn for fn in fns if fn.column() is None]
    if folds:
        from ..functions.aggregates import folded

        return folded(df, fields, fns)
    if fields:
        return df.groupBy(*map(_q, fields)).agg(*[fn.column().alias(fn.name) for fn in fns])
    out = df.agg(*[fn.column().alias(fn.name) for fn in fns], F.count(F.lit(1)).alias("__n"))
    return out.where("__n > 0").drop("__n")


def materialize(df: DataFrame) -> DataFrame:
    """A stored snapshot of the rows as they are now, in the session's checkpoint folder, which all executors share."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)
