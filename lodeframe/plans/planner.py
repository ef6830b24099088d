"""Queries and changes as DataFrames.

A query is a chain of products, a selection and a projection; that is the whole
logical plan, and join order, filters at the scans and join algorithms are
Catalyst's.  A change is a DataFrame too: the table as it will be.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadValueError, UnknownNameError
from ..operators import product, project, select
from .ast import Delete, Expression, Insert, Query, Update
from .parser import parse_query
from .predicate import Predicate, family

#: Hidden columns with the order in which rows came into their tables.
ORDER = "__seq"

#: name -> the table's DataFrame, or a view's query text
Resolver = Callable[[str], "DataFrame | str"]

#: (name, {field: constant}) -> the table's DataFrame, without some of the rows that differ
Narrower = Callable[[str, dict], DataFrame]

INT_RANGE = -(1 << 31), (1 << 31) - 1


def plan(query: Query | str, resolve: Resolver, ordered: bool = False, narrow: Narrower | None = None, _within: tuple[str, ...] = ()) -> DataFrame:
    """The query's rows; ``ordered`` sorts them by the order of insertion of the first table's rows, then the second's, and so on.

    ``narrow`` may leave out rows of a table that the equalities rule out.  Of
    tables with a field of the same name, the first one's is meant.
    """
    query = parse_query(query) if isinstance(query, str) else query
    sources, orders, seen = [], [], set()
    wanted = Predicate(query.where)
    for k, name in enumerate(query.tables):
        found = resolve(name)
        if isinstance(found, str):
            if name in _within:
                raise UnknownNameError(f"view {name} is defined by itself")
            found = plan(found, resolve, narrow=narrow, _within=(*_within, name))
        elif narrow:
            equal = {f: c for f in found.columns if f not in seen and (c := wanted.constant_for(f)) is not None}
            found = narrow(name, equal) if equal else found
        seen.update(found.columns)
        if ordered and ORDER in found.columns:
            orders.append(f"{ORDER}_{k}")
            found = found.withColumnRenamed(ORDER, orders[-1])
        else:
            found = found.drop(ORDER)
        sources.append(found)
    rows = select(reduce(product, sources), Predicate(query.where))
    if orders:
        rows = rows.orderBy(*orders)
    return project(rows, query.fields)


def default_of(kind: T.DataType):  # noqa: ANN201
    """What a field holds that an insert leaves out."""
    return {"number": 0, "text": "", "boolean": False}.get(family(kind))


def length_of(field: T.StructField) -> int | None:
    return field.metadata.get("length")


def checked(value: int | str | None, field: T.StructField) -> int | str | None:
    """The value, if the field can hold it."""
    if family(field.dataType) != ("number" if isinstance(value, int) else "text"):
        raise BadValueError(f"{value!r} is not a value of {field.name} ({field.dataType.simpleString()})")
    if isinstance(field.dataType, T.IntegerType) and not INT_RANGE[0] <= value <= INT_RANGE[1]:
        raise BadValueError(f"{value} is out of the range of {field.name}")
    if (n := length_of(field)) is not None and len(value) > n:
        raise BadValueError(f"{value!r} is longer than the {n} characters of {field.name}")
    return value


def new_row(schema: T.StructType, statement: Insert) -> tuple:
    """The inserted row, in schema order."""
    given = dict(zip(statement.fields, statement.values, strict=True))
    if missing := [f for f in given if f not in schema.names]:
        raise UnknownNameError(f"no field {', '.join(missing)} in {statement.table}")
    return tuple(checked(given[f.name], f) if f.name in given else default_of(f.dataType) for f in schema)


def inserted(table: DataFrame, statement: Insert) -> DataFrame:
    row = new_row(table.schema, statement)
    one = table.sparkSession.range(1).select(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, table.schema, strict=True)])
    return table.unionByName(one)


def updated(table: DataFrame, statement: Update) -> DataFrame:
    if statement.field not in table.columns:
        raise UnknownNameError(f"no field {statement.field} in {statement.table}")
    field = table.schema[statement.field]
    old = F.col(f"`{field.name}`")
    value = _assigned(statement.value, field, table.schema).cast(field.dataType)
    changed = F.when(Predicate(statement.where).column(table.schema), value).otherwise(old)
    return table.select(*[(changed.alias(c, metadata=field.metadata) if c == field.name else F.col(f"`{c}`")) for c in table.columns])


def _assigned(value: Expression, field: T.StructField, schema: T.StructType) -> Column:
    if value.is_constant:
        return F.lit(checked(value.as_constant(), field))
    if value.as_field() not in schema.names:
        raise UnknownNameError(f"no field {value}")
    other = schema[value.as_field()]
    if family(other.dataType) != family(field.dataType):
        raise BadValueError(f"{other.name} is not of the kind of {field.name}")
    c, n = F.col(f"`{other.name}`"), length_of(field)
    if n is not None and (length_of(other) is None or length_of(other) > n):
        c = F.when(F.length(c) > n, F.raise_error(F.lit(f"a value of {other.name} is longer than the {n} characters of {field.name}"))).otherwise(c)
    return c


def deleted(table: DataFrame, statement: Delete) -> DataFrame:
    return table.filter(~Predicate(statement.where).column(table.schema))


def matching(table: DataFrame, statement: Update | Delete) -> DataFrame:
    """The rows that a change concerns."""
    return table.filter(Predicate(statement.where).column(table.schema))


def parquet_tables(spark: SparkSession, folder: str) -> Resolver:
    """Tables that are Parquet files of a folder."""
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
