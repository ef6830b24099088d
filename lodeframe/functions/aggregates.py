"""What groups can be reduced to."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class AggregationFn(ABC):
    """A function of a group's values of one field."""

    def __init__(self, field: str) -> None:
        self.field = field

    @property
    @abstractmethod
    def name(self) -> str:
        """The output field."""

    @abstractmethod
    def column(self) -> Column | None:
        """The built-in aggregate, or None for a fold in Python."""


class Max(AggregationFn):
    """The greatest value, of the field's own type."""

    @property
    def name(self) -> str:
        return f"maxof{self.field}"

    def column(self) -> Column:
        return F.max(f"`{self.field}`")


class Count(AggregationFn):
    """The number of rows, whatever the field holds."""

    @property
    def name(self) -> str:
        return f"countof{self.field}"

    def column(self) -> Column:
        return F.count(F.lit(1))


class Fold(AggregationFn):
    """A user's function: a state from the first value, replaced value after value, and a result.

    States can't be merged, so a group is streamed through one task in no
    particular order; memory is one state.  Prefer a built-in where there is one.
    """

    def __init__(self, field: str, name: str, kind: T.DataType, first: Callable[[Any], Any], following: Callable[[Any, Any], Any], value: Callable[[Any], Any] = lambda s: s) -> None:
        super().__init__(field)
        self._name, self.kind, self.first, self.following, self.value = name, kind, first, following, value

    @property
    def name(self) -> str:
        return self._name

    def column(self) -> None:
        return None


def folded(df: DataFrame, fields: list[str], fns: list[AggregationFn]) -> DataFrame:
    """Groups with folds among their functions: one shuffle by the fields, then a stream of sorted rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [fn.kind if isinstance(fn, Fold) else T.LongType() if isinstance(fn, Count) else df.schema[fn.field].dataType for fn in fns]
    schema = T.StructType([df.schema[f] for f in fields] + [T.StructField(fn.name, k) for fn, k in zip(fns, kinds, strict=True)])
    arrow = to_arrow_schema(schema)
    steps = [_steps(fn) for fn in fns]
    n = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, out = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = row[n:]
                if states is not None and row[:n] == key:
                    states = [s.following(x, v) for s, x, v in zip(steps, states, values, strict=True)]
                    continue
                if states is not None:
                    out.append((*key, *[s.value(x) for s, x in zip(steps, states, strict=True)]))
                key, states = row[:n], [s.first(v) for s, v in zip(steps, values, strict=True)]
            if len(out) >= 4096:
                yield _batch(out, arrow)
                out = []
        if states is not None:
            out.append((*key, *[s.value(x) for s, x in zip(steps, states, strict=True)]))
        if out:
            yield _batch(out, arrow)

    rows = df.select(*[F.col(f"`{f}`") for f in fields], *[F.col(f"`{fn.field}`").alias(f"__v{i}") for i, fn in enumerate(fns)])
    dealt = rows.repartition(*[F.col(f"`{f}`") for f in fields]).sortWithinPartitions(*[F.col(f"`{f}`") for f in fields]) if fields else rows.coalesce(1)
    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _steps(fn: AggregationFn) -> Fold:
    if isinstance(fn, Fold):
        return fn
    if isinstance(fn, Count):
        return Fold(fn.field, fn.name, T.LongType(), lambda v: 1, lambda s, v: s + 1)
    return Fold(fn.field, fn.name, T.NullType(), lambda v: v, lambda s, v: v if s is None or v is not None and v > s else s)
