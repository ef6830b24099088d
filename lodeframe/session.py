"""Connections, statements and result sets over a store; and the engine for use in a program."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from .errors import BadSyntaxError, BadValueError, UnknownNameError
from .plans import planner
from .plans.ast import Query
from .plans.parser import parse
from .sources.store import INTEGER, VARCHAR, Store, Transaction

INT_WIDTH = 6  # characters that a client shows an int with

#: Type codes of the catalog's type table that the engine's columns map to.
TYPE_CODES = {"int": INTEGER, "string": VARCHAR, "bigint": -5, "boolean": 16, "char": 1, "date": 91, "double": 8, "float": 6, "smallint": 5, "timestamp": 93, "timestamp_ntz": 93, "tinyint": -6}


class Engine:
    """In-process entry: queries as lazy DataFrames, other statements at once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.store = Store(spark, path)

    def query(self, sql: str) -> DataFrame:
        return self.store.begin().query(sql)

    def execute(self, sql: str) -> int:
        statement = parse(sql)
        if isinstance(statement, Query):
            raise BadSyntaxError("a query changes nothing")
        tx = self.store.begin()
        try:
            n = tx.execute(statement)
            tx.commit()
        except BaseException:
            tx.rollback()
            raise
        return n


def connect(spark: SparkSession, path: str) -> Connection:
    return Connection(Store(spark, path))


class Connection:
    """One transaction at a time; closing commits."""

    def __init__(self, store: Store) -> None:
        self.store, self.tx = store, store.begin()

    def create_statement(self) -> Statement:
        return Statement(self)

    def commit(self) -> None:
        self.tx.commit()

    def rollback(self) -> None:
        self.tx.rollback()

    def close(self) -> None:
        self.commit()


class Statement:
    def __init__(self, connection: Connection) -> None:
        self.connection = connection

    def execute_query(self, sql: str) -> ResultSet:
        """Rows in the order in which they were inserted."""
        try:
            return ResultSet(self.connection, self.connection.tx.query(sql, ordered=True))
        except RuntimeError:
            self.connection.rollback()
            raise

    def execute_update(self, sql: str) -> int:
        """Rows concerned; commits at once, and rolls back on an error."""
        tx: Transaction = self.connection.tx
        try:
            statement = parse(sql)
            if isinstance(statement, Query):
                raise BadSyntaxError("a query changes nothing")
            n = tx.execute(statement)
            tx.commit()
        except BaseException:
            tx.rollback()
            raise
        return n


class ResultSet:
    """A forward cursor; before the first row until ``next`` is called."""

    def __init__(self, connection: Connection, rows: DataFrame) -> None:
        self._connection, self.schema = connection, rows.schema
        self._rows: Iterator[Row] = rows.toLocalIterator()
        self._row: Row | None = None

    def next(self) -> bool:
        try:
            self._row = next(self._rows, None)
        except BaseException:
            self._connection.rollback()
            raise
        return self._row is not None

    def _get(self, field: str, kind: type[T.DataType]):  # noqa: ANN202
        name = field.lower()
        if name not in self.schema.names:
            raise UnknownNameError(f"no field {field}")
        if not isinstance(self.schema[name].dataType, kind):
            raise BadValueError(f"{field} has another type")
        if self._row is None:
            raise BadValueError("not on a row")
        return self._row[name]

    def get_int(self, field: str) -> int:
        return self._get(field, T.NumericType)

    def get_string(self, field: str) -> str:
        return self._get(field, T.StringType)

    def get_meta_data(self) -> MetaData:
        return MetaData(self.schema)

    def close(self) -> None:
        self._rows = iter(())
        self._connection.commit()


class MetaData:
    """Columns counted from 1."""

    def __init__(self, schema: T.StructType) -> None:
        self._fields = schema.fields

    def get_column_count(self) -> int:
        return len(self._fields)

    def _field(self, column: int) -> T.StructField:
        if not 1 <= column <= len(self._fields):
            raise UnknownNameError(f"no column {column}")
        return self._fields[column - 1]

    def get_column_name(self, column: int) -> str:
        return self._field(column).name

    def get_column_type(self, column: int) -> int:
        return TYPE_CODES[self._field(column).dataType.simpleString()]

    def get_column_display_size(self, column: int) -> int:
        f = self._field(column)
        return f.metadata.get("length", INT_WIDTH)
