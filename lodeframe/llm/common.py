"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that parts words, as a character class body.
WORD_SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the folder that driver and executors share.

    Cutting a plan here means writing Parquet and reading it again: a lost
    executor costs a retry of its tasks and never the table.  The folder is the
    session's ``spark.checkpoint.dir``; where that is unset and the master is
    local, a temporary folder.
    """

    _scopes: list[list[Scratch]] = []

    @classmethod
    @contextmanager
    def scope(cls) -> Iterator[None]:
        """Deletes, at its end, the tables of all that was made within: for work whose result is stored elsewhere by then."""
        cls._scopes.append([])
        try:
            yield
        finally:
            for made in cls._scopes.pop():
                made.drop()

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        if self._scopes:
            self._scopes[-1].append(self)
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="lodeframe-")
            spark.sparkContext.setCheckpointDir(root)
        self.path = f"{root.rstrip('/')}/lodeframe-{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.names.add(name)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        for name in self.names - set(names):
            self.drop(name)

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all of them; later reads of them fail."""
        self.names -= {name} if name else self.names
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def map_rows(df: DataFrame, fn: Callable[[list], Iterator[tuple]], schema: str, flush_rows: int = 4096) -> DataFrame:
    """``fn`` takes the list of row tuples of one Arrow batch and yields output tuples.

    Batches are bounded in rows and bytes by the session's Arrow settings, and
    output leaves in chunks, so memory follows one batch and not the partition.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for row in fn(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                out.append(row)
                if len(out) >= flush_rows:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def unused(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores before it as no column in ``taken`` has; names differ in more than case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def ascii_lower(c):  # noqa: ANN001, ANN201
    """A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)
