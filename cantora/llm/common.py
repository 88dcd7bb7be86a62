"""Scratch tables, checked broadcasts and text helpers shared by the operators here."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a broadcast table may hold, by its values, before Spark's own overhead of some 40 bytes a row.
BROADCAST_BYTES = 16 << 20
#: Rows of an Arrow batch: whole documents or shingle sets, held by the JVM and a Python worker at once.
ARROW_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cantora-checkpoint-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


_SCOPE: ContextVar[list[Scratch] | None] = ContextVar("scratches of the block", default=None)


class Scratch:
    """Tables written in the shared folder, which cut lineage and survive lost executors.

    free() removes one when nothing reads it any longer; what scratches hold that are opened within a scope() goes at its end, whatever
    other threads open meanwhile; the rest goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        if (scope := _SCOPE.get()) is not None:
            scope.append(self)
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cantora-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self._fs().deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._cantora_path = path
        return out

    def bounded(self, df: DataFrame, name: str) -> DataFrame:
        """df written, then as bounded() gives it."""
        return bounded(self.keep(df, name))

    @staticmethod
    @contextmanager
    def scope() -> Iterator[None]:
        """What this thread's scratches of the block hold is removed behind it."""
        mine: list[Scratch] = []
        token = _SCOPE.set(mine)
        try:
            yield
        finally:
            _SCOPE.reset(token)
            for scratch in mine:
                scratch._fs().delete(scratch._path(scratch.root), True)

    def free(self, *tables: DataFrame) -> None:
        for df in tables:
            path = getattr(df, "_cantora_path", None)
            if path:
                self._fs().delete(self._path(path), True)


def width(schema: T.StructType) -> Column:
    """Bytes of a row's values, strings and arrays by their length."""
    total = F.lit(0).cast("long")
    for field in schema.fields:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total += F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(kind, T.ArrayType):
            each = F.octet_length(F.to_json(F.struct(column))) if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)) else 8 * F.size(column)
            total += F.greatest(F.coalesce(each, F.lit(0)), F.lit(0))
        else:
            total += F.lit(8 if not isinstance(kind, T.StructType) else 8 * len(kind.fields))
    return total + 40


def bounded(df: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for a broadcast if its rows are measured to hold at most so many bytes, else as it is, for a shuffled join."""
    return F.broadcast(df) if (df.agg(F.sum(width(df.schema))).first()[0] or 0) <= size else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model here learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def texts(batch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.names.index(column)).to_pylist()]


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Batches of few rows, so that very long texts don't add up."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
