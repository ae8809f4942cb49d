"""Written intermediate tables.

A recursive query must cut its lineage now and then. It does so by writing a parquet table into the
shared folder named by ``spark.checkpoint.dir`` and reading it back: the table survives the loss of
executors, its size is known exactly to the planner (so Spark broadcasts it only below
``spark.sql.autoBroadcastJoinThreshold``), and the row count comes from the write itself.

Tables live until their :func:`scope` ends or somebody who knows that nothing reads them any more drops them.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StringType, StructType

SETTING = "spark.checkpoint.dir"
#: Bytes in memory, by :func:`width`, above which a table had better not be broadcast. Spark goes by the file, which may take a hundredth of them
#: where values recur.
HEAVY = 32 << 20

_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written tables, as the session names it.

    Only a ``local`` master, where driver and executors share one disk, gets a folder of its own when
    the setting is missing; anywhere else a missing setting is an error.
    """
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="graphfacts-")
    return _local_dirs[app]


def width(kind: DataType) -> int:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, StructType):
        return sum(width(f.dataType) for f in kind.fields)
    return 8 if isinstance(kind, NumericType) else 24 if isinstance(kind, StringType) else 48 if isinstance(kind, (ArrayType, MapType)) else 8


@dataclass(frozen=True)
class Written:
    """A table on disk: where it is, what it holds, how many rows, and how many of them the asked condition holds for."""

    path: str
    schema: StructType
    rows: int
    spark: SparkSession
    hits: int = 0

    @cached_property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    @property
    def light(self) -> bool:
        """Whether its rows may be broadcast."""
        return self.rows * width(self.schema) <= HEAVY


def write(df: DataFrame, hits: str = "false") -> Written:
    """Write ``df`` once; the row count, and the count of rows with the condition ``hits``, are observed during the write."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/graphfacts/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.expr(hits)).alias("hits")).write.parquet(path)
    done = Written(path, df.schema, seen.get["n"], spark, seen.get["hits"])
    if scopes := _scopes():
        scopes[-1].tables.append(done)
    return done


def materialize(df: DataFrame) -> DataFrame:
    """``df`` as a written table: computed once, exact statistics, short plan."""
    return write(df).df


def drop(*gone: Written) -> None:
    """Deletes written tables that nothing will read again, not even a plan that was built but not yet run."""
    for table in gone:
        context = table.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class Scope:
    """The tables written while a scope is the innermost one of its thread."""

    def __init__(self) -> None:
        self.tables: list[Written] = []
        self.kept: list[Written] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, written, which outlives the scope: it belongs to the one outside, if there is one."""
        done = write(df)
        self.tables.remove(done)
        self.kept.append(done)
        return done.df


_open = threading.local()


def _scopes() -> list[Scope]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


@contextmanager
def scope() -> Iterator[Scope]:
    """Drops, at its end, the tables that were written in it, except those that were kept. What leaves the block must not
    read the others: return what was kept."""
    own = Scope()
    _scopes().append(own)
    try:
        yield own
    finally:
        _scopes().remove(own)
        if outer := _scopes():
            outer[-1].tables += own.kept
        drop(*own.tables)


def read_all(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    """One scan over several written tables of the same schema."""
    return spark.read.schema(schema).parquet(*paths)
