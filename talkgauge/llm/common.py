"""What the operators share: reading tables, cutting lineage, telling rows apart, shipping Python code to executors."""

from __future__ import annotations

import contextlib
import contextvars
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this package travel by value: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Lists of the tables written in the open scratch scopes, the innermost last.
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Only a session on one machine, as in tests, may leave it unset."""
    path = spark.conf.get(_CHECKPOINT_DIR, None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
        path = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set(_CHECKPOINT_DIR, path)
    return path.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, put back at the end."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends here.

    A lost executor then costs a reread and no recomputation, and both sides of a later join on the
    table are exchanges of their own, which adaptive execution can split when a key is hot. The exchanges
    that made the table are deleted when it is complete, and the table itself at the end of the scratch
    scope that it was written in, if any.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with setting(spark, _SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path)
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written in this scope are deleted at its end, but for those that the function it yields writes."""
    outer, made = _SCOPES.get(), []
    token = _SCOPES.set((*outer, made))

    def keep(df: DataFrame) -> DataFrame:
        inner = _SCOPES.set(outer)
        try:
            return written(df)
        finally:
            _SCOPES.reset(inner)

    try:
        yield keep
    finally:
        _SCOPES.reset(token)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its own columns of these names (in any case), which the operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in low])


#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(table: DataFrame, held: Column | None = None) -> DataFrame:
    """``table`` marked for broadcast if it has at most BROADCAST_BYTES, by a count: 64 a row, and ``held`` bytes more."""
    n, size = table.agg(F.count(F.lit(1)), F.sum(F.lit(0) if held is None else held)).first()
    return F.broadcast(table) if n * 64 + (size or 0) <= BROADCAST_BYTES else table


#: Columns that tell the rows of a stored table apart: the file, by two hashes of its path, and the row's place in it.
POSITION = ("_file1", "_file2", "_row")


def positioned(df: DataFrame) -> DataFrame:
    """``df`` with the columns POSITION, which are unique, not null, and the same whenever the result is read.

    Rows read from files have them already; anything else is written as a table first.
    """
    df = without(df, *POSITION)
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter"):
        node = node.children().apply(0)
    if node.getClass().getSimpleName() != "LogicalRelation" or not df.sparkSession._jvm.scala.jdk.javaapi.CollectionConverters.asJava(node.metadataOutput()):
        df = written(df)
    path = F.col("_metadata.file_path")
    return df.select("*", F.xxhash64(path).alias(POSITION[0]), F.xxhash64(F.lit(1), path).alias(POSITION[1]), F.col("_metadata.row_index").alias(POSITION[2]))


#: Bytes of one batch that Spark hands to Python: with rows alone bounded, a batch of very long texts has no limit.
ARROW_BATCH_BYTES = 4 << 20


def _released() -> None:
    """Gives back what a Python worker no longer uses: it stays for other tasks, beside those that run now."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes (a setting of the session), and memory given back at the end."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            _released()

    return df.mapInArrow(tidy, schema)
