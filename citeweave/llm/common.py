"""Helpers that the operators of this subpackage share.

Scratch tables go to the folder that the session names in ``spark.checkpoint.dir``
(shared by all executors), never to a machine-local folder of a cluster.  Losing an
executor therefore costs a recomputation of its tasks and nothing else.
"""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode (tests, a laptop) where the session names no shared folder.
LOCAL_SCRATCH = "file:/tmp/checkpoints"
#: Rows up to which a side may be broadcast; above it the join is shuffled.
BROADCAST_ROWS = 500_000
#: Bytes of text that a Python helper holds as word lists at one time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the registered queries."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session, or what
    ``setCheckpointDir`` has set.  On a cluster without either there is no folder that all executors see."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/citeweave-{context.applicationId}"


#: Paths written since the innermost ``scratch_scope`` was entered.
_scopes: list[list[str]] = []


def materialise(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: lineage ends here.  ``options``
    are those of the Parquet writer."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are removed at the end, when the results that need
    them have been written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def clean_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch tables (call it after the last result is written)."""
    _delete(spark, scratch_dir(spark))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint if a count shows at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join in which every key of ``big`` is dealt over ``salts`` tasks; ``small`` is repeated.

    Sort-merge by hint: neither side has a proven bound, so neither is broadcast.
    """
    left = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
    release_memory()


def release_memory() -> None:
    """Give what a task no longer needs back to the system, for the worker process lives on."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


#: Rows and bytes of one Arrow batch between Spark and Python: texts can be long, and a batch is held on both sides.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def configure(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ARROW_ROWS and about ARROW_BYTES, never raise it.

    Batches are sized by the session alone, so operators leave the setting to their caller: the
    registered queries and the pipeline call this, other users set it as they see fit.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+) ?([kmg]?)b?", spark.conf.get(key).strip().lower())
    if not now or not 0 < int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text; other columns, whatever their names, play no part."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that begins with no column's name of ``df`` and is not one, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name
