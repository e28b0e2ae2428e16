"""Stage tables of an audit: written once as Parquet, read back by schema.

A table that several others are derived from is a stage.  What is derived from a stage reads its
files, so no plan contains the plan of an earlier stage, and losing an executor costs tasks of one
stage at most.

With a ``base`` of the caller's, stages are kept under a key of their content: a digest of the input
tables' rows (in any order), the audit's parameters, and the stage's own.  An audit that was stopped,
or is asked for again with other terms, takes up the stages that are there whole; one that was being
written when the driver went has no ``_SUCCESS`` file and is written anew.  Without a ``base`` the
stages of a call stand in the scratch folder under a key of their own, and ``remove`` deletes them.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Part of every key; a change of what stages hold changes it.
FORMAT = "2"
#: Used only in local mode (tests, a laptop) where the session names no shared folder.
LOCAL_SCRATCH = "file:/tmp/checkpoints"

#: Bytes of a stage from which it is worth dealing, and of one task's share that needs no dealing.
SPREAD, SPLIT = 1 << 20, 4 << 20

Keep = Callable[..., DataFrame]


def plain(name: str, df: DataFrame, *parameters: object) -> DataFrame:
    """A stage that is not written: the table stays lazy."""
    return df


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which the driver and all executors share."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/citeweave-{context.applicationId}"


def fingerprint(df: DataFrame) -> str:
    """Digest of a table's schema and rows, whatever their order: number of rows and two sums of hashes."""
    maps = [f.name for f in df.schema.fields if "map<" in f.dataType.simpleString() or f.dataType.typeName() == "variant"]
    cells = [F.to_json(c) if c in maps else F.col(f"`{c}`") for c in df.columns]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)"))
    one = df.agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).first()
    return hashlib.sha256(f"{df.schema.json()} {one['n']} {one['a']} {one['b']}".encode()).hexdigest()


class Stages:
    """Writes and finds the stages of one call; ``parameters`` are plain values."""

    def __init__(self, spark: SparkSession, base: str | None, inputs: dict[str, DataFrame | None], **parameters: object):
        self.spark, self.lasting = spark, base is not None
        self.written, self.found, self.paths = [], [], []
        self.base = f"{(base or scratch_dir(spark)).rstrip('/')}/stages"
        key = {n: df and fingerprint(df) for n, df in sorted(inputs.items())} if base else uuid.uuid4().hex
        self.key = self._digest(FORMAT, key, parameters)

    @staticmethod
    def _digest(*parts: object) -> str:
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, name: str, df: DataFrame, *parameters: object) -> DataFrame:
        """``df`` from its stage, which is written first unless it is there whole."""
        path = f"{self.base}/{name}/{self._digest(self.key, name, parameters)}"
        if path in self.paths:
            raise ValueError(f"two stages of one call are named {name}")
        at, store = self._path(f"{path}/_SUCCESS")
        df = df.withColumns({f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if f.dataType.typeName() == "void"})
        if store.exists(at):
            self.found.append(name)
        else:
            df.write.mode("overwrite").parquet(path)
            self.written.append(name)
        self.paths.append(path)
        return self._spread(self.spark.read.schema(df.schema).parquet(path), path)

    def _spread(self, df: DataFrame, path: str) -> DataFrame:
        """A stage in fewer files than there are cores, and small, is dealt over the cores as it is read: what
        is done to its texts takes longer than to deal them.  A large one is split by Spark's reader."""
        at, store = self._path(path)
        summary, cores = store.getContentSummary(at), self.spark.sparkContext.defaultParallelism
        if SPREAD <= summary.getLength() < cores * SPLIT and summary.getFileCount() <= cores:
            return df.repartition(cores)
        return df

    def remove(self) -> None:
        """Delete the stages of a call without a base; those of a base stay for later ones."""
        if not self.lasting:
            for path in self.paths:
                at, store = self._path(path)
                store.delete(at, True)


def scratch_keep(spark: SparkSession) -> Keep:
    """A ``keep`` whose stages go to the scratch folder."""
    return Stages(spark, None, {}).keep


def clean_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch folder, when nothing reads its tables any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
