"""Runs kept as Parquet, partitioned by run, with an index of runs; a result cache by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_run(tables: dict[str, DataFrame], base: str, run_id: str, created_at: str, kind: str = "run") -> None:
    """Each table under base/table/run_id=..; a run that is saved again replaces itself."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}/run_id={run_id}")
    spark = next(iter(tables.values())).sparkSession
    index = spark.range(1).select(F.lit(kind).alias("kind"), F.lit(created_at).alias("created_at"), F.lit(",".join(sorted(tables))).alias("tables"))
    if "recall" in tables:
        at = tables["recall"].where("mode = 'strict' AND k = 10").agg(F.max("recall").alias("strict_recall_10"))
        index = index.join(at)  # one row on each side
    index.write.mode("overwrite").parquet(f"{base}/_index/run_id={run_id}")


def list_runs(spark: SparkSession, base: str, limit: int = 50) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{base}/_index").orderBy(F.desc("created_at"), "run_id").limit(limit)


def load_run(spark: SparkSession, base: str, table: str, run_id: str) -> DataFrame:
    """One partition: the filter prunes all other runs' files."""
    return spark.read.option("basePath", f"{base}/{table}").parquet(f"{base}/{table}").where(F.col("run_id") == run_id)


def merge_pages(old: DataFrame, new: DataFrame, key: str = "normalized_url") -> DataFrame:
    """Pages of both fetches; where both have one, the newer is kept."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def stable_hash(*columns: str):
    """Key of an input: digest of its fields in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def cached(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(results at hand, requests still to be made); failures are never in the cache."""
    good = cache.where("status = 'success'") if "status" in cache.columns else cache
    return good.join(requests.select(key).distinct(), key, "left_semi"), requests.join(good.select(key).distinct(), key, "left_anti")
