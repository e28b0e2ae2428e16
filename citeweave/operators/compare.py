"""Cited against non-cited: group statistics, breakdowns, correlations.  Associations, not causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.operators.ordered import quantiles


def number(c: Column) -> Column:
    """Double or null: text that is no number, and NaN, are null; booleans are 1 and 0."""
    x = c.try_cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def long_features(rows: DataFrame, features: list[str], keep: list) -> DataFrame:
    """(keep.., feature, value): one pass over the rows for all features."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), number(F.col(f)).alias("value")) for f in features]))
    out = rows.select(*keep, cells.alias("x"))
    return out.select(*[c for c in out.columns if c != "x"], "x.feature", "x.value")


def group_compare(rows: DataFrame, features: list[str], by: list[str] | None = None, rounded_delta: bool = False, cited: str = "cited") -> DataFrame:
    """Mean, median and n of both groups for every feature, and the difference of means.

    Null values count for nothing.  Medians are exact and come from bins of values (``ordered``), so
    that no task holds a whole feature.
    """
    by = by or []
    side = F.when(F.col(cited) == 1, 1).when(F.col(cited) == 0, 0)
    each = quantiles(long_features(rows, features, [*by, side.alias("side")]), [*by, "feature", "side"], {"median": 0.5})
    r = lambda c: F.round(c, 4)
    of = lambda c, v: F.max(F.when(F.col("side") == v, F.col(c)))
    stats = each.groupBy(*by, "feature").agg(*[of(c, v).alias(f"{c}{v}") for c in ("mean", "median", "n") for v in (1, 0)])
    delta = r(r(F.col("mean1")) - r(F.col("mean0"))) if rounded_delta else r(F.col("mean1") - F.col("mean0"))
    n = lambda v: F.coalesce(f"n{v}", F.lit(0).cast("long"))
    return stats.select(*by, "feature", r("mean1").alias("cited_mean"), r("mean0").alias("non_cited_mean"), r("median1").alias("cited_median"), r("median0").alias("non_cited_median"), delta.alias("delta"), n(1).alias("n_cited"), n(0).alias("n_non_cited"))


def source_breakdown(rows: DataFrame, key: str = "source_type") -> DataFrame:
    stats = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum("cited").cast("long").alias("n_cited"))
    return stats.select(key, "n", "n_cited", (F.col("n") - F.col("n_cited")).alias("n_non_cited"), F.round(F.try_divide(F.col("n_cited"), F.col("n")), 4).alias("cite_rate")).orderBy(F.desc("n"), key)


def official_compare(rows: DataFrame) -> DataFrame:
    """Institutional, brand candidate, other: the first two may overlap, so no grouping."""
    a, b = F.col("institutional_official"), F.col("brand_official_candidate")
    groups = {"institutional": a, "brand": b, "other": ~a & ~b}
    one = rows.agg(*[x for g, p in groups.items() for x in (F.count_if(p).alias(f"{g}_n"), F.coalesce(F.sum(F.when(p, F.col("cited"))), F.lit(0)).cast("long").alias(f"{g}_c"))])
    long = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(f"{g}_n").alias("n"), F.col(f"{g}_c").alias("n_cited")) for g in groups]))
    return one.select(long.alias("x")).select("x.*").withColumn("cite_rate", F.coalesce(F.round(F.try_divide(F.col("n_cited"), F.col("n")), 4), F.lit(0.0)))


def _pearson(x: str, y: str) -> Column:
    """Correlation by moments; null without variance (corr itself would divide by zero)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_with_cited(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, corr, n): null unless there are three rows and both sides vary."""
    long = long_features(rows, features, ["cited"]).where("value IS NOT NULL").withColumn("y", F.col("cited").cast("double"))
    stats = long.groupBy("feature").agg(F.count("*").alias("n"), _pearson("value", "y").alias("c"), (F.min("value") < F.max("value")).alias("vx"), (F.min("y") < F.max("y")).alias("vy"))
    return stats.select("feature", F.when((F.col("n") >= 3) & F.col("vx") & F.col("vy"), F.round("c", 4)).alias("corr"), "n")


def length_similarity_correlation(rows: DataFrame, length: str, sim: str) -> DataFrame:
    pairs = rows.select(number(F.col(length)).alias("x"), number(F.col(sim)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    stats = pairs.agg(F.count("*").alias("n"), _pearson("x", "y").alias("c"), (F.min("x") < F.max("x")).alias("vx"), (F.min("y") < F.max("y")).alias("vy"))
    return stats.select(F.when((F.col("n") >= 3) & F.col("vx") & F.col("vy"), F.round("c", 4)).alias("corr"), "n")


def top_domains(rows: DataFrame, cited: int, k: int = 8, key: str = "domain") -> DataFrame:
    return rows.where((F.col("cited") == cited) & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def summary(rows: DataFrame, record: str = "record_id") -> DataFrame:
    """One row of headline numbers."""
    one = rows.agg(F.countDistinct(record).alias("n_records"), F.count("*").alias("n_sources"), F.coalesce(F.sum("cited"), F.lit(0)).cast("long").alias("n_cited"), F.count_if("scrape_success").alias("n_scraped"))
    return one.withColumns({"n_more_only": F.col("n_sources") - F.col("n_cited"), "scrape_success_rate": F.coalesce(F.round(F.try_divide(F.col("n_scraped"), F.col("n_sources")), 4), F.lit(0.0))})


def funnel(candidates: DataFrame) -> DataFrame:
    """Counts of a run's candidates on their way: all, fetched, cited, weakly matched."""
    return candidates.agg(F.count("*").alias("n_candidates"), F.count_if("scrape_success").alias("n_scraped"), F.count_if(F.col("cited") == 1).alias("n_cited"), F.count_if("weak_domain_match").alias("n_weak"))


def top_deltas(compared: DataFrame, k: int = 12) -> DataFrame:
    return compared.where("delta IS NOT NULL").orderBy(F.desc(F.abs("delta")), "feature").limit(k)
