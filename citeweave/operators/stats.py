"""Rank test and bootstrap by feature."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.operators.compare import group_compare, long_features
from citeweave.operators.ordered import at_positions, counted


def _in_bins(long: DataFrame) -> DataFrame:
    """Counted values of each feature with ``inner``, their average rank within their bin."""
    counts = counted(long.where("value IS NOT NULL"), ["feature"], "value", F.sum("cited").cast("long").alias("n_cited"))[0]
    upto = F.sum("n").over(W.partitionBy("feature", "bin").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    return counts.withColumn("inner", upto - (F.col("n") - 1) / F.lit(2.0).cast("double"))


def _before(column: str):
    """Sum of ``column`` over the bins of the feature before this one."""
    return F.sum(column).over(W.partitionBy("feature").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) - F.col(column)


def average_ranks(long: DataFrame) -> DataFrame:
    """(feature, value, ties, rank): the average rank of each distinct value.

    Ranks are running sums within bins of values, and the bins' own running sum stands before them.
    """
    ranked = _in_bins(long)
    bins = ranked.groupBy("feature", "bin").agg(F.sum("n").alias("m")).select("feature", "bin", _before("m").alias("before"))
    return ranked.join(bins, ["feature", "bin"]).select("feature", "value", F.col("n").alias("ties"), F.col("n_cited").alias("ties_cited"), (F.col("before") + F.col("inner")).alias("rank"))


@F.pandas_udf(T.DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or math.isnan(x) else round(min(1.0, max(0.0, math.erfc(abs(x) / math.sqrt(2)))), 4))


def mann_whitney(rows: DataFrame, features: list[str], with_p: bool = True) -> DataFrame:
    """(feature, n1, n2, u, tie_term[, p_value]): two-sided, tie-corrected, no continuity correction.

    Null below three values in either group; p is null without variance.
    """
    t = F.col("n").cast("double")
    # A bin's share of the rank sum: its cited values' ranks inside, and for each of them what stands before the bin.
    bins = _in_bins(long_features(rows, features, ["cited"])).groupBy("feature", "bin").agg(
        F.sum("n").alias("m"), F.sum("n_cited").alias("c"), F.sum(F.col("inner") * F.col("n_cited")).alias("r"), F.sum(t * t * t - t).alias("tie_term"))
    s = bins.withColumn("before", _before("m")).groupBy("feature").agg(
        F.sum("c").cast("long").alias("n1"), F.sum(F.col("m") - F.col("c")).cast("long").alias("n2"),
        F.sum(F.col("r") + F.col("before") * F.col("c")).alias("r1"), F.sum("tie_term").alias("tie_term"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = F.when((n1 >= 3) & (n2 >= 3), F.least(u1, n1 * n2 - u1))
    s = s.select("feature", "n1", "n2", u.alias("u"), "tie_term")
    if not with_p:
        return s
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("tie_term"), n * (n - 1)))
    z = F.when(var > 0, (F.col("u") - n1 * n2 / 2) / F.sqrt(F.greatest(var, F.lit(0.0))))
    return s.withColumn("p_value", _two_sided(z))


def median_ranks(n: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranks (from 0) of the lower and upper middle of each of ``rounds`` resamples of n values.

    A resample is n uniform draws of a rank, and its middles are order statistics of uniform numbers,
    which are Beta distributed: no resample need be drawn.
    """
    rng, m = np.random.default_rng([seed, n]), n // 2
    if n % 2:
        low = high = rng.beta(m + 1, m + 1, rounds)
    else:
        low = rng.beta(m, m + 1, rounds)
        high = low + (1 - low) * rng.beta(1, m, rounds)
    return tuple(np.minimum((u * n).astype(np.int64), n - 1) for u in (low, high))


DRAWN = "feature string, median_diff double, ci_low double, ci_high double"


def bootstrap_median_diff(rows: DataFrame, features: list[str], rounds: int = 1500, seed: int = 12345) -> DataFrame:
    """(feature, median_diff, ci_low, ci_high): difference of the groups' medians, and the 2.5 and 97.5
    percentiles of the difference over resamples; no interval below three values in either group.

    Of a resample only the ranks of its middles matter, and these are drawn (``median_ranks``), at any size
    by the same method.  Only the values at drawn ranks leave their bins: some thousands a feature.  What
    is drawn follows from a group's number of values alone, so figures do not depend on partitions or order.
    """

    def drawn(n: int, cited: int) -> np.ndarray:
        middles = [(n - 1) // 2, n // 2] if n else []
        return np.unique(np.r_[middles, *median_ranks(n, rounds, seed + cited)]) if n >= 3 else np.unique(np.array(middles, np.int64))

    @F.pandas_udf("array<long>")
    def wanted(cited: pd.Series, of: pd.Series, before: pd.Series, upto: pd.Series) -> pd.Series:
        out, known = [], {}
        for c, n, a, b in zip(cited, of, before, upto):
            if (c, n) not in known:
                known[c, n] = drawn(int(n), int(c)).astype(np.int64)
            i, j = np.searchsorted(known[c, n], [a, b])
            out.append(known[c, n][i:j])
        return pd.Series(out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mid, many = {}, {}
        for c, part in pdf.groupby("cited"):
            n, look = int(part["n"].iloc[0]), part.set_index("position")["value"]
            mid[c] = (look[(n - 1) // 2] + look[n // 2]) / 2
            if n >= 3:
                low, high = median_ranks(n, rounds, seed + int(c))
                many[c] = (look[low].to_numpy() + look[high].to_numpy()) / 2
        lo, hi = (round(float(v), 4) for v in np.percentile(many[1] - many[0], [2.5, 97.5])) if len(many) == 2 else (None, None)
        diff = round(float(mid[1] - mid[0]), 4) if len(mid) == 2 else None
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "median_diff": [diff], "ci_low": [lo], "ci_high": [hi]}).astype({"median_diff": float, "ci_low": float, "ci_high": float})

    long = long_features(rows, features, ["cited"]).where("value IS NOT NULL AND cited IN (0, 1)")
    counts = counted(long, ["feature", "cited"])[0]
    found = at_positions(counts, ["feature", "cited"], lambda of, before, upto: wanted(F.col("cited"), of, before, upto))
    return found.withColumnRenamed("of", "n").groupBy("feature").applyInPandas(run, DRAWN)


def group_stats(rows: DataFrame, features: list[str]) -> DataFrame:
    """group_compare with the difference of medians, the rank test's p and the bootstrap interval."""
    tested = mann_whitney(rows, features).select("feature", "p_value")
    drawn = bootstrap_median_diff(rows, features)
    return group_compare(rows, features).join(tested, "feature", "left").join(drawn, "feature", "left")
