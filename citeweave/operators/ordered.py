"""Ranks and order statistics of grouped values; no task holds all values of a large group.

Equal values are counted first, and the counts are a stage: written once, read by all that follows.
A group of few distinct values (``FEW``; for quantiles ``HELD``) is one bin.  Where a group has more, bins are cut between
splitters that follow from its values: steps of ln(1 + |value|), and within a step equal parts of the
group's range, so values of one magnitude (times, ids) are told apart as well as values of many.  A bin
that still holds too many distinct values is cut in equal parts of its own range, again and again,
until none does.  Bins are numbered in the order of the values, so what stands before a bin is a running
sum over the bins of a group, and values are put in order only within a bin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.stages import scratch_keep

#: Steps to a factor of e, and parts of a range.
STEPS, PARTS = 4096, 4096
#: Distinct values that one task puts in order, and those whose counts ``percentile`` holds in memory.
FEW, HELD = 50_000, 500_000


def _part(x: Column, low: Column, high: Column) -> Column:
    """Which of PARTS equal parts of low..high a value is in; halves keep the difference finite."""
    share = F.try_divide(x / 2 - low / 2, high / 2 - low / 2)
    return F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * PARTS))).cast("long")


def _step(x: Column) -> Column:
    """Steps of ln(1 + |x|) under the sign; infinite values at either end, NaN above all."""
    step = F.floor(F.signum(x) * F.least(F.log1p(F.abs(x)), F.lit(1000.0)) * STEPS).cast("long")
    return F.when(F.isnan(x), F.lit(1 << 26)).otherwise(step)


def _ranged(counts: DataFrame, keys: list[str], out: str, number: Callable[[Column, Column, Column], Column], among: Column) -> DataFrame:
    """``counts`` with ``out``: ``number(value, low, high)``, the range being that of the key's values in ``among``."""
    x = F.col("value").cast("double")
    names = {k: f"__{i}" for i, k in enumerate(keys)}
    ranges = counts.groupBy(*[F.col(k).alias(v) for k, v in names.items()]).agg(F.min(F.when(among, x)).alias("__low"), F.max(F.when(among, x)).alias("__high"))
    met = counts.join(ranges, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()])
    return met.withColumn(out, number(x, F.col("__low"), F.col("__high"))).drop("__low", "__high", *names.values())


def _in_bins(counts: DataFrame, keys: list[str], keep: Callable) -> DataFrame:
    """``counts`` with ``bin``, a struct of the numbers of a value's step, part, part of that part, ..."""
    x = F.col("value").cast("double")
    finite = (F.abs(x) < float("inf")) & ~F.isnan(x)
    rows = _ranged(counts, keys, "b0", lambda v, low, high: _step(v) * PARTS + _part(v, low, high), finite)
    levels = 1
    while True:
        names = [f"b{i}" for i in range(levels)]
        rows = keep("bins", rows, levels)
        full = rows.groupBy(*keys, *names).agg(F.count("*").alias("m"), F.min("value").alias("low"), F.max("value").alias("high"))
        # One number: whether any bin is to be cut further.
        if levels == 6 or full.where((F.col("m") > FEW) & (F.col("low").cast("double") < F.col("high").cast("double"))).isEmpty():
            return rows.withColumn("bin", F.struct(*names)).drop(*names)
        rows = _ranged(rows, [*keys, *names], f"b{levels}", _part, finite)
        levels += 1


def counted(rows: DataFrame, keys: list[str], value: str = "value", *more: Column, few: int | None = None) -> tuple[DataFrame, bool]:
    """((keys.., value, n, more.., bin), few): distinct values with their number, and whether every group
    has at most ``few`` of them (default FEW).  Null values have n = 0."""
    keep = scratch_keep(rows.sparkSession)
    counts = keep("counted", rows.groupBy(*keys, F.col(value).alias("value")).agg(F.count(value).alias("n"), *more))
    small = counts.groupBy(*keys).count().where(F.col("count") > (FEW if few is None else few)).isEmpty()
    return (counts.withColumn("bin", F.lit(0)) if small else _in_bins(counts, keys, keep)), small


def at_positions(counts: DataFrame, keys: list[str], wanted: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(keys.., of, total, low, high, position, value): the values at the wanted positions, from 0, of each group.

    ``counts`` is what ``counted`` gives.  ``wanted(of, before, upto)`` is the array of those
    positions in a group of ``of`` values that are at least ``before`` and below ``upto``.  A group
    without values has one row, with ``of`` 0.
    """
    x, group = F.col("value"), W.partitionBy(*keys)
    bins = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("m"), F.sum(x * F.col("n")).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"))
    upto = F.sum("m").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    whole = {"of": F.sum("m"), "total": F.sum("total"), "low": F.min("low"), "high": F.max("high")}
    bins = bins.select(*keys, "bin", *[c.over(group).alias(k) for k, c in whole.items()], (upto - F.col("m")).alias("before"), upto.alias("upto"))
    bins = bins.withColumn("wanted", wanted(F.col("of"), F.col("before"), F.col("upto"))).where((F.size("wanted") > 0) | (F.col("of") == 0))
    # Groups may have null keys, which are groups like any other.
    names = {k: f"__{i}" for i, k in enumerate([*keys, "bin"])}
    bins = bins.select(*[F.col(k).alias(v) for k, v in names.items()], *whole, "before", "wanted")
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    met = counts.select(*keys, "value", "n", "bin").join(bins, same).drop(*names.values())
    upto = F.col("before") + F.sum("n").over(W.partitionBy(*keys, "bin").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    met = met.withColumn("upto", upto)
    mine = F.filter("wanted", lambda p: (p >= F.col("upto") - F.col("n")) & (p < F.col("upto")))
    met = met.withColumn("mine", mine).where((F.size("mine") > 0) | (F.col("of") == 0))
    return met.select(*keys, *whole, F.explode_outer("mine").alias("position"), "value")


def quantiles(rows: DataFrame, keys: list[str], at: dict[str, float], value: str = "value") -> DataFrame:
    """(keys.., n, mean, low, high, at..): one row a group, also of groups whose values are all null.

    Exact, by linear interpolation between neighbours, as ``percentile`` does; where groups have few
    distinct values it is ``percentile`` over the counts.
    """
    points = lambda *n: F.expr(f"percentile({value if not n else 'value'}, array({', '.join(f'{p}D' for p in at.values())}){''.join(', ' + c for c in n)})").alias("points")
    named = lambda one: one.select(*keys, "n", F.try_divide("total", "n").alias("mean"), "low", "high", *[F.col("points")[i].alias(c) for i, c in enumerate(at)])
    # Rows are counted without their values: where no group has many, nothing is written.
    if rows.groupBy(*keys).count().where(F.col("count") > HELD).isEmpty():
        x = F.col(value)
        return named(rows.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"), points()))
    counts, small = counted(rows, keys, value, few=HELD)
    if small:
        x = F.col("value")
        one = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(x * F.col("n")).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"), points("n"))
        return named(one)
    pos = {name: (lambda of, p=p: (of - 1) * F.lit(p)) for name, p in at.items()}

    def wanted(of: Column, before: Column, upto: Column) -> Column:
        both = F.array_distinct(F.array(*[f(x(of)) for x in pos.values() for f in (F.floor, F.ceil)]))
        return F.filter(both, lambda p: (p >= before) & (p < upto))

    found = at_positions(counts, keys, wanted)
    some = F.map_from_entries(F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "value"))))
    one = found.groupBy(*keys).agg(F.max("of").alias("n"), *[F.max(c).alias(c) for c in ("total", "low", "high")], some.alias("found"))

    def between(where: Column) -> Column:
        a, b = F.floor(where), F.ceil(where)
        low, high = F.col("found")[a], F.col("found")[b]
        return F.when(a == b, low).otherwise((b - where) * low + (where - a) * high)

    return one.select(*keys, "n", F.try_divide("total", "n").alias("mean"), "low", "high", *[between(x(F.col("n"))).alias(c) for c, x in pos.items()])
