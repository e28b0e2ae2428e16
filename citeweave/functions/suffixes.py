"""Registrable domains by a file of public-suffix rules, looked up in a join.

The rule file is the caller's (for instance the list that many systems keep as
``public_suffix_list.dat``).  A rule is keyed by the labels it ends with: ``co.uk`` by itself, ``*.ck``
by ``ck`` with one free label before it, ``!www.ck`` by ``www.ck`` as an exception.  A host asks for all
its endings at once; an exception wins and stands for one label less, else the longest rule, else the
last label.  The registrable domain is the suffix and one label more.

Rules number some ten thousand, whatever the hosts; the side is counted before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIVATE = "===BEGIN PRIVATE DOMAINS==="
#: Rules up to which the side is broadcast.
BROADCAST_RULES = 200_000
RULES = "ending string, labels int, kind string"


def _ascii(rule: str) -> str:
    try:
        return rule.encode("idna").decode()
    except UnicodeError:
        return rule


def suffix_rules(spark: SparkSession, lines: list[str], private: bool = False) -> DataFrame:
    """(ending, labels, kind) of the rules in ``lines``; ``labels``: of the public suffix.  Names that are not
    ASCII count in both of their forms.  ``private``: with the rules of the list's second part."""
    rows = set()
    for line in lines:
        if PRIVATE in line and not private:
            break
        rule = line.split()[0].lower() if line.strip() and not line.startswith("//") else ""
        if not rule:
            continue
        kind = "except" if rule[0] == "!" else "any" if rule.startswith("*.") else "plain"
        body = rule.lstrip("!").removeprefix("*.")
        n = body.count(".") + 1
        for name in {body, ".".join(map(_ascii, body.split(".")))}:
            rows.add((name, n + {"except": -1, "any": 1, "plain": 0}[kind], kind))
    return spark.createDataFrame(sorted(rows), RULES)


def read_suffix_rules(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """``suffix_rules`` of a file; some fourteen thousand lines, which pass the driver once."""
    return suffix_rules(spark, [r["value"] for r in spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r?\n")).alias("value")).collect()], private)


def _address(host: Column) -> Column:
    return host.rlike(r"^[\d.]+$") | host.contains(":") | (host == "")


def with_registrable(df: DataFrame, host: str, out: str, rules: DataFrame) -> DataFrame:
    """``df`` with the registrable domain of its column ``host`` as ``out``; the host itself where it is an
    address or a public suffix.  Distinct hosts are looked up, so a host on many rows costs one lookup."""
    hosts = df.select(F.col(host).alias("__host")).where("__host IS NOT NULL").distinct()
    labels = hosts.where(~_address(F.col("__host"))).withColumn("__l", F.split("__host", r"\."))
    asked = labels.select("__host", F.size("__l").alias("__n"), F.posexplode("__l").alias("__at", "__x"), "__l")
    asked = asked.select("__host", "__n", (F.col("__n") - F.col("__at")).alias("__have"), F.array_join(F.slice("__l", F.col("__at") + 1, F.greatest(F.col("__n") - F.col("__at"), F.lit(1))), ".").alias("ending"))
    side = rules.select("ending", "labels", "kind")
    side = F.broadcast(side) if side.count() <= BROADCAST_RULES else side
    # A free label has to be there; a plain rule or exception is the ending itself.
    met = asked.join(side, "ending").where((F.col("kind") != "any") | (F.col("__n") > F.col("__have")))
    best = met.groupBy("__host").agg(F.max(F.when(F.col("kind") == "except", F.col("labels"))).alias("e"), F.max(F.when(F.col("kind") != "except", F.col("labels"))).alias("p"))
    found = labels.join(best, "__host", "left").withColumn("take", F.coalesce("e", "p", F.lit(1)) + 1)
    name = F.array_join(F.slice("__l", F.greatest(F.size("__l") - F.col("take") + 1, F.lit(1)), F.col("take")), ".")
    found = found.select("__host", F.when(F.size("__l") >= F.col("take"), name).alias("__root"))
    met = df.join(found, F.col(host) == F.col("__host"), "left")
    return met.withColumn(out, F.coalesce("__root", host)).drop("__host", "__root")
