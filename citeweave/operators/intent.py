"""Intents and the source types cited for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names of expected types and the type each stands for.
SYNONYMS = {
    "gov": "government", "government": "government", "official": "official", "institutional": "government", "edu": "education",
    "education": "education", "academic": "education", "university": "education", "official_brand": "official_brand",
    "brand": "official_brand", "manufacturer": "official_brand", "oem": "official_brand", "vendor": "official_brand",
    "dealer": "ecommerce", "dealership": "ecommerce", "shop": "ecommerce", "store": "ecommerce", "ecommerce": "ecommerce",
    "e-commerce": "ecommerce", "marketplace": "ecommerce", "retail": "ecommerce", "review": "review", "reviews": "review",
    "news": "news", "media": "news", "press": "news", "forum": "forum", "community": "forum", "wiki": "reference",
    "reference": "reference", "encyclopedia": "reference", "blog": "blog", "video": "video", "social": "social",
    "hospital": "hospital", "clinic": "hospital", "medical": "hospital", "health": "hospital",
}


def canonical_type(token: Column) -> Column:
    t = F.replace(F.lower(F.trim(F.coalesce(token, F.lit("")))), F.lit(" "), F.lit("_"))
    table = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, t), t)


def effective_types(kind: Column, institutional: Column, brand: Column) -> Column:
    """Type tags of a source: its canonical type, and those its flags add."""
    none = F.array().cast("array<string>")
    official = F.when(institutional, F.array(F.lit("official"), F.lit("government"))).otherwise(none)
    own = F.when(brand, F.array(F.lit("official_brand"))).otherwise(none)
    return F.array_distinct(F.concat(F.array(canonical_type(F.coalesce(kind, F.lit("unknown")))), official, own))


def _intent() -> Column:
    return F.coalesce(F.nullif(F.col("intent"), F.lit("")), F.lit("Unspecified"))


def _group() -> Column:
    return F.when(F.col("cited") == 1, "cited").otherwise("more_only")


def intent_source_long(rows: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("source_type"), F.lit("")), F.lit("unknown"))
    return rows.groupBy(_intent().alias("intent"), kind.alias("source_type"), _group().alias("grp")).agg(F.count("*").alias("n"))


def intent_pivot(rows: DataFrame) -> DataFrame:
    """(intent, source_type) by group, with the cite rate."""
    wide = intent_source_long(rows).groupBy("intent", "source_type").pivot("grp", ["cited", "more_only"]).agg(F.sum("n")).na.fill(0)
    return wide.withColumn("cite_rate", F.coalesce(F.round(F.try_divide(F.col("cited"), F.col("cited") + F.col("more_only")), 4), F.lit(0.0)))


def intent_group_pivot(rows: DataFrame, group: str) -> DataFrame:
    """(intent, source_type, n) of one group of sources: cited or more_only."""
    return intent_source_long(rows).where(F.col("grp") == group).select("intent", "source_type", "n").orderBy("intent", F.desc("n"), "source_type")


def intent_row_share(rows: DataFrame) -> DataFrame:
    """Percent of each source type among all of an intent's surfaced sources, cited or not."""
    counts = intent_source_long(rows).groupBy("intent", "source_type").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy("intent"))
    return counts.select("intent", "source_type", "n", F.round(100.0 * F.col("n") / F.greatest(total, F.lit(1)), 4).alias("pct"))


def intent_summary(rows: DataFrame) -> DataFrame:
    """Cite rate and make-up of the cited sources by intent; the modal type's ties go by name."""
    rows = rows.withColumn("intent", _intent())
    c = F.col("cited") == 1
    share = lambda p: F.coalesce(F.round(F.try_divide(F.count_if(c & p), F.count_if(c)), 4), F.lit(0.0))
    stats = rows.groupBy("intent").agg(
        F.count("*").alias("n_sources"), F.count_if(c).alias("n_cited"), F.round(F.count_if(c) / F.count("*"), 4).alias("cite_rate"),
        share(F.col("institutional_official") | F.col("brand_official_candidate")).alias("official_cited_pct"),
        *[share(F.col("source_type") == t).alias(f"{t}_cited_pct") for t in ("review", "ecommerce", "forum")])
    counts = rows.where(c).groupBy("intent", "source_type").agg(F.count("*").alias("n"))
    mode = counts.groupBy("intent").agg(F.min(F.struct((-F.col("n")).alias("m"), "source_type")).alias("t")).select("intent", F.col("t.source_type").alias("top_cited_type"))
    return stats.join(mode, "intent", "left")


def expected_vs_actual(rows: DataFrame, key: str = "record_id", ord_col: str = "ord") -> DataFrame:
    """Per question: which of its expected types were cited, which were not, what else was cited.

    ``rows``: key, ord, intent, prompt, expected_source_types, source_type, flags, cited.
    """
    tags = effective_types(F.col("source_type"), F.col("institutional_official"), F.col("brand_official_candidate"))
    kind = F.coalesce(F.nullif(F.col("source_type"), F.lit("")), F.lit("unknown"))
    c = F.col("cited") == 1
    listed = F.size(F.coalesce("expected_source_types", F.array())) > 0
    g = rows.groupBy(key).agg(
        F.min_by("intent", ord_col).alias("intent"), F.substring(F.coalesce(F.min_by("prompt", ord_col), F.lit("")), 1, 60).alias("prompt"),
        F.min_by("expected_source_types", F.when(listed, F.col(ord_col))).alias("wants"),
        F.array_distinct(F.flatten(F.collect_set(F.when(c, tags)))).alias("tags"), F.collect_set(F.when(c, kind)).alias("kinds"),
    ).where(F.col("wants").isNotNull())
    found = F.filter("wants", lambda t: F.array_contains("tags", canonical_type(t)))
    missing = F.filter("wants", lambda t: ~F.array_contains("tags", canonical_type(t)))
    wanted = F.transform("wants", canonical_type)
    other = F.array_sort(F.filter("kinds", lambda t: ~F.array_contains(wanted, canonical_type(t))))
    join = lambda x: F.array_join(x, "; ")
    return g.select(key, "intent", "prompt", join("wants").alias("expected"), join(found).alias("cited_found"), join(missing).alias("expected_missing"),
                    join(F.slice(other, 1, 6)).alias("unexpected_cited"), F.round(F.size(found) / F.size("wants"), 4).alias("coverage"))
