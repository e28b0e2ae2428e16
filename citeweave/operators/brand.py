"""Brand visibility: where client and competitor brands appear, are cited, or are only shown.

*more_only* means shown but not cited.  All rates have the non-branded prompts as denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.operators.compare import group_compare

# Bands of source positions.
BANDS = ("1-3", "4-6", "7-10", "11+", "unknown")
RATES = ("client_appeared", "client_cited", "client_more_only", "competitor_appeared", "competitor_cited", "competitor_more_only")


def band(position: Column) -> Column:
    p = position.try_cast("int")
    return F.when(p.isNull() | (p <= 0), "unknown").when(p <= 3, "1-3").when(p <= 6, "4-6").when(p <= 10, "7-10").otherwise("11+")


def non_branded(flag: Column, mentions_client: Column) -> Column:
    """The explicit flag, else: the prompt does not name the client."""
    return F.coalesce(flag, ~mentions_client)


def brand_records(records: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a prompt, prompts without sources included.

    ``records``: record_id, ord, topic, intent, prompt, nonbranded (boolean or null), and arrays of
    terms found in prompt and answer: prompt_client, answer_client, answer_competitor.
    ``sources``: record_id, cited, client and competitor (booleans).
    """
    c = F.col("cited") == 1
    n = lambda p, name: F.count_if(p).alias(name)
    per = sources.groupBy("record_id").agg(
        F.count("*").alias("n_sources"), n(c, "n_cited"),
        *[x for b in ("client", "competitor") for x in (n(F.col(b), f"n_{b}_sources"), n(F.col(b) & c, f"n_{b}_cited"))])
    out = records.join(per, "record_id", "left")
    counts = [f for f in per.columns if f != "record_id"]
    out = out.withColumns({f: F.coalesce(f, F.lit(0).cast("long")) for f in counts})
    cols = {"is_nonbranded_prompt": non_branded(F.col("nonbranded"), F.size("prompt_client") > 0)}
    for b in ("client", "competitor"):
        answered = F.size(f"answer_{b}") > 0
        cols |= {
            f"{b}_in_answer": answered, f"{b}_in_sources": F.col(f"n_{b}_sources") > 0, f"{b}_cited": F.col(f"n_{b}_cited") > 0,
            f"{b}_more_only": (F.col(f"n_{b}_sources") > 0) & (F.col(f"n_{b}_cited") == 0), f"{b}_appeared": answered | (F.col(f"n_{b}_sources") > 0),
        }
    out = out.withColumns(cols)
    return out.withColumns({"any_target_brand_appeared": F.col("client_appeared") | F.col("competitor_appeared"), "any_target_brand_cited": F.col("client_cited") | F.col("competitor_cited")})


def _rates(denominator: str) -> dict[str, Column]:
    rate = lambda c: F.coalesce(F.round(F.try_divide(F.col(f"k_{c}"), F.col(denominator)), 4), F.lit(0.0))
    return {f"{c}_rate": rate(c) for c in RATES}


def _counts() -> list[Column]:
    nb = F.col("is_nonbranded_prompt")
    return [F.count("*").alias("total_prompts"), F.count_if(nb).alias("nonbranded_prompts"), *[F.count_if(nb & F.col(c)).alias(f"k_{c}") for c in RATES]]


def by_intent(records: DataFrame, k: int = 3) -> DataFrame:
    """Counts and rates a (topic, intent), with its first k prompts; of other prompts nothing is gathered."""
    keys = ["topic", "intent"]
    asked = records.where("is_nonbranded_prompt").select(*keys, "ord", F.substring("prompt", 1, 90).alias("p"))
    first = asked.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("ord", "p"))).where(F.col("rank") <= k)
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "p"))), lambda x: x["p"]), " | ")
    first = first.groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(shown.alias("example_prompts"))
    g = records.groupBy(*keys).agg(*_counts()).withColumns(_rates("nonbranded_prompts"))
    g = g.withColumn("client_vs_competitor_cited_delta", F.round(F.col("client_cited_rate") - F.col("competitor_cited_rate"), 4))
    g = g.join(first, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left").drop(*[f"__{c}" for c in keys])
    return g.withColumn("example_prompts", F.coalesce("example_prompts", F.lit(""))).withColumnsRenamed({f"k_{c}": f"n_{c}" for c in RATES})


def overall(records: DataFrame) -> DataFrame:
    nb = F.col("is_nonbranded_prompt")
    more = [F.count_if(nb & F.col(c)).alias(f"k_{c}") for c in ("any_target_brand_appeared", "any_target_brand_cited")]
    pages = [F.coalesce(F.sum(f"n_{b}_sources"), F.lit(0)).cast("long").alias(f"n_{b}_source_pages") for b in ("client", "competitor")]
    one = records.agg(*_counts(), *more, *pages).withColumns(_rates("nonbranded_prompts"))
    any_rate = lambda c: F.coalesce(F.round(F.try_divide(F.col(f"k_{c}"), F.col("nonbranded_prompts")), 4), F.lit(0.0)).alias(f"{c}_rate")
    return one.select("total_prompts", "nonbranded_prompts", *[f"{c}_rate" for c in RATES], any_rate("any_target_brand_appeared"), any_rate("any_target_brand_cited"),
                      F.round(F.col("client_cited_rate") - F.col("competitor_cited_rate"), 4).alias("client_vs_competitor_cited_delta"), "n_client_source_pages", "n_competitor_source_pages")


def client_vs_competitor(records: DataFrame) -> DataFrame:
    """Overall row and one a (topic, intent): grouping sets over one pass."""
    g = records.groupingSets([["topic", "intent"], []], "topic", "intent").agg(F.grouping_id().alias("g"), *_counts()).withColumns(_rates("nonbranded_prompts"))
    name = lambda c: F.when(F.col("g") == 0, F.col(c)).otherwise("(all)").alias(c)
    return g.select(name("topic"), name("intent"), "nonbranded_prompts", *[f"{c}_rate" for c in RATES])


def examples(records: DataFrame, k: int = 8) -> DataFrame:
    """First k prompts of each kind: who appeared and who was cited."""
    nb, col = F.col("is_nonbranded_prompt"), F.col
    kinds = {
        "client_cited": nb & col("client_cited"), "client_more_only": nb & col("client_more_only"),
        "competitor_only": nb & col("competitor_appeared") & ~col("client_appeared"), "no_brand": nb & ~col("any_target_brand_appeared"),
    }
    hit = F.explode(F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in kinds.items()])))
    rank = F.row_number().over(W.partitionBy("kind").orderBy("ord"))
    return records.select(hit.alias("kind"), "ord", "record_id", "prompt").withColumn("rank", rank).where(F.col("rank") <= k).select("kind", "rank", "record_id", "prompt")


def _groups(pages: DataFrame) -> DataFrame:
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("is_client_source"), "client"), F.when(F.col("is_competitor_source"), "competitor")))
    return pages.withColumn("grp", F.explode(names))


def cited_vs_more_only(pages: DataFrame, features: list[str]) -> DataFrame:
    """Feature statistics for all pages, client pages, competitor pages, and by (topic, intent)."""
    named = _groups(pages).withColumns({"topic": F.lit("(all)"), "intent": F.lit("(all)")})
    rows = named.unionByName(pages.withColumn("grp", F.lit("by_intent")).select(named.columns))
    out = group_compare(rows, features, ["grp", "topic", "intent"], rounded_delta=True)
    return out.withColumnsRenamed({"non_cited_mean": "more_only_mean", "non_cited_median": "more_only_median", "n_non_cited": "n_more_only"})


def position_controlled(pages: DataFrame, features: list[str]) -> DataFrame:
    """The same within bands of source position; bands without pages are left out."""
    rows = _groups(pages).withColumn("position_band", band(F.coalesce(F.col("source_position"), F.col("observed_rank"))))
    out = group_compare(rows, features, ["grp", "position_band"], rounded_delta=True)
    return out.withColumnsRenamed({"non_cited_mean": "more_only_mean", "n_non_cited": "n_more_only"}).drop("cited_median", "non_cited_median")
