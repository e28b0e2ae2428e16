"""Rollups over pooled runs: overall, by topic, by intent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators.compare import group_compare, official_compare


def pool(runs: list[DataFrame]) -> DataFrame:
    """Rows of all runs under the union of their columns."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


#: What is said of a run whose landed answer no later stage can use.
NO_ANSWER = "AuditError: the landed answer has no text and no citation"


def run_errors(runs: DataFrame, citations: DataFrame) -> DataFrame:
    """``runs`` (run_id, prompt, output_text, ...[, error]) that have a prompt, with ``error``: what their
    landing reported, else that there is nothing to audit; null for runs that go on."""
    error = F.nullif(F.trim(F.col("error")), F.lit("")) if "error" in runs.columns else F.lit(None).cast("string")
    cited = citations.select(F.col("run_id").alias("__run")).distinct().withColumn("__cited", F.lit(True))
    rows = runs.where(F.trim(F.coalesce("prompt", F.lit(""))) != "").withColumn("error", error).join(cited, F.col("run_id") == F.col("__run"), "left")
    nothing = (F.coalesce("output_text", F.lit("")) == "") & F.col("__cited").isNull()
    return rows.withColumn("error", F.when(F.col("error").isNull() & nothing, F.lit(NO_ANSWER)).otherwise(F.col("error"))).drop("__run", "__cited")


def run_overview(runs: DataFrame, features: DataFrame, matches: DataFrame, recall: DataFrame) -> DataFrame:
    """One row a run, failed ones with their error and nulls: candidates, distinct citations, fetched pages, strict recall at 10."""
    counts = features.groupBy("run_id").agg(F.count("*").alias("n_candidates"), F.count_if("scrape_success").alias("n_scraped"))
    cited = matches.groupBy("run_id").agg(F.count("*").alias("n_citations"))
    at = recall.where("mode = 'strict' AND k = 10").select("run_id", F.col("recall").alias("recall_strict_10"))
    out = runs.select("run_id", "prompt", "topic", "intent", "error").join(counts, "run_id", "left").join(cited, "run_id", "left").join(at, "run_id", "left")
    good = F.col("error").isNull()
    zero = lambda c, v: F.when(good, F.coalesce(c, v)).alias(c)
    return out.select("run_id", "prompt", "topic", "intent", "error", *[zero(c, F.lit(0).cast("long")) for c in ("n_candidates", "n_citations", "n_scraped")], zero("recall_strict_10", F.lit(0.0)))


def batch_aggregate(rows: DataFrame, features: list[str], topic: str = "topic", intent: str = "intent") -> DataFrame:
    """(level, name, feature, medians, means, ns): each row counts for all, for its topic and for its intent; empty intents are skipped."""
    names = {"overall": F.lit("(all)"), "topic": F.col(topic).cast("string"), "intent": F.nullif(F.col(intent).cast("string"), F.lit(""))}
    levels = F.filter(F.array(*[F.struct(F.lit(k).alias("level"), c.alias("name")) for k, c in names.items()]), lambda x: x["name"].isNotNull())
    dealt = rows.select(*features, "cited", F.explode(levels).alias("at")).select(*features, "cited", "at.level", "at.name")
    return group_compare(dealt, features, ["level", "name"]).select("level", "name", "feature", "cited_median", "non_cited_median", "cited_mean", "non_cited_mean", "n_cited", "n_non_cited")


def recall_average(recall: DataFrame) -> DataFrame:
    """(mode, k, recall): mean over the runs that have a value, else 0; rates are added as whole ten-thousandths, so halves round up alike everywhere."""
    mean = F.avg(F.round(F.col("recall") * 10_000).cast("long"))
    return recall.groupBy("mode", "k").agg(F.coalesce(F.round(mean) / 10_000, F.lit(0.0)).alias("recall"))


def sample_sizes(rows: DataFrame, run: str = "run_id") -> DataFrame:
    return rows.agg(F.countDistinct(run).alias("n_runs"), F.count("*").alias("n_candidates"), F.coalesce(F.sum("cited"), F.lit(0)).cast("long").alias("n_cited"), F.count_if("scrape_success").alias("n_scraped"))


def cite_patterns(rows: DataFrame, aggregate: DataFrame, correlations: DataFrame) -> DataFrame:
    """Sentences about what goes with being cited: medians, source types, strongest correlation, official rates."""
    medians = aggregate.where("level = 'overall' AND cited_median IS NOT NULL AND non_cited_median IS NOT NULL")
    lines = medians.select(F.lit(1).alias("part"), F.col("feature").alias("key"), F.format_string("%s: median %.4f cited, %.4f shown but not cited", "feature", "cited_median", "non_cited_median").alias("text"))
    kinds = rows.groupBy("source_type").agg(F.count("*").alias("n"), F.avg("cited").alias("r")).where("n >= 2").orderBy(F.desc("r"), "source_type").limit(2)
    lines = lines.unionByName(kinds.select(F.lit(2).alias("part"), F.col("source_type").alias("key"), F.format_string("%s sources are cited at a rate of %.4f", "source_type", "r").alias("text")))
    official = official_compare(rows).where("n > 0")
    lines = lines.unionByName(official.select(F.lit(4).alias("part"), F.col("grp").alias("key"), F.format_string("%s sources: cite rate %.4f", "grp", "cite_rate").alias("text")))
    top = correlations.where("corr IS NOT NULL").agg(F.min(F.struct((-F.abs("corr")).alias("m"), "feature", "corr")).alias("x")).where("x IS NOT NULL")
    return lines.unionByName(top.select(F.lit(3).alias("part"), F.col("x.feature").alias("key"), F.format_string("strongest correlation with being cited: %s (%.4f)", "x.feature", "x.corr").alias("text")))
