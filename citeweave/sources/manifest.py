"""Prompt manifests: intents, topics and expectations for prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.text import prompt_key, split_expected, split_terms, truthy_or_null
from citeweave.operators.matching import first_rows
from citeweave.sources.export import numbered

FIELDS = (
    "prompt_id id topic intent prompt country prompt_language language expected_source_types client_brand_terms_to_detect_in_output "
    "competitor_terms_to_detect_in_output prompt_is_nonbranded visibility_goal prompt_hash"
).split()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"') if path.lower().endswith(".csv") else spark.read.json(path, multiLine=True)
    return numbered(raw)


def parse_manifest(raw: DataFrame) -> DataFrame:
    """Entries of a manifest; rows with neither prompt nor hash go.  ``raw`` has an ``ordinal`` and any of FIELDS."""
    have = {f: (F.col(f) if f in raw.columns else F.lit(None)).cast("string") for f in FIELDS}
    t = lambda f: F.nullif(F.trim(have[f]), F.lit(""))
    file = F.col("file") if "file" in raw.columns else F.lit(None).cast("string")
    own = F.concat(F.lit("P"), F.concat_ws("-", file, (F.col("ordinal") + 1).cast("string")))
    rows = raw.select(
        "ordinal", F.coalesce(t("prompt_id"), t("id"), own).alias("prompt_id"), F.coalesce(t("topic"), F.lit("")).alias("topic"),
        F.coalesce(t("intent"), F.lit("Unspecified")).alias("intent"), F.coalesce(t("prompt"), F.lit("")).alias("prompt"), have["country"].alias("country"),
        F.coalesce(t("prompt_language"), t("language")).alias("prompt_language"), split_expected(have["expected_source_types"]).alias("expected_source_types"),
        split_terms(have["client_brand_terms_to_detect_in_output"]).alias("client_terms"), split_terms(have["competitor_terms_to_detect_in_output"]).alias("competitor_terms"),
        truthy_or_null(have["prompt_is_nonbranded"]).alias("prompt_is_nonbranded"), F.coalesce(t("visibility_goal"), F.lit("")).alias("visibility_goal"), t("prompt_hash").alias("prompt_hash"),
    )
    return rows.where("prompt <> '' OR prompt_hash IS NOT NULL").withColumn("key", prompt_key(F.col("prompt")))


def manifest_warnings(raw: DataFrame) -> DataFrame:
    """(ordinal, warning) of the rows that ``parse_manifest`` leaves out."""
    t = lambda f: F.nullif(F.trim((F.col(f) if f in raw.columns else F.lit(None)).cast("string")), F.lit(""))
    return raw.where(t("prompt").isNull() & t("prompt_hash").isNull()).select("ordinal", F.format_string("manifest row %d has neither prompt nor hash, skipped", (F.col("ordinal") + 1).cast("long")).alias("warning"))


_GIVEN = ("prompt_id", "topic", "intent", "country", "prompt_language", "expected_source_types", "client_terms", "competitor_terms", "prompt_is_nonbranded", "visibility_goal")


def apply_manifest(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """``records`` with the entry of their hash, else of their prompt's key; unmatched ones are named so.

    Two left joins; Spark broadcasts the manifest if it is small.
    """
    entry = F.struct(*_GIVEN)
    by_hash = first_rows(manifest.where("prompt_hash IS NOT NULL").select("prompt_hash", "ordinal", entry.alias("by_hash")), "prompt_hash", "ordinal").select("prompt_hash", "by_hash")
    by_key = first_rows(manifest.where("key <> ''").select("key", "ordinal", entry.alias("by_key")), "key", "ordinal").select("key", "by_key")
    if "prompt_hash" not in records.columns:
        records = records.withColumn("prompt_hash", F.lit(None).cast("string"))
    met = records.withColumn("key", prompt_key(F.col("prompt"))).join(by_hash, "prompt_hash", "left").join(by_key, "key", "left").withColumn("e", F.coalesce("by_hash", "by_key"))
    own = {c: F.col(f"e.{c}") for c in _GIVEN}
    own["matched"] = F.col("e").isNotNull()
    own["intent"] = F.coalesce("e.intent", F.lit("(unmatched)"))
    own["topic"] = F.when(F.col("e").isNotNull(), F.col("e.topic")).otherwise(F.coalesce(F.nullif(F.col("topic"), F.lit("")), F.lit("(unmatched)")) if "topic" in records.columns else F.lit("(unmatched)"))
    if "country" in records.columns:
        own["country"] = F.coalesce(F.nullif(F.col("country"), F.lit("")), F.col("e.country"))
    for c in ("expected_source_types", "client_terms", "competitor_terms"):
        own[c] = F.coalesce(f"e.{c}", F.array().cast("array<string>"))
    return met.withColumns(own).drop("e", "by_hash", "by_key", "key")


def unmatched_prompts(applied: DataFrame, k: int = 10) -> DataFrame:
    return applied.where(~F.col("matched")).orderBy("ord").limit(k).select("ord", F.substring("prompt", 1, 60).alias("prompt"))
