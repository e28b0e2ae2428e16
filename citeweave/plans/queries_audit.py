"""Exports, manifests, semi-structured fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions.text import prompt_key
from citeweave.functions.urls import normalize_url
from citeweave.plans.bindings import CV, cv, read
from citeweave.sources import export, manifest


def source_union_dedup(spark, sf):
    """Pages as three origins of appearances, merged by record and URL."""
    p, k = read(spark, sf, "pages"), F.col("page_id")
    rows = p.select(
        (k % 6).alias("record_id"), F.concat(F.regexp_extract("url", "^([^:]+://[^/]+)", 1), F.lit("/")).alias("url"), (k % 3).cast("int").alias("prio"), k.cast("int").alias("pos"),
        F.when(k % 3 == 0, "citations").when(k % 3 == 1, "search_sources_more").otherwise("search_sources").alias("origin"), F.when((k % 3 == 0) & (k % 2 == 0), 1).otherwise(0).alias("cited"),
        F.when(k % 3 == 2, k % 7).otherwise(k).cast("int").alias("position"), F.when(k % 3 == 2, k % 7).cast("int").alias("observed_rank"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("title "), k.cast("string"))).alias("title"), F.lit(None).cast("string").alias("description"), F.lit("").alias("domain"),
        F.lit(None).cast("string").alias("icon"), F.when(k % 5 == 0, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("date_published"),
    ).withColumn("normalized_url", normalize_url(F.col("url")))
    out = export.merge_appearances(rows)
    return out.select("record_id", "normalized_url", "url", "source_origin", "source_group", "cited_label", "source_position", "observed_rank", "title", "date_published", "source_id", "domain", F.size("appearances").cast("long").alias("n_appearances"))


def json_props_extract(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


def _manifest(spark, sf):
    """A manifest of the benchmark items and of every third prompt, in other spacing."""
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("ordinal"), F.concat(F.lit("B"), F.col("item_id")).alias("prompt_id"), F.lit("bench").alias("topic"), F.lit("").alias("intent"), F.col("text").alias("prompt"))
    c = cv(spark, sf).where("record_id % 3 = 0 AND prompt <> ''").select((F.col("record_id") + 100000).alias("ordinal"), F.concat(F.lit("C"), F.col("record_id")).alias("prompt_id"), F.lit("chat").alias("topic"), F.concat(F.lit("I"), F.col("record_id") % 4).alias("intent"), F.concat(F.lit("  "), F.replace("prompt", F.lit(" "), F.lit("  ")), F.lit(" ?!")).alias("prompt"))
    return manifest.parse_manifest(b.unionByName(c))


def _applied(spark, sf):
    return manifest.apply_manifest(cv(spark, sf).select("record_id", "ord", "prompt"), _manifest(spark, sf))


def manifest_join(spark, sf):
    return _applied(spark, sf).select("record_id", "matched", "prompt_id", "intent", "topic")


def manifest_unmatched(spark, sf):
    return manifest.unmatched_prompts(_applied(spark, sf))


def prompt_keys(spark, sf):
    return cv(spark, sf).select("record_id", prompt_key(F.col("prompt")).alias("key"))


_NAMES = "source_union_dedup json_props_extract manifest_join manifest_unmatched prompt_keys".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_KEY = lambda c: f"""trim(regexp_replace(trim(lower({c})), '\\s+', ' ', 'g'), ' ?.!"''')"""
_MAN = f"""{CV}, man AS (SELECT item_id AS ordinal, 'B' || item_id AS prompt_id, 'bench' AS topic, 'Unspecified' AS intent, {_KEY('text')} AS key FROM benchmark
  UNION ALL SELECT record_id + 100000, 'C' || record_id, 'chat', 'I' || (record_id % 4), {_KEY("'  ' || replace(prompt, ' ', '  ') || ' ?!'")} FROM cv WHERE record_id % 3 = 0 AND prompt <> ''),
one AS (SELECT * FROM man WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ordinal) = 1),
app AS (SELECT cv.record_id, ord, prompt, one.key IS NOT NULL AS matched, one.prompt_id, coalesce(one.intent, '(unmatched)') AS intent, coalesce(one.topic, '(unmatched)') AS topic FROM cv LEFT JOIN one ON {_KEY('prompt')} = one.key)"""
_first = lambda c: f"arg_min({c}, prio * 10000000::BIGINT + pos) FILTER (WHERE {c} IS NOT NULL AND {c}::VARCHAR <> '')"
ORACLE = {
    "source_union_dedup": f"""WITH r AS (SELECT page_id % 6 AS record_id, regexp_extract(url, '^([^:]+://[^/]+)', 1) || '/' AS url, page_id % 3 AS prio, page_id AS pos,
  CASE page_id % 3 WHEN 0 THEN 'citations' WHEN 1 THEN 'search_sources_more' ELSE 'search_sources' END AS origin, CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END AS cited,
  (CASE WHEN page_id % 3 = 2 THEN page_id % 7 ELSE page_id END)::INTEGER AS position, (CASE WHEN page_id % 3 = 2 THEN page_id % 7 END)::INTEGER AS observed_rank,
  CASE WHEN page_id % 4 = 0 THEN '' ELSE 'title ' || page_id END AS title, CASE WHEN page_id % 5 = 0 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS date_published FROM pages),
n AS (SELECT *, regexp_replace(lower(regexp_extract(url, '://([^/]+)', 1)), '^www\\.', '') AS host FROM r)
SELECT record_id, 'https://' || host || '/' AS normalized_url, arg_min(url, prio * 10000000::BIGINT + pos) AS url, coalesce(arg_min(origin, prio * 10000000::BIGINT + pos) FILTER (WHERE cited = 1), arg_min(origin, prio * 10000000::BIGINT + pos)) AS source_origin,
  CASE WHEN max(cited) = 1 THEN 'cited' ELSE 'more_only' END AS source_group, max(cited) AS cited_label, {_first('position')} AS source_position, {_first('observed_rank')} AS observed_rank, coalesce({_first('title')}, '') AS title,
  {_first('date_published')} AS date_published, substring(sha1(record_id || ':https://' || host || '/'), 1, 12) AS source_id, host AS domain, count(*) AS n_appearances FROM n GROUP BY record_id, host""",
    "json_props_extract": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "manifest_join": f"WITH {_MAN} SELECT record_id, matched, prompt_id, intent, topic FROM app",
    "manifest_unmatched": f"WITH {_MAN} SELECT ord, substring(prompt, 1, 60) AS prompt FROM app WHERE NOT matched ORDER BY ord LIMIT 10",
    "prompt_keys": f"WITH {CV} SELECT record_id, {_KEY('prompt')} AS key FROM cv",
}
