"""Brand visibility."""

from __future__ import annotations

from citeweave.operators import brand
from citeweave.plans.bindings import BRAND, FR, FR_FEATURES, brand_inputs, fr
from citeweave.plans.queries_stats import _long


def _records(spark, sf):
    return brand.brand_records(*brand_inputs(spark, sf))


_FLAGS = [f"{b}_{x}" for b in ("client", "competitor") for x in ("appeared", "cited", "more_only")]


def brand_records(spark, sf):
    return _records(spark, sf).select("record_id", "is_nonbranded_prompt", "n_sources", "n_cited", "n_client_sources", "n_client_cited", "n_competitor_sources", "n_competitor_cited", *_FLAGS, "any_target_brand_appeared", "any_target_brand_cited")


def brand_by_intent(spark, sf):
    return brand.by_intent(_records(spark, sf))


def brand_overall(spark, sf):
    return brand.overall(_records(spark, sf))


def client_vs_competitor(spark, sf):
    return brand.client_vs_competitor(_records(spark, sf))


def brand_examples(spark, sf):
    return brand.examples(_records(spark, sf))


def cited_vs_more_only(spark, sf):
    return brand.cited_vs_more_only(fr(spark, sf), FR_FEATURES)


def position_controlled(spark, sf):
    return brand.position_controlled(fr(spark, sf), FR_FEATURES)


_NAMES = "brand_records brand_by_intent brand_overall client_vs_competitor brand_examples cited_vs_more_only position_controlled".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_k = lambda c: f"count_if(is_nonbranded_prompt AND {c})"
_rate = lambda c: f"coalesce(round({_k(c)} / nullif(count_if(is_nonbranded_prompt), 0), 4), 0.0)"
_rates = ", ".join(f"{_rate(c)} AS {c}_rate" for c in brand.RATES)
_delta = f"round({_rate('client_cited')} - {_rate('competitor_cited')}, 4) AS client_vs_competitor_cited_delta"
_m = lambda v: f"avg(value) FILTER (WHERE cited = {v})"
_stat = f"round({_m(1)}, 4) AS cited_mean, round({_m(0)}, 4) AS more_only_mean, round(round({_m(1)}, 4) - round({_m(0)}, 4), 4) AS delta, count(value) FILTER (WHERE cited = 1) AS n_cited, count(value) FILTER (WHERE cited = 0) AS n_more_only"
_grp = f"""l AS ({_long('fr', FR_FEATURES, "cited, topic, intent, is_client_source, is_competitor_source, source_position")}),
g AS (SELECT 'all' AS grp, * FROM l UNION ALL SELECT 'client', * FROM l WHERE is_client_source UNION ALL SELECT 'competitor', * FROM l WHERE is_competitor_source)"""
ORACLE = {
    "brand_records": f"WITH {BRAND} SELECT record_id, is_nonbranded_prompt, n_sources, n_cited, n_client_sources, n_client_cited, n_competitor_sources, n_competitor_cited, {', '.join(_FLAGS)}, any_target_brand_appeared, any_target_brand_cited FROM rec",
    "brand_by_intent": f"""WITH {BRAND}, ex AS (SELECT topic, intent, string_agg(p, ' | ' ORDER BY ord) AS example_prompts FROM (SELECT topic, intent, ord, substring(prompt, 1, 90) AS p, row_number() OVER (PARTITION BY topic, intent ORDER BY ord) AS rn FROM rec WHERE is_nonbranded_prompt) WHERE rn <= 3 GROUP BY 1, 2)
SELECT rec.topic, rec.intent, count(*) AS total_prompts, count_if(is_nonbranded_prompt) AS nonbranded_prompts, {', '.join(f'{_k(c)} AS n_{c}' for c in brand.RATES)}, {_rates}, {_delta}, coalesce(any_value(example_prompts), '') AS example_prompts
FROM rec LEFT JOIN ex ON rec.topic = ex.topic AND rec.intent = ex.intent GROUP BY 1, 2""",
    "brand_overall": f"WITH {BRAND} SELECT count(*) AS total_prompts, count_if(is_nonbranded_prompt) AS nonbranded_prompts, {_rates}, {_rate('any_target_brand_appeared')} AS any_target_brand_appeared_rate, {_rate('any_target_brand_cited')} AS any_target_brand_cited_rate, {_delta}, sum(n_client_sources)::BIGINT AS n_client_source_pages, sum(n_competitor_sources)::BIGINT AS n_competitor_source_pages FROM rec",
    "client_vs_competitor": f"WITH {BRAND} SELECT coalesce(topic, '(all)') AS topic, coalesce(intent, '(all)') AS intent, count_if(is_nonbranded_prompt) AS nonbranded_prompts, {_rates} FROM rec GROUP BY GROUPING SETS ((rec.topic, rec.intent), ())",
    "brand_examples": f"""WITH {BRAND}, e AS (SELECT 'client_cited' AS kind, * FROM rec WHERE is_nonbranded_prompt AND client_cited UNION ALL SELECT 'client_more_only', * FROM rec WHERE is_nonbranded_prompt AND client_more_only
  UNION ALL SELECT 'competitor_only', * FROM rec WHERE is_nonbranded_prompt AND competitor_appeared AND NOT client_appeared UNION ALL SELECT 'no_brand', * FROM rec WHERE is_nonbranded_prompt AND NOT any_target_brand_appeared)
SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY ord)::INTEGER AS rank, record_id, prompt FROM e QUALIFY rank <= 8""",
    "cited_vs_more_only": f"""WITH {FR}, {_grp}, h AS (SELECT grp, '(all)' AS topic, '(all)' AS intent, feature, value, cited FROM g UNION ALL SELECT 'by_intent', topic, intent, feature, value, cited FROM l)
SELECT grp, topic, intent, feature, {_stat}, round(median(value) FILTER (WHERE cited = 1), 4) AS cited_median, round(median(value) FILTER (WHERE cited = 0), 4) AS more_only_median FROM h GROUP BY ALL""",
    "position_controlled": f"WITH {FR}, {_grp} SELECT grp, CASE WHEN source_position <= 0 THEN 'unknown' WHEN source_position <= 3 THEN '1-3' WHEN source_position <= 6 THEN '4-6' WHEN source_position <= 10 THEN '7-10' ELSE '11+' END AS position_band, feature, {_stat} FROM g GROUP BY ALL",
}
