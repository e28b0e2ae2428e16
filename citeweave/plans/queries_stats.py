"""Cited against non-cited: statistics, breakdowns, questions, intents, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions.text import split_expected
from citeweave.operators import batch, compare, intent, questions, stats
from citeweave.plans.bindings import EXPECTED, FR, FR_FEATURES, LI, LI_FEATURES, QD, fr, li, qd, read


def _long(table: str, features: list[str], keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{f}' AS feature, {f}::DOUBLE AS value FROM {table}" for f in features)


def _compare(table: str, features: list[str], by: str = "", rounded: bool = False, keep: str = "cited") -> str:
    m = lambda v: f"avg(value) FILTER (WHERE cited = {v})"
    delta = f"round(round({m(1)}, 4) - round({m(0)}, 4), 4)" if rounded else f"round({m(1)} - {m(0)}, 4)"
    return f"""SELECT {by}feature, round({m(1)}, 4) AS cited_mean, round({m(0)}, 4) AS non_cited_mean, round(median(value) FILTER (WHERE cited = 1), 4) AS cited_median,
  round(median(value) FILTER (WHERE cited = 0), 4) AS non_cited_median, {delta} AS delta, count(value) FILTER (WHERE cited = 1) AS n_cited, count(value) FILTER (WHERE cited = 0) AS n_non_cited
  FROM ({_long(table, features, keep)}) GROUP BY ALL"""


def group_compare(spark, sf):
    return compare.group_compare(fr(spark, sf), FR_FEATURES)


def group_compare_large(spark, sf):
    return compare.group_compare(li(spark, sf), LI_FEATURES)


def top_deltas(spark, sf):
    return compare.top_deltas(group_compare(spark, sf), 2).select("feature", "delta")


def source_breakdown(spark, sf):
    return compare.source_breakdown(li(spark, sf))


def official_compare(spark, sf):
    return compare.official_compare(fr(spark, sf))


def top_domains(spark, sf):
    return compare.top_domains(qd(spark, sf), 1)


def audit_summary(spark, sf):
    return compare.summary(fr(spark, sf))


def correlation_with_cited(spark, sf):
    return compare.correlation_with_cited(fr(spark, sf).withColumn("constant", F.lit(1)), [*FR_FEATURES, "constant"])


def length_sim_corr(spark, sf):
    return compare.length_similarity_correlation(fr(spark, sf), "word_count", "digit_count")


def mann_whitney_u(spark, sf):
    return stats.mann_whitney(fr(spark, sf), FR_FEATURES, with_p=False)


def mann_whitney_p(spark, sf):
    return stats.mann_whitney(fr(spark, sf), FR_FEATURES)


def average_ranks(spark, sf):
    return stats.average_ranks(compare.long_features(fr(spark, sf), ["word_count"], ["cited"])).select("value", "ties", "rank")


def bootstrap_median_ci(spark, sf):
    return stats.bootstrap_median_diff(fr(spark, sf), FR_FEATURES)


def question_table(spark, sf):
    return questions.question_table(qd(spark, sf))


def question_top_domains(spark, sf):
    return questions.top_per(qd(spark, sf), "qid", "domain", 3)


def jaccard_pairs(spark, sf):
    return questions.jaccard_pairs(questions.domain_sets(qd(spark, sf), "all"))


def question_clusters(spark, sf):
    rows = qd(spark, sf)
    return questions.cluster_summary(rows, questions.cluster_questions(rows, 4))


def question_groups(spark, sf):
    """Twenty pages make a question, so questions grow with the pages; each with its cluster."""
    host = F.regexp_extract("url", "^[^:]+://([^/]+)", 1)
    rows = read(spark, sf, "pages").select(F.floor(F.col("page_id") / 20).cast("long").alias("qid"), host.alias("domain"), (F.col("page_id") % 5 < 2).cast("int").alias("cited"))
    return questions.cluster_questions(rows, 8)


def question_matrix(spark, sf):
    wide = questions.question_matrix(qd(spark, sf), 20)
    names = [c for c in wide.columns if c != "qid"]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("domain"), F.col(f"`{c}`").alias("n")) for c in names]))
    return wide.select("qid", cells.alias("x")).select("qid", "x.*")


def intent_source_long(spark, sf):
    return intent.intent_source_long(fr(spark, sf))


def intent_source_pivot(spark, sf):
    return intent.intent_pivot(fr(spark, sf))


def intent_row_pct(spark, sf):
    return intent.intent_row_share(fr(spark, sf))


def intent_summary(spark, sf):
    return intent.intent_summary(fr(spark, sf))


def expected_vs_actual(spark, sf):
    rows = fr(spark, sf).withColumns({"expected_source_types": split_expected(F.lit(EXPECTED)), "prompt": F.concat(F.lit("prompt "), F.col("ord").cast("string"))})
    return intent.expected_vs_actual(rows)


def batch_aggregate(spark, sf):
    return batch.batch_aggregate(fr(spark, sf), FR_FEATURES)


def sample_sizes(spark, sf):
    return batch.sample_sizes(fr(spark, sf))


def heatmap_minmax(spark, sf):
    from citeweave.operators.profile import min_max

    return min_max(fr(spark, sf).orderBy(F.desc("cited"), "ord").limit(24), ["n_chars", "word_count"]).select("ord", "n_chars", "word_count")


def box_statistics(spark, sf):
    from citeweave.operators.profile import box_statistics as box

    return box(li(spark, sf), "source_type", "l_quantity")


_NAMES = (
    "group_compare group_compare_large top_deltas source_breakdown official_compare top_domains audit_summary correlation_with_cited length_sim_corr mann_whitney_u mann_whitney_p "
    "average_ranks bootstrap_median_ci question_table question_top_domains jaccard_pairs question_clusters question_groups question_matrix intent_source_long intent_source_pivot intent_row_pct "
    "intent_summary expected_vs_actual batch_aggregate sample_sizes heatmap_minmax box_statistics"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_CORR = lambda x, y: f"CASE WHEN count(*) >= 3 AND min({x}) < max({x}) AND min({y}) < max({y}) THEN round(corr({x}, {y}), 4) END"
_TOP3 = "SELECT qid, domain, count(*) AS n, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, domain) AS rank FROM qd WHERE domain IS NOT NULL GROUP BY qid, domain"
_GRP = "CASE WHEN cited = 1 THEN 'cited' ELSE 'more_only' END"
_PCT = lambda p: f"coalesce(round(count_if(cited = 1 AND {p}) / nullif(count_if(cited = 1), 0), 4), 0.0)"
_TAGS = "(CASE WHEN institutional_official THEN ['official', 'government'] ELSE [] END || CASE WHEN brand_official_candidate THEN ['official_brand'] ELSE [] END || [source_type])"
_LEVEL = lambda level, name, cond="true": f"""SELECT '{level}' AS level, {name} AS name, feature, round(median(value) FILTER (WHERE cited = 1), 4) AS cited_median, round(median(value) FILTER (WHERE cited = 0), 4) AS non_cited_median,
  round(avg(value) FILTER (WHERE cited = 1), 4) AS cited_mean, round(avg(value) FILTER (WHERE cited = 0), 4) AS non_cited_mean, count(value) FILTER (WHERE cited = 1) AS n_cited, count(value) FILTER (WHERE cited = 0) AS n_non_cited FROM l WHERE {cond} GROUP BY ALL"""  # noqa: E731
_NORM = lambda c: f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 4) ELSE 0.5 END AS {c}"
ORACLE = {
    "group_compare": f"WITH {FR} {_compare('fr', FR_FEATURES)}",
    "group_compare_large": f"WITH {LI} {_compare('li', LI_FEATURES)}",
    "top_deltas": f"WITH {FR} SELECT feature, delta FROM ({_compare('fr', FR_FEATURES)}) WHERE delta IS NOT NULL ORDER BY abs(delta) DESC, feature LIMIT 2",
    "source_breakdown": f"WITH {LI} SELECT source_type, count(*) AS n, sum(cited)::BIGINT AS n_cited, (count(*) - sum(cited))::BIGINT AS n_non_cited, round(sum(cited) / count(*), 4) AS cite_rate FROM li GROUP BY 1",
    "official_compare": f"WITH {FR}, g AS (SELECT 'institutional' AS grp, cited, institutional_official AS p FROM fr UNION ALL SELECT 'brand', cited, brand_official_candidate FROM fr UNION ALL SELECT 'other', cited, NOT institutional_official AND NOT brand_official_candidate FROM fr) SELECT grp, count_if(p) AS n, coalesce(sum(cited) FILTER (WHERE p), 0)::BIGINT AS n_cited, coalesce(round(sum(cited) FILTER (WHERE p) / nullif(count_if(p), 0), 4), 0.0) AS cite_rate FROM g GROUP BY grp",
    "top_domains": f"WITH {QD} SELECT domain, count(*) AS n FROM qd WHERE cited = 1 GROUP BY 1 ORDER BY n DESC, domain LIMIT 8",
    "audit_summary": f"WITH {FR} SELECT count(DISTINCT record_id) AS n_records, count(*) AS n_sources, sum(cited)::BIGINT AS n_cited, count_if(scrape_success) AS n_scraped, (count(*) - sum(cited))::BIGINT AS n_more_only, round(count_if(scrape_success) / count(*), 4) AS scrape_success_rate FROM fr",
    "correlation_with_cited": f"WITH {FR}, k AS (SELECT *, 1 AS constant FROM fr) SELECT feature, {_CORR('value', 'cited')} AS corr, count(*) AS n FROM ({_long('k', [*FR_FEATURES, 'constant'], 'cited')}) GROUP BY feature",
    "length_sim_corr": f"WITH {FR} SELECT {_CORR('word_count', 'digit_count')} AS corr, count(*) AS n FROM fr",
    "mann_whitney_u": f"WITH {FR}, l AS ({_long('fr', FR_FEATURES, 'cited')}), c AS (SELECT feature, value, count(*)::BIGINT AS ties, sum(cited)::BIGINT AS tc FROM l GROUP BY 1, 2), r AS (SELECT *, sum(ties) OVER (PARTITION BY feature ORDER BY value)::DOUBLE - (ties - 1) / 2.0::DOUBLE AS rank FROM c), s AS (SELECT feature, sum(tc)::BIGINT AS n1, sum(ties - tc)::BIGINT AS n2, sum(rank * tc)::DOUBLE AS r1, sum(ties::DOUBLE * ties * ties - ties)::DOUBLE AS tie_term FROM r GROUP BY 1) SELECT feature, n1, n2, CASE WHEN n1 >= 3 AND n2 >= 3 THEN least(r1 - n1 * (n1 + 1) / 2.0::DOUBLE, n1::DOUBLE * n2 - (r1 - n1 * (n1 + 1) / 2.0::DOUBLE)) END AS u, tie_term FROM s",
    "average_ranks": f"WITH {FR}, c AS (SELECT word_count::DOUBLE AS value, count(*) AS ties FROM fr GROUP BY 1) SELECT value, ties, sum(ties) OVER (ORDER BY value)::DOUBLE - (ties - 1) / 2.0::DOUBLE AS rank FROM c",
    "question_table": f"WITH {QD}, t AS (SELECT qid, domain, count(*) AS n, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, domain) AS rank FROM qd WHERE cited = 1 GROUP BY 1, 2), u AS (SELECT qid, string_agg(domain, ', ' ORDER BY rank) AS top_domains FROM t WHERE rank <= 5 GROUP BY 1) SELECT qd.qid, count_if(cited = 1) AS n_cited, count_if(cited = 0) AS n_more, count(*) AS n_total, round(count_if(cited = 1) / count(*), 4) AS cite_rate, coalesce(any_value(top_domains), '') AS top_domains FROM qd LEFT JOIN u ON qd.qid = u.qid GROUP BY qd.qid",
    "question_top_domains": f"WITH {QD} SELECT * FROM ({_TOP3}) WHERE rank <= 3",
    "jaccard_pairs": f"WITH {QD}, s AS (SELECT DISTINCT qid, domain FROM qd), z AS (SELECT qid, count(*) AS n FROM s GROUP BY 1) SELECT x.qid AS a, y.qid AS b, count(*) AS shared, round(count(*) / (any_value(za.n) + any_value(zb.n) - count(*)), 4) AS jaccard FROM s x JOIN s y ON x.domain = y.domain AND x.qid < y.qid JOIN z za ON za.qid = x.qid JOIN z zb ON zb.qid = y.qid GROUP BY 1, 2",
    "question_matrix": f"WITH {QD}, t AS (SELECT domain FROM qd GROUP BY 1 ORDER BY count(*) DESC, domain LIMIT 20), q AS (SELECT DISTINCT qid FROM qd) SELECT q.qid, t.domain, count(qd.qid) AS n FROM q CROSS JOIN t LEFT JOIN qd ON qd.qid = q.qid AND qd.domain = t.domain GROUP BY 1, 2",
    "intent_source_long": f"WITH {FR} SELECT intent, source_type, {_GRP} AS grp, count(*) AS n FROM fr GROUP BY ALL",
    "intent_source_pivot": f"WITH {FR} SELECT intent, source_type, count_if(cited = 1) AS cited, count_if(cited <> 1) AS more_only, round(count_if(cited = 1) / count(*), 4) AS cite_rate FROM fr GROUP BY 1, 2",
    "intent_row_pct": f"WITH {FR}, g AS (SELECT intent, source_type, count(*) AS n FROM fr GROUP BY 1, 2) SELECT *, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY intent), 4) AS pct FROM g",
    "intent_summary": f"WITH {FR}, t AS (SELECT intent, source_type FROM fr WHERE cited = 1 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY intent ORDER BY count(*) DESC, source_type) = 1) SELECT fr.intent, count(*) AS n_sources, count_if(cited = 1) AS n_cited, round(count_if(cited = 1) / count(*), 4) AS cite_rate, {_PCT('(institutional_official OR brand_official_candidate)')} AS official_cited_pct, {', '.join(_PCT(f'fr.source_type = {t!r}') + f' AS {t}_cited_pct' for t in ('review', 'ecommerce', 'forum'))}, any_value(t.source_type) AS top_cited_type FROM fr LEFT JOIN t ON fr.intent = t.intent GROUP BY fr.intent",
    "expected_vs_actual": f"WITH {FR}, g AS (SELECT record_id, arg_min(intent, ord) AS intent, 'prompt ' || min(ord) AS prompt, list_distinct(flatten(list({_TAGS}) FILTER (WHERE cited = 1))) AS tags, list_sort(list_distinct(list(source_type) FILTER (WHERE cited = 1))) AS kinds FROM fr GROUP BY 1), e AS (SELECT *, [{{'t': 'src1', 'c': 'src1'}}, {{'t': 'src2', 'c': 'src2'}}, {{'t': 'official', 'c': 'official'}}, {{'t': 'brand', 'c': 'official_brand'}}] AS x FROM g), f AS (SELECT *, list_filter(x, lambda y: list_contains(coalesce(tags, []), y.c)) AS hit, list_filter(x, lambda y: NOT list_contains(coalesce(tags, []), y.c)) AS miss, list_filter(coalesce(kinds, []), lambda k: k NOT IN ('src1', 'src2', 'official', 'official_brand')) AS other FROM e) SELECT record_id, intent, prompt, 'src1; src2; official; brand' AS expected, array_to_string(list_transform(hit, lambda y: y.t), '; ') AS cited_found, array_to_string(list_transform(miss, lambda y: y.t), '; ') AS expected_missing, array_to_string(other[1:6], '; ') AS unexpected_cited, round(len(hit) / 4, 4) AS coverage FROM f",
    "batch_aggregate": f"WITH {FR}, l AS ({_long('fr', FR_FEATURES, 'cited, topic, intent')}) {_LEVEL('overall', repr('(all)'))} UNION ALL {_LEVEL('topic', 'topic')} UNION ALL {_LEVEL('intent', 'intent')}",
    "sample_sizes": f"WITH {FR} SELECT count(DISTINCT run_id) AS n_runs, count(*) AS n_candidates, sum(cited)::BIGINT AS n_cited, count_if(scrape_success) AS n_scraped FROM fr",
    "heatmap_minmax": f"WITH {FR}, t AS (SELECT ord, n_chars, word_count FROM fr ORDER BY cited DESC, ord LIMIT 24) SELECT ord, {_NORM('n_chars')}, {_NORM('word_count')} FROM t",
    "box_statistics": f"WITH {LI} SELECT source_type, count(*) AS n, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q1, median(l_quantity) AS mid, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS high FROM li GROUP BY 1",
}
