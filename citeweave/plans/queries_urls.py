"""URL functions, classification, candidates and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions import classify, suffixes, urls
from citeweave.operators import matching
from citeweave.plans.bindings import CT, PG, ct, pg

TRACK = "[" + ", ".join(f"'{t}'" for t in urls.TRACKING) + "]"


def sql_host(u: str) -> str:
    return f"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[^:]+://([^/?#]*)', 1)), ':[0-9]*$', ''), '^www\\.', '')"


def sql_path(u: str) -> str:
    return f"regexp_extract({u}, '^[^:]+://[^/?#]*([^?#]*)', 1)"


def sql_query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def sql_norm(u: str) -> str:
    kept = f"array_to_string(list_sort(list_filter(string_split({sql_query(u)}, '&'), lambda p: regexp_matches(p, '^[^=]*=.+$') AND NOT list_contains({TRACK}, lower(split_part(p, '=', 1))))), '&')"
    path = f"CASE WHEN length({sql_path(u)}) > 1 THEN rtrim({sql_path(u)}, '/') ELSE {sql_path(u)} END"
    return f"('https://' || {sql_host(u)} || {path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END)"


def sql_root(u: str) -> str:
    return f"array_to_string(string_split({sql_host(u)}, '.')[-2:], '.')"


def sql_amp(n: str) -> str:
    """Of a normal form."""
    p = f"regexp_replace(regexp_replace(regexp_replace({sql_path(n)}, '/amp/?$', ''), '\\.amp(\\.html?)?$', '\\1'), '^/amp/', '/')"
    return f"('https://' || regexp_replace(regexp_extract({n}, '^https://([^/?#]*)', 1), '^amp\\.', '') || {p} || CASE WHEN {sql_query(n)} = '' THEN '' ELSE '?' || {sql_query(n)} END)"


def _urls(spark, sf):
    return pg(spark, sf).select(F.col("ord").alias("page_id"), "url")


def url_normalize(spark, sf):
    return _urls(spark, sf).select("page_id", urls.normalize_url(F.col("url")).alias("normalized_url"))


def url_domain(spark, sf):
    return _urls(spark, sf).select("page_id", urls.domain(F.col("url")).alias("domain"))


def url_root_domain(spark, sf):
    return _urls(spark, sf).select("page_id", urls.root_domain(F.col("url")).alias("root_domain"))


def url_strip_amp(spark, sf):
    return ct(spark, sf).select("idx", urls.strip_amp(F.col("raw_uri")).alias("canonical"))


def url_short_id(spark, sf):
    return _urls(spark, sf).select("page_id", urls.short_id(F.col("url")).alias("short_id"))


def url_pretty(spark, sf):
    return _urls(spark, sf).select("page_id", urls.pretty_url(F.col("url"), 24).alias("pretty"))


def url_redirect_flag(spark, sf):
    wrapped = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("https://WWW.google.com/url?q="), F.col("raw_uri"))).otherwise(F.col("raw_uri"))
    return ct(spark, sf).select("idx", urls.is_redirect_wrapper(wrapped).alias("is_wrapper"))


def source_classify(spark, sf):
    u = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "example", "wikipedia")).otherwise(F.col("url"))
    return _urls(spark, sf).select("page_id", classify.source_type(u).alias("source_type"), classify.institutional(u).alias("institutional"))


def brand_candidate(spark, sf):
    return pg(spark, sf).select(F.col("ord").alias("page_id"), classify.brand_candidate(F.col("url"), F.concat(F.lit("The Example of "), "title"), F.col("query"), F.lit("")).alias("brand"))


#: Rules of every kind, among hosts that the pages have.
RULES = ("com", "net", "org", "*.example.net", "!blog.example.net", "example.org")


def registrable_domains(spark, sf):
    """By rules with a free label and an exception; half of the hosts with a label more."""
    host = F.when(F.col("page_id") % 2 == 0, urls.domain(F.col("url"))).otherwise(F.concat(F.lit("sub."), urls.domain(F.col("url"))))
    rows = _urls(spark, sf).select("page_id", host.alias("host"))
    return suffixes.with_registrable(rows, "host", "root_domain", suffixes.suffix_rules(spark, list(RULES)))


def _candidates(spark, sf):
    return matching.unique_candidates(pg(spark, sf))


def unique_candidates(spark, sf):
    return _candidates(spark, sf).select("candidate_id", "normalized_url", "url", "domain", "root_domain", "title", "snippet", "best_rank", F.size("queries").cast("long").alias("n_queries"), matching.best_query(F.col("queries"), F.lit("")).alias("best_query"))


def candidate_top_k(spark, sf):
    return matching.select_scrape_urls(_candidates(spark, sf), "top_k", 12).select("candidate_id", "best_rank", "normalized_url")


def _matches(spark, sf):
    return matching.match_citations(ct(spark, sf), _candidates(spark, sf))


def citation_match_tiers(spark, sf):
    return _matches(spark, sf).select("citation_index", "match_type", "strong", "weak_domain_match", "matched_candidate_id", "matched_rank", "strong_rank", "weak_rank")


def citation_tier_counts(spark, sf):
    return matching.tier_counts(_matches(spark, sf))


def citation_recall_at_k(spark, sf):
    return matching.recall_at_k(_matches(spark, sf))


def unmatched_citations(spark, sf):
    return matching.unmatched(_matches(spark, sf))


def closest_path_match(spark, sf):
    cits = matching.distinct_citations(ct(spark, sf))
    return matching.closest_path(cits, _candidates(spark, sf)).select("cnorm", "weak_id", "weak_rank")


def serp_cited_flag(spark, sf):
    c = _candidates(spark, sf)
    return matching.cited_flags(c, _matches(spark, sf)).select("candidate_id", "cited", "weak_domain_match", "match_type", "strong_match")


def scrape_cache_antijoin(spark, sf):
    c = _candidates(spark, sf).select("url", "normalized_url")
    cache = ct(spark, sf).where("idx % 7 < 4").select(urls.normalize_url(F.col("raw_uri")).alias("normalized_url"), F.lit("success").alias("status")).distinct()
    hits, todo = matching.scrape_plan(c, cache)
    return hits.select("normalized_url", F.lit("hit").alias("plan")).unionByName(todo.select("normalized_url", F.lit("fetch").alias("plan")))


def recall_avg(spark, sf):
    from citeweave.operators.batch import recall_average

    m = _matches(spark, sf).withColumn("run_id", F.col("citation_index") % 4)
    return recall_average(matching.recall_at_k(m, ["run_id"]))


def sankey_edges(spark, sf):
    """Edges query to domain of the best-ranked candidates."""
    c = _candidates(spark, sf).withColumn("query", matching.best_query(F.col("queries"), F.lit("")))
    return c.orderBy("best_rank", "ord").limit(16).groupBy("query", "domain").agg(F.count("*").alias("n"))


_NAMES = (
    "url_normalize url_domain url_root_domain registrable_domains url_strip_amp url_short_id url_pretty url_redirect_flag source_classify brand_candidate unique_candidates candidate_top_k "
    "citation_match_tiers citation_tier_counts citation_recall_at_k unmatched_citations closest_path_match serp_cited_flag scrape_cache_antijoin recall_avg sankey_edges"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

CANDS = f"""{PG}, n0 AS (SELECT *, {sql_norm("url")} AS normalized_url FROM pg),
n1 AS (SELECT *, coalesce(rank < min(rank) OVER (PARTITION BY normalized_url ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS record FROM n0),
cand AS (SELECT substring(sha1(normalized_url), 1, 12) AS candidate_id, normalized_url, arg_min(url, ord) AS url, min(rank) AS best_rank, min(ord) AS ord,
  coalesce(arg_max(title, ord) FILTER (WHERE record AND title <> ''), '') AS title, coalesce(arg_max(snippet, ord) FILTER (WHERE record AND snippet <> ''), '') AS snippet,
  count(*) AS n_queries, arg_min(query, rank::BIGINT * 1000000000 + ord) AS best_query FROM n1 GROUP BY normalized_url),
c AS (SELECT *, {sql_host("url")} AS domain, {sql_root("url")} AS root_domain FROM cand)"""
_segs = lambda n: f"CASE WHEN trim({sql_path(n)}, '/') = '' THEN [] ELSE string_split(trim({sql_path(n)}, '/'), '/') END"
MATCH = f"""{CANDS}, {CT},
d0 AS (SELECT *, {sql_norm("raw_uri")} AS cnorm, {sql_root("raw_uri")} AS croot FROM ct),
d AS (SELECT *, {sql_amp("cnorm")} AS camp, {_segs("cnorm")} AS cseg FROM d0 QUALIFY row_number() OVER (PARTITION BY cnorm ORDER BY idx) = 1),
ca AS (SELECT *, {sql_amp("normalized_url")} AS amp, {_segs("normalized_url")} AS seg FROM c),
weak AS (SELECT d.cnorm, candidate_id AS weak_id, best_rank AS weak_rank FROM d JOIN ca ON croot = root_domain
  QUALIFY row_number() OVER (PARTITION BY d.cnorm ORDER BY list_max(list_filter(range(0, least(len(cseg), len(seg)) + 1), lambda k: cseg[1:k] = seg[1:k])) DESC, best_rank, ord) = 1),
tiers AS (SELECT d.cnorm, 1 AS tier, candidate_id, best_rank, ord FROM d JOIN ca ON d.raw_uri = ca.url
  UNION ALL SELECT d.cnorm, 2, candidate_id, best_rank, ord FROM d JOIN ca ON d.cnorm = ca.normalized_url
  UNION ALL SELECT d.cnorm, 4, candidate_id, best_rank, ord FROM d JOIN ca ON d.camp = ca.amp),
strong AS (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY cnorm ORDER BY tier, best_rank, ord) = 1),
m AS (SELECT idx AS citation_index, raw_uri AS citation_url,
  CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'normalized' WHEN 4 THEN 'amp_canonical' ELSE CASE WHEN weak_id IS NULL THEN 'no_match' ELSE 'domain_only' END END AS match_type,
  tier IS NOT NULL AS strong, tier IS NULL AND weak_id IS NOT NULL AS weak_domain_match, coalesce(candidate_id, weak_id) AS matched_candidate_id,
  coalesce(best_rank, weak_rank) AS matched_rank, best_rank AS strong_rank, weak_rank FROM d LEFT JOIN strong USING (cnorm) LEFT JOIN weak USING (cnorm))"""
_strict, _strong = "('exact', 'normalized', 'final_redirect')", "('exact', 'normalized', 'final_redirect', 'canonical', 'amp_canonical')"


def _recall(by: str) -> str:
    one = lambda mode, k, p: f"SELECT {by}'{mode}' AS mode, {k} AS k, coalesce(round(count_if({p}) / count(*), 4), 0.0) AS recall, count(*) AS n FROM m GROUP BY ALL"
    parts = []
    for k in matching.RECALL_KS:
        parts += [one("strict", k, f"match_type IN {_strict} AND strong_rank <= {k}"), one("canonical", k, f"match_type IN {_strong} AND strong_rank <= {k}"),
                  one("domain_inclusive", k, f"(match_type IN {_strong} AND strong_rank <= {k}) OR (match_type = 'domain_only' AND weak_rank <= {k})")]
    return " UNION ALL ".join(parts)


_kind = "CASE " + " ".join(f"WHEN {p} THEN '{t}'" for t, p in (
    ("reference", "h LIKE '%.wikipedia.org' OR h = 'wikipedia.org'"), ("documentation", "h LIKE 'docs.%' OR h LIKE 'developer.%' OR h LIKE 'dev.%'"), ("blog", "h LIKE 'blog.%' OR h LIKE '%.blog%'"),
    ("forum", "h LIKE 'community.%' OR h LIKE '%forum%'"), ("ecommerce", "h LIKE 'store.%' OR h LIKE '%shop%'"), ("news", "h LIKE '%news%'"), ("reference", "h LIKE '%wiki%'"))) + " ELSE 'unknown' END"
ORACLE = {
    "url_normalize": f"SELECT page_id, {sql_norm('url')} AS normalized_url FROM pages",
    "url_domain": f"SELECT page_id, {sql_host('url')} AS domain FROM pages",
    "url_root_domain": f"SELECT page_id, {sql_root('url')} AS root_domain FROM pages",
    "registrable_domains": f"""WITH h AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'sub.' END || {sql_host('url')} AS host FROM pages), l AS (SELECT *, string_split(host, '.') AS l FROM h),
n AS (SELECT *, CASE WHEN host = 'blog.example.net' OR host LIKE '%.blog.example.net' THEN 2 WHEN host LIKE '%_.example.net' THEN 3 WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 2 ELSE 1 END AS s FROM l)
SELECT page_id, host, CASE WHEN len(l) > s THEN array_to_string(l[len(l) - s :], '.') ELSE host END AS root_domain FROM n""",
    "url_strip_amp": f"WITH {CT}, x AS (SELECT idx, {sql_norm('raw_uri')} AS n FROM ct) SELECT idx, {sql_amp('n')} AS canonical FROM x",
    "url_short_id": "SELECT page_id, substring(sha1(url), 1, 12) AS short_id FROM pages",
    "url_pretty": f"WITH x AS (SELECT page_id, {sql_host('url')} || {sql_path('url')} AS t FROM pages) SELECT page_id, CASE WHEN length(t) <= 24 THEN t ELSE substring(t, 1, 23) || '…' END AS pretty FROM x",
    "url_redirect_flag": f"WITH {CT} SELECT idx, idx % 2 = 0 AS is_wrapper FROM ct",
    "source_classify": f"WITH x AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(url, 'example', 'wikipedia') ELSE url END AS u FROM pages), y AS (SELECT page_id, {sql_host('u')} AS h FROM x) SELECT page_id, {_kind} AS source_type, false AS institutional FROM y",
    "brand_candidate": f"SELECT page_id, {_kind} NOT IN ('news', 'forum', 'reference', 'video', 'social', 'review', 'documentation') AS brand FROM (SELECT page_id, {sql_host('url')} AS h FROM pages)",
    "unique_candidates": f"WITH {CANDS} SELECT candidate_id, normalized_url, url, domain, root_domain, title, snippet, best_rank, n_queries, best_query FROM c",
    "candidate_top_k": f"WITH {CANDS} SELECT candidate_id, best_rank, normalized_url FROM c ORDER BY best_rank, ord LIMIT 12",
    "citation_match_tiers": f"WITH {MATCH} SELECT citation_index, match_type, strong, weak_domain_match, matched_candidate_id, matched_rank, strong_rank, weak_rank FROM m",
    "citation_tier_counts": f"WITH {MATCH}, t AS (SELECT unnest([{', '.join(repr(t) for t in matching.TIERS)}]) AS match_type) SELECT t.match_type, count(m.match_type) AS n, round(count(m.match_type) / (SELECT count(*) FROM m), 4) AS rate FROM t LEFT JOIN m ON t.match_type = m.match_type GROUP BY t.match_type",
    "citation_recall_at_k": f"WITH {MATCH} SELECT mode, k, recall FROM ({_recall('')})",
    "recall_avg": f"WITH {MATCH} SELECT mode, k, round(avg(round(recall * 10000))) / 10000 AS recall FROM ({_recall('citation_index % 4 AS run_id, ')}) GROUP BY mode, k",
    "unmatched_citations": f"WITH {MATCH} SELECT citation_index, citation_url FROM m WHERE match_type = 'no_match'",
    "closest_path_match": f"WITH {MATCH} SELECT cnorm, weak_id, weak_rank FROM weak",
    "serp_cited_flag": f"WITH {MATCH}, g AS (SELECT matched_candidate_id AS candidate_id, max(strong::INTEGER) AS cited, bool_or(weak_domain_match) AS w, arg_min(match_type, (NOT strong)::BIGINT * 1000000000 + citation_index) AS t FROM m WHERE matched_candidate_id IS NOT NULL GROUP BY 1) SELECT c.candidate_id, coalesce(cited, 0) AS cited, coalesce(w, false) AS weak_domain_match, coalesce(t, 'no_match') AS match_type, coalesce(cited, 0) = 1 AS strong_match FROM c LEFT JOIN g ON c.candidate_id = g.candidate_id",
    "scrape_cache_antijoin": f"WITH {MATCH}, k AS (SELECT DISTINCT {sql_norm('raw_uri')} AS u FROM ct WHERE idx % 7 < 4) SELECT normalized_url, CASE WHEN u IS NULL THEN 'fetch' ELSE 'hit' END AS plan FROM c LEFT JOIN k ON normalized_url = u",
    "sankey_edges": f"WITH {CANDS}, t AS (SELECT best_query AS query, domain FROM c ORDER BY best_rank, ord LIMIT 16) SELECT query, domain, count(*) AS n FROM t GROUP BY ALL",
}
