"""Whole audits over the test tables: what their tables say, in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from citeweave.operators import batch, matching
from citeweave.plans import audit, queries_landed, queries_urls, queries_views
from citeweave.plans.bindings import AS_OF, CT, MD, PG, ct, md, pg
from citeweave.plans.queries_urls import MATCH, _recall, _segs, sql_amp, sql_norm, sql_root

ANSWER = queries_views.ANSWER


def _cells(name, df, key, values):
    """(tbl, name, item, value) of some columns of a table."""
    cells = F.array(*[F.struct(F.lit(v).alias("item"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(F.lit(name).alias("tbl"), key.cast("string").alias("name"), F.explode(cells).alias("x")).select("tbl", "name", "x.*")


def _all(*parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def _pages(spark, sf):
    return queries_views._pages(spark, sf).withColumn("canonical_url", F.lit(None).cast("string"))


def search_audit_tables(spark, sf):
    """One audit with all pages as results and all citations."""
    t = audit.search_audit("S", pg(spark, sf), ct(spark, sf), _pages(spark, sf), ANSWER, AS_OF, "a page").tables
    return _all(
        _cells("recall", t["recall"], F.concat_ws("@", "mode", F.col("k").cast("string")), ["recall"]), _cells("tiers", t["tiers"], F.col("match_type"), ["n", "rate"]),
        _cells("funnel", t["funnel"], F.lit("all"), ["n_candidates", "n_scraped", "n_cited", "n_weak"]),
        _cells("group_compare", t["group_compare"].where("feature IN ('serp_rank', 'char_count')"), F.col("feature"), ["cited_median", "non_cited_median", "n_cited", "n_non_cited"]))


def _export_pages(spark, sf):
    """A fetched page for most of the URLs that the bound export shows: the first page of each."""
    k = F.col("page_id")
    url = F.concat(F.lit("https://h"), k % 7, F.lit(".example.com/p"), k % 5)
    first = matching.first_rows(md(spark, sf).where("page_id % 35 < 30").withColumn("normalized_url", url), "normalized_url", "page_id")
    return first.select("normalized_url", "title", F.lit("success").alias("status"), F.col("md").alias("text"), F.col("md").alias("markdown"), F.lit(None).cast("string").alias("published_date"))


def export_audit_tables(spark, sf):
    """One audit of the bound export."""
    t = audit.export_audit("E", queries_landed._raw_sources(spark, sf), _export_pages(spark, sf), AS_OF).tables
    return _all(
        _cells("run", t["run"], F.lit("all"), ["n_records", "n_sources", "n_cited", "n_more_only"]), _cells("summary", t["summary"], F.lit("all"), ["n_records", "n_sources", "n_cited", "n_scraped", "n_more_only", "scrape_success_rate"]),
        _cells("questions", t["questions"], F.col("qid"), ["n_cited", "n_more", "cite_rate"]),
        _cells("group_compare", t["group_compare"].where("feature IN ('source_position', 'char_count')"), F.col("feature"), ["cited_median", "non_cited_median", "n_cited", "n_non_cited"]))


RUNS, BROKEN, EMPTY = 12, 3, 7


def _batch(spark, sf):
    """Pages and citations dealt over twelve runs; one has failed, and one has neither an answer nor citations."""
    run = lambda c: F.concat(F.lit("R"), (F.col(c) % RUNS).cast("string"))
    rows = pg(spark, sf)
    runs = rows.select((F.col("ord") % RUNS).alias("g")).distinct()
    runs = runs.select(
        F.concat(F.lit("R"), F.col("g").cast("string")).alias("run_id"), F.lit("a page").alias("prompt"), F.when(F.col("g") == EMPTY, "").otherwise(F.concat(F.lit(ANSWER + " "), F.col("g").cast("string"))).alias("output_text"),
        F.concat(F.lit("T"), (F.col("g") % 3).cast("string")).alias("topic"), F.when(F.col("g") % 2 == 0, "how").alias("intent"), F.when(F.col("g") == BROKEN, "TimeoutError: no answer").alias("error"))
    cited = ct(spark, sf).where(F.col("idx") % RUNS != EMPTY).withColumn("run_id", run("idx"))
    return audit.batch_search_audit("B", runs, rows.withColumn("run_id", run("ord")), cited, _pages(spark, sf), AS_OF).tables


def batch_runs(spark, sf):
    """Twelve runs, two of them broken: one row each."""
    return _batch(spark, sf)["runs"]


def batch_rollups(spark, sf):
    t = _batch(spark, sf)
    return _all(
        _cells("recall", t["recall"], F.concat_ws("@", "mode", F.col("k").cast("string")), ["recall"]), _cells("sample", t["sample"], F.lit("all"), ["n_runs", "n_candidates", "n_cited", "n_scraped"]),
        _cells("aggregate", t["aggregate"].where("feature IN ('serp_rank', 'char_count')"), F.concat_ws("/", "level", "name", "feature"), ["cited_median", "non_cited_median", "n_cited", "n_non_cited"]))


QUERIES = {f.__name__: f for f in (search_audit_tables, export_audit_tables, batch_runs, batch_rollups)}


def _long(name, key, values, of):
    """The SQL of ``_cells``."""
    return f"SELECT '{name}' AS tbl, {key} AS name, unnest([{', '.join(repr(v) for v in values)}]) AS item, unnest([{', '.join(f'{v}::DOUBLE' for v in values)}]) AS value FROM ({of})"


def _stats(rows, features, by="", group=""):
    one = lambda f: f"SELECT {by}'{f}' AS feature, " + ", ".join(f"round(median({f}::DOUBLE) FILTER (WHERE cited = {v}), 4) AS {n}_median, count({f}) FILTER (WHERE cited = {v}) AS n_{n}" for v, n in ((1, "cited"), (0, "non_cited"))) + f" FROM {rows} {group}"
    return " UNION ALL ".join(one(f) for f in features)


_STATS = ["cited_median", "non_cited_median", "n_cited", "n_non_cited"]
_FETCHED = f"pp AS (SELECT *, {sql_norm('url')} AS nurl FROM md QUALIFY row_number() OVER (PARTITION BY {sql_norm('url')} ORDER BY page_id) = 1), ok AS (SELECT nurl, length(md) AS chars FROM pp WHERE page_id % 6 <> 0)"
_SEARCH = f"""{MATCH}, {MD}, {_FETCHED}, g AS (SELECT matched_candidate_id AS candidate_id, max(strong::INTEGER) AS cited, bool_or(weak_domain_match) AS w FROM m WHERE matched_candidate_id IS NOT NULL GROUP BY 1),
r AS (SELECT c.*, best_rank AS serp_rank, coalesce(g.cited, 0) AS cited, coalesce(w, false) AS w, ok.nurl IS NOT NULL AS fetched, CASE WHEN chars > 0 THEN chars END AS char_count FROM c LEFT JOIN g ON c.candidate_id = g.candidate_id LEFT JOIN ok ON normalized_url = nurl)"""
_EXPORT = f"""{queries_landed._SRC}, {MD}, ok AS (SELECT 'https://h' || (page_id % 7) || '.example.com/p' || (page_id % 5) AS nurl, length(arg_min(md, page_id)) AS chars FROM md WHERE page_id % 35 < 30 GROUP BY 1),
r AS (SELECT src.*, cited_label AS cited, ok.nurl IS NOT NULL AS fetched, CASE WHEN chars > 0 THEN chars END AS char_count FROM src LEFT JOIN ok ON normalized_url = nurl)"""

# The single run's steps with the run in every key.
_BATCH = f"""{PG}, {CT}, {MD}, {_FETCHED}, n0 AS (SELECT *, ord % {RUNS} AS g, {sql_norm("url")} AS normalized_url FROM pg WHERE ord % {RUNS} NOT IN ({BROKEN}, {EMPTY})),
cand AS (SELECT g, normalized_url, arg_min(url, ord) AS url, min(rank) AS best_rank, min(ord) AS ord FROM n0 GROUP BY g, normalized_url),
ca AS (SELECT *, {sql_root("url")} AS root_domain, {sql_amp("normalized_url")} AS amp, {_segs("normalized_url")} AS seg FROM cand),
d0 AS (SELECT *, idx % {RUNS} AS g, {sql_norm("raw_uri")} AS cnorm, {sql_root("raw_uri")} AS croot FROM ct WHERE idx % {RUNS} NOT IN ({BROKEN}, {EMPTY})),
d AS (SELECT *, {sql_amp("cnorm")} AS camp, {_segs("cnorm")} AS cseg FROM d0 QUALIFY row_number() OVER (PARTITION BY g, cnorm ORDER BY idx) = 1),
weak AS (SELECT d.g, d.cnorm, normalized_url AS weak_id, best_rank AS weak_rank FROM d JOIN ca ON croot = root_domain AND d.g = ca.g
  QUALIFY row_number() OVER (PARTITION BY d.g, d.cnorm ORDER BY list_max(list_filter(range(0, least(len(cseg), len(seg)) + 1), lambda k: cseg[1:k] = seg[1:k])) DESC, best_rank, ord) = 1),
tiers AS (SELECT d.g, d.cnorm, 1 AS tier, normalized_url, best_rank, ord FROM d JOIN ca ON d.raw_uri = ca.url AND d.g = ca.g
  UNION ALL SELECT d.g, d.cnorm, 2, normalized_url, best_rank, ord FROM d JOIN ca ON d.cnorm = ca.normalized_url AND d.g = ca.g
  UNION ALL SELECT d.g, d.cnorm, 4, normalized_url, best_rank, ord FROM d JOIN ca ON d.camp = ca.amp AND d.g = ca.g),
strong AS (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY g, cnorm ORDER BY tier, best_rank, ord) = 1),
m AS (SELECT d.g, CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'normalized' WHEN 4 THEN 'amp_canonical' ELSE CASE WHEN weak_id IS NULL THEN 'no_match' ELSE 'domain_only' END END AS match_type,
  tier IS NOT NULL AS strong, coalesce(normalized_url, weak_id) AS matched, best_rank AS strong_rank, weak_rank FROM d LEFT JOIN strong USING (g, cnorm) LEFT JOIN weak USING (g, cnorm)),
hit AS (SELECT g, matched, max(strong::INTEGER) AS cited FROM m WHERE matched IS NOT NULL GROUP BY 1, 2),
r AS (SELECT ca.g, 'T' || (ca.g % 3) AS topic, CASE WHEN ca.g % 2 = 0 THEN 'how' ELSE 'Custom' END AS intent, best_rank AS serp_rank, coalesce(cited, 0) AS cited, ok.nurl IS NOT NULL AS fetched, CASE WHEN chars > 0 THEN chars END AS char_count
  FROM ca LEFT JOIN hit ON ca.g = hit.g AND matched = normalized_url LEFT JOIN ok ON normalized_url = nurl),
rec AS ({_recall("g, ")})"""
ORACLE = {
    "search_audit_tables": f"WITH {_SEARCH} " + " UNION ALL ".join((
        _long("recall", "mode || '@' || k", ["recall"], queries_urls.ORACLE["citation_recall_at_k"]), _long("tiers", "match_type", ["n", "rate"], queries_views.ORACLE["tier_table"]),
        _long("funnel", "'all'", ["n_candidates", "n_scraped", "n_cited", "n_weak"], "SELECT count(*) AS n_candidates, count_if(fetched) AS n_scraped, count_if(cited = 1) AS n_cited, count_if(w) AS n_weak FROM r"),
        _long("group_compare", "feature", _STATS, _stats("r", ["serp_rank", "char_count"])))),
    "export_audit_tables": f"WITH {_EXPORT} " + " UNION ALL ".join((
        _long("run", "'all'", ["n_records", "n_sources", "n_cited", "n_more_only"], "SELECT (SELECT count(DISTINCT rec) FROM it) AS n_records, count(*) AS n_sources, count_if(cited = 1) AS n_cited, count_if(cited = 0) AS n_more_only FROM r"),
        _long("summary", "'all'", ["n_records", "n_sources", "n_cited", "n_scraped", "n_more_only", "scrape_success_rate"], "SELECT count(DISTINCT record_id) AS n_records, count(*) AS n_sources, count_if(cited = 1) AS n_cited, count_if(fetched) AS n_scraped, count_if(cited = 0) AS n_more_only, round(count_if(fetched) / count(*), 4) AS scrape_success_rate FROM r"),
        _long("questions", "record_id", ["n_cited", "n_more", "cite_rate"], "SELECT record_id, count_if(cited = 1) AS n_cited, count_if(cited = 0) AS n_more, round(count_if(cited = 1) / count(*), 4) AS cite_rate FROM r GROUP BY 1"),
        _long("group_compare", "feature", _STATS, _stats("r", ["source_position", "char_count"])))),
    "batch_runs": f"""WITH {_BATCH}, run AS (SELECT DISTINCT ord % {RUNS} AS g FROM pg), n AS (SELECT g, count(*) AS n, count_if(fetched) AS f FROM r GROUP BY 1), c AS (SELECT g, count(*) AS n FROM m GROUP BY 1)
SELECT 'R' || run.g AS run_id, 'a page' AS prompt, 'T' || (run.g % 3) AS topic, CASE WHEN run.g % 2 = 0 THEN 'how' ELSE 'Custom' END AS intent,
  CASE run.g WHEN {BROKEN} THEN 'TimeoutError: no answer' WHEN {EMPTY} THEN '{batch.NO_ANSWER}' END AS error, n.n AS n_candidates, c.n AS n_citations, n.f AS n_scraped, recall AS recall_strict_10
FROM run LEFT JOIN n USING (g) LEFT JOIN c USING (g) LEFT JOIN (SELECT * FROM rec WHERE mode = 'strict' AND k = 10) USING (g)""",
    "batch_rollups": f"WITH {_BATCH} " + " UNION ALL ".join((
        _long("recall", "mode || '@' || k", ["recall"], "SELECT mode, k, round(avg(round(recall * 10000))) / 10000 AS recall FROM rec GROUP BY mode, k"),
        _long("sample", "'all'", ["n_runs", "n_candidates", "n_cited", "n_scraped"], "SELECT count(DISTINCT g) AS n_runs, count(*) AS n_candidates, sum(cited) AS n_cited, count_if(fetched) AS n_scraped FROM r"),
        *[_long("aggregate", f"'{level}/' || name || '/' || feature", _STATS, _stats(f"(SELECT *, {name} AS name FROM r)", ["serp_rank", "char_count"], "name, ", "GROUP BY name")) for level, name in (("overall", "'(all)'"), ("topic", "topic"), ("intent", "intent"))])),
}
