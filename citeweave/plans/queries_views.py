"""What views and reports are made of: funnels, profiles, flows, sentences, formats, and the feature rows beneath them."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions import classify, similarity, text, urls
from citeweave.operators import batch, chunking, compare, features, matching, profile, questions
from citeweave.plans import audit, report
from citeweave.plans.bindings import AS_OF, CLIENT, COMPETITOR, FR, FR_FEATURES, MD, QD, _found_sql, fr, md, pg, qd, read
from citeweave.stages import scratch_keep
from citeweave.plans.queries_stats import _compare
from citeweave.plans.queries_text import _FLAG_SQL, _HEAD, _LINES, _TOKENS, _path
from citeweave.plans.queries_text import ORACLE as TEXT_SQL
from citeweave.plans.queries_urls import CANDS, MATCH, _candidates, _matches, sql_host, sql_norm

ANSWER = "the answer names systems of data and time in every part of the page"
#: The features that a view of a run reads, from columns of the bound table.
_AS_RUN = {"serp_rank": "source_position", "page_query_sim": "n_chars / 20000.0D", "page_output_sim": "digit_count / (digit_count + 100.0D)", "domain": "concat(source_type, '-', ord)"}


def _run_rows(spark, sf):
    return fr(spark, sf).withColumns({k: F.expr(v) for k, v in _AS_RUN.items()})


_RUN = f"{FR}, run AS (SELECT *, " + ", ".join(f"{v.replace('0D', '0::DOUBLE')} AS {k}" for k, v in _AS_RUN.items()) + " FROM fr)"
_RUN_FEATURES = ["serp_rank", "page_query_sim", "page_output_sim"]


def phase_compare(spark, sf):
    return audit.analysis(_run_rows(spark, sf), _RUN_FEATURES, "page_output_sim")["group_compare"]


def insights(spark, sf):
    rows = _run_rows(spark, sf)
    return profile.insights(compare.group_compare(rows, _RUN_FEATURES), compare.official_compare(rows), rows)


def cite_patterns(spark, sf):
    rows = fr(spark, sf)
    return batch.cite_patterns(rows, batch.batch_aggregate(rows, FR_FEATURES), compare.correlation_with_cited(rows, FR_FEATURES))


def average_profile(spark, sf):
    return profile.average_profile(fr(spark, sf), FR_FEATURES)


def display_order(spark, sf):
    rows = fr(spark, sf).withColumn("best_rank", F.col("n_chars") % 40)
    return profile.display_order(rows, 25).select("ord", "scrape_success", "best_rank")


def best_chunk(spark, sf):
    rows = fr(spark, sf).select("record_id", F.col("ord").alias("idx"), F.col("intent").alias("heading"), F.col("topic").alias("text"), F.col("line_count").alias("score"))
    return profile.best_chunk(rows, "record_id", "score")


def best_page_chunk(spark, sf):
    """Of each page the chunk that is most like the answer, out of all its chunks."""
    chunks = chunking.chunk_rows(md(spark, sf), "page_id", "md", most=None)
    scored = chunks.withColumn("score", similarity.lexical_cosines([(F.col("text"), F.lit(ANSWER))])[0])
    # Of a chunk's text the digest is wanted alone, so no text is shuffled or sorted.
    best = profile.best_chunk(scored.withColumn("text", F.substring(F.sha1("text"), 1, 12)), "page_id", "score")
    return best.select("page_id", "idx", "heading", "score", F.col("text").alias("digest"))


def fetch_split(spark, sf):
    status = F.when(F.col("page_id") % 6 == 0, "failed").otherwise("success")
    return profile.fetch_split(read(spark, sf, "pages").withColumn("status", status))


def long_form(spark, sf):
    return profile.long_form(compare.source_breakdown(fr(spark, sf)), ["source_type"], ["n", "n_cited", "cite_rate"])


def cluster_topics(spark, sf):
    rows = qd(spark, sf).withColumn("topic", F.concat(F.lit("T"), F.col("qid") % 5))
    clusters = rows.select("qid").distinct().withColumn("cluster", F.col("qid") % 3)
    return questions.cluster_topics(rows, clusters)


def pooled_runs(spark, sf):
    rows = fr(spark, sf)
    parts = [rows.where(f"run_id = {i}").select("run_id", "cited", *FR_FEATURES[: i + 1]) for i in range(3)]
    return batch.sample_sizes(batch.pool(parts).withColumn("scrape_success", F.col("digit_count").isNotNull()))


def compact_rows(spark, sf):
    return report.compact(fr(spark, sf), ["ord", "no_such_column", "source_type", "cited"])


def display_numbers(spark, sf):
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", text.number_text(F.col("o_totalprice")).alias("price"), text.number_text(F.col("o_orderkey") * 37, True).alias("n"), text.percent_text((F.col("o_orderkey") % 801) / 800.0).alias("share"))


def _flagged(spark, sf):
    c = _candidates(spark, sf)
    return matching.cited_flags(c, _matches(spark, sf)).withColumn("scrape_success", F.col("ord") % 7 != 0)


def funnel(spark, sf):
    return compare.funnel(_flagged(spark, sf))


def flow_edges(spark, sf):
    return profile.flow_edges(_flagged(spark, sf))


def tier_table(spark, sf):
    return matching.tier_table(_matches(spark, sf))


def _pages(spark, sf):
    """Pages as fetched ones, the first of each normalised URL."""
    p = md(spark, sf).withColumn("normalized_url", urls.normalize_url(F.col("url")))
    p = matching.first_rows(p.select("page_id", "normalized_url", "title", "md"), "normalized_url", "page_id")
    return p.select("page_id", "normalized_url", "title", F.when(F.col("page_id") % 6 == 0, "failed").otherwise("success").alias("status"), F.when(F.col("page_id") % 5 != 1, F.col("md")).alias("text"),
                    F.col("md").alias("markdown"), F.when(F.col("page_id") % 4 == 0, "2024-01-15").when(F.col("page_id") % 4 == 1, "some day").alias("published_date"))


def candidate_features(spark, sf):
    c = _candidates(spark, sf)
    flags = c.select("candidate_id", (F.col("ord") % 3 == 0).cast("int").alias("cited"), F.lit(False).alias("weak_domain_match"), F.lit("exact").alias("match_type"), F.lit(True).alias("strong_match"))
    keep = scratch_keep(spark)
    c = c.repartition(spark.sparkContext.defaultParallelism)  # narrow rows, to which the pages' texts come
    rows = features.candidate_features(c, keep("pages", _pages(spark, sf)), flags, ANSWER, AS_OF, keep=keep)[0]
    return rows.select("candidate_id", "cited", "scrape_success", F.col("word_count").cast("long").alias("word_count"), F.col("char_count").cast("long").alias("char_count"), F.col("heading_count").cast("long").alias("heading_count"), "freshness_days", "truncated", "title_query_sim", "page_query_sim", "page_output_sim")


def _sources(spark, sf, title="snippet"):
    p = pg(spark, sf)
    return p.select(F.col("ord").alias("source_id"), "url", urls.normalize_url(F.col("url")).alias("normalized_url"), urls.domain(F.col("url")).alias("domain"), F.col(title).alias("title"), F.lit("").alias("description"),
                    F.col("query").alias("web"), F.concat(F.col("query"), F.lit(" of the page")).alias("prompt"), F.lit(ANSWER).alias("answer_text"), F.lit("2024-02-01").alias("date_published"),
                    (F.col("ord") % 2).cast("int").alias("cited_label"), F.array(F.lit("web query")).alias("web_search_query"))


def source_features(spark, sf):
    keep = scratch_keep(spark)
    rows = features.source_features(_sources(spark, sf).repartition(spark.sparkContext.defaultParallelism), keep("pages", _pages(spark, sf)), AS_OF, keep=keep)[0]
    return rows.select("source_id", "cited", "scrape_success", F.col("word_count").cast("long").alias("word_count"), "freshness_days", "title_prompt_similarity", "page_prompt_similarity", "page_answer_similarity")


_PAGE_FLAGS = ["has_faq", "has_price_or_package", "has_contact_info", "has_many_headings"]


def brand_pages(spark, sf):
    rows = _sources(spark, sf, "title").withColumns({"intent": F.lit("general the"), "source_type": F.lit("unknown")})
    named = features.brand_pages(rows, _pages(spark, sf), CLIENT, COMPETITOR, keep=scratch_keep(spark))
    return named.select("source_id", "is_client_source", "is_competitor_source", *_PAGE_FLAGS, "page_type", "heading_prompt_match", "answer_like_text_in_first_500_chars")


_NAMES = (
    "phase_compare insights cite_patterns average_profile display_order best_chunk best_page_chunk fetch_split long_form cluster_topics pooled_runs compact_rows display_numbers funnel flow_edges tier_table "
    "candidate_features source_features brand_pages"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}


def _lex(pairs: str) -> str:
    """Steps that give lex (id, nm, sim) for the pairs (id, nm, a, b) that a query states."""
    return f"""p AS ({pairs}), t AS (SELECT id, nm, unnest({_TOKENS('a')}) AS t, 1 AS l FROM p UNION ALL SELECT id, nm, unnest({_TOKENS('b')}), 0 FROM p),
  tc AS (SELECT id, nm, t, count(*) FILTER (WHERE l = 1) AS ca, count(*) FILTER (WHERE l = 0) AS cb FROM t GROUP BY 1, 2, 3),
  tw AS (SELECT id, nm, CASE WHEN ca > 0 THEN 1 + ln(ca) ELSE 0 END AS wa, CASE WHEN cb > 0 THEN 1 + ln(cb) ELSE 0 END AS wb FROM tc),
  ts AS (SELECT id, nm, sum(wa * wb) / nullif(sqrt(sum(wa * wa)) * sqrt(sum(wb * wb)), 0) AS v FROM tw GROUP BY 1, 2),
  lex AS (SELECT p.id, p.nm, coalesce(round(v, 4), 0.0) AS sim FROM p LEFT JOIN ts ON p.id = ts.id AND p.nm = ts.nm)"""


_sim = lambda nm: f"max(sim) FILTER (WHERE nm = '{nm}')"
_PAGES = f"""pp AS (SELECT *, {sql_norm('url')} AS nurl FROM md QUALIFY row_number() OVER (PARTITION BY {sql_norm('url')} ORDER BY page_id) = 1),
ok AS (SELECT nurl, title AS p_title, md AS p_text, md AS p_md, page_id AS pid FROM pp WHERE page_id % 6 <> 0)"""
_WORDS = "len(regexp_extract_all(p_text, '[^\\s]+'))"
_HEADS = f"list_filter(list_transform(list_filter({_LINES.replace('md', 'p_md')}, lambda x: regexp_matches(x, {_HEAD})), lambda x: regexp_extract(x, {_HEAD}, 1)), lambda x: x <> '')"
_FRESH = lambda d: f"greatest(floor((epoch(TIMESTAMP '{AS_OF}') - epoch({d})) / 86400.0), 0)::DOUBLE"
_m = lambda f, v, fn: f"round({fn}({f}::DOUBLE) FILTER (WHERE cited = {v}), 4)"
_mean = lambda f, v: _m(f, v, "avg")
_med = lambda f, v: _m(f, v, "median")
_FLAGS_SQL = {f: _FLAG_SQL[f] for f in _PAGE_FLAGS}
_TYPE = "CASE " + " ".join(f"WHEN {_path(w)}{' OR ' + _FLAG_SQL[g] if g else ''} THEN '{t}'" for t, w, g in classify.PATH_TYPES) + f" WHEN {_FLAG_SQL['has_faq']} THEN 'faq_page' WHEN {_FLAG_SQL['has_booking_or_appointment']} THEN 'appointment_page' WHEN {_FLAG_SQL['has_author']} OR {_FLAG_SQL['has_published_date']} THEN 'article' ELSE 'unknown' END"
_OFFICIAL = """off AS (SELECT 'institutional' AS grp, count_if(institutional_official) AS n, coalesce(sum(cited) FILTER (WHERE institutional_official), 0) AS c FROM fr UNION ALL SELECT 'brand', count_if(brand_official_candidate), coalesce(sum(cited) FILTER (WHERE brand_official_candidate), 0) FROM fr
  UNION ALL SELECT 'other', count_if(NOT institutional_official AND NOT brand_official_candidate), coalesce(sum(cited) FILTER (WHERE NOT institutional_official AND NOT brand_official_candidate), 0) FROM fr), rate AS (SELECT *, coalesce(round(c / nullif(n, 0), 4), 0.0) AS r FROM off)"""
_FLAG_ROWS = f"""{MATCH}, g AS (SELECT matched_candidate_id AS candidate_id, max(strong::INTEGER) AS cited, bool_or(weak_domain_match) AS w FROM m WHERE matched_candidate_id IS NOT NULL GROUP BY 1),
fl AS (SELECT c.*, coalesce(g.cited, 0) AS cited, coalesce(w, false) AS w FROM c LEFT JOIN g ON c.candidate_id = g.candidate_id)"""
_CHUNKS = TEXT_SQL["chunk_segments"].partition("SELECT page_id, idx, heading, n_words")[0].rstrip()
_part = lambda n, t, rest: f"SELECT {n} AS part, {t} AS text FROM {rest}"
ORACLE = {
    "phase_compare": f"WITH {_RUN} SELECT *, CASE WHEN feature = 'page_output_sim' THEN 'post_output' ELSE 'pre_answer' END AS phase FROM ({_compare('run', _RUN_FEATURES)})",
    "insights": f"WITH {_RUN}, {_OFFICIAL} " + " UNION ALL ".join((
        _part(1, f"printf('[pre-answer] cited sites ranked %s (median %.1f against %.1f)', CASE WHEN {_med('serp_rank', 1)} < {_med('serp_rank', 0)} THEN 'higher' ELSE 'lower or alike' END, {_med('serp_rank', 1)}, {_med('serp_rank', 0)})", "run"),
        _part(2, f"printf('[pre-answer] cited pages were %s to the query (%.4f against %.4f)', CASE WHEN round(avg(page_query_sim) FILTER (WHERE cited = 1) - avg(page_query_sim) FILTER (WHERE cited = 0), 4) > 0 THEN 'more similar' ELSE 'no more similar' END, {_mean('page_query_sim', 1)}, {_mean('page_query_sim', 0)})", "run"),
        _part(3, "'[pre-answer] cite rates: ' || string_agg(printf('%s %.4f (n=%d)', grp, r::DOUBLE, n), ', ' ORDER BY grp)", "rate"),
        _part(4, f"printf('[post-output, circular] overlap of pages with the answer: %.4f cited, %.4f not cited', {_mean('page_output_sim', 1)}, {_mean('page_output_sim', 0)})", "run"),
        _part(5, "printf('a page that is not cited overlaps with the answer all the same (%.4f, %s)', max(page_output_sim), arg_min(domain, (-page_output_sim, ord)))", "run WHERE cited = 0 AND page_output_sim > 0.3 HAVING count(*) > 0"))),
    "cite_patterns": f"WITH {FR}, {_OFFICIAL}, k AS (SELECT source_type, avg(cited) AS r FROM fr WHERE source_type IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY r DESC, source_type LIMIT 2), co AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(corr({f}::DOUBLE, cited::DOUBLE), 4) AS c FROM fr" for f in FR_FEATURES) + ") "
    + " UNION ALL ".join(f"SELECT 1 AS part, '{f}' AS key, printf('{f}: median %.4f cited, %.4f shown but not cited', {_med(f, 1)}, {_med(f, 0)}) AS text FROM fr" for f in FR_FEATURES)
    + " UNION ALL SELECT 2, source_type, printf('%s sources are cited at a rate of %.4f', source_type, r) FROM k UNION ALL SELECT 4, grp, printf('%s sources: cite rate %.4f', grp, r::DOUBLE) FROM rate WHERE n > 0"
    + " UNION ALL SELECT * FROM (SELECT 3, feature, printf('strongest correlation with being cited: %s (%.4f)', feature, c) FROM co ORDER BY abs(c) DESC, feature LIMIT 1)",
    "average_profile": f"WITH {FR} SELECT " + ", ".join(f"coalesce(round(avg({f}), 4), 0.0) AS {f}" for f in FR_FEATURES) + " FROM fr",
    "display_order": f"WITH {FR} SELECT ord, scrape_success, n_chars % 40 AS best_rank FROM fr ORDER BY scrape_success DESC, n_chars % 40, ord LIMIT 25",
    "best_chunk": f"WITH {FR} SELECT record_id, ord AS idx, intent AS heading, topic AS text, line_count::INTEGER AS score FROM fr QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY line_count DESC, ord) = 1",
    "best_page_chunk": f"""{_CHUNKS}, {_lex("SELECT page_id || '#' || idx AS id, '' AS nm, t AS a, '" + ANSWER + "' AS b FROM z")}
SELECT page_id, idx, heading, sim AS score, substring(sha1(t), 1, 12) AS digest FROM z JOIN lex ON id = page_id || '#' || idx QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY sim DESC, idx) = 1""",
    "fetch_split": "SELECT count_if(page_id % 6 <> 0) AS n_ok, count_if(page_id % 6 = 0) AS n_failed FROM pages",
    "long_form": f"WITH {FR}, s AS (SELECT source_type, count(*) AS n, sum(cited) AS c FROM fr WHERE source_type IS NOT NULL GROUP BY 1) SELECT source_type, unnest(['n', 'n_cited', 'cite_rate']) AS series, unnest([n::DOUBLE, c::DOUBLE, round(c / n, 4)::DOUBLE]) AS value FROM s",
    "cluster_topics": f"WITH {QD}, x AS (SELECT DISTINCT qid % 3 AS cluster, 'T' || (qid % 5) AS topic FROM qd) SELECT cluster, string_agg(topic, ', ' ORDER BY topic) AS topics FROM x GROUP BY 1",
    "pooled_runs": f"WITH {FR} SELECT count(DISTINCT run_id) AS n_runs, count(*) AS n_candidates, coalesce(sum(cited), 0)::BIGINT AS n_cited, count_if(run_id = 2) AS n_scraped FROM fr WHERE run_id < 3",
    "compact_rows": f"WITH {FR} SELECT ord, source_type, cited FROM fr",
    "display_numbers": "SELECT o_orderkey, CASE WHEN abs(o_totalprice) < 1000 THEN printf('%.2f', o_totalprice::DOUBLE) ELSE format('{:,}', round_even(o_totalprice, 0)::BIGINT) END AS price, format('{:,}', (o_orderkey * 37)::BIGINT) AS n, round_even((o_orderkey % 801) / 800.0 * 100, 0)::BIGINT || '%' AS share FROM orders",
    "funnel": f"WITH {_FLAG_ROWS} SELECT count(*) AS n_candidates, count_if(ord % 7 <> 0) AS n_scraped, count_if(cited = 1) AS n_cited, count_if(w) AS n_weak FROM fl",
    "flow_edges": f"WITH {_FLAG_ROWS}, t AS (SELECT * FROM fl ORDER BY best_rank, ord LIMIT 16) SELECT 'query' AS level, best_query AS source, domain AS target, count(*) AS n FROM t GROUP BY 2, 3 UNION ALL SELECT 'domain', domain, CASE WHEN cited = 1 THEN 'cited' ELSE 'non-cited' END, count(*) FROM t GROUP BY 2, 3",
    "tier_table": f"""WITH {MATCH}, t AS (SELECT unnest([{', '.join(repr(t) for t in matching.TIERS)}]) AS match_type) SELECT t.match_type, count(m.match_type) AS n, round(count(m.match_type) / (SELECT count(*) FROM m), 4) AS rate,
  CASE t.match_type WHEN 'domain_only' THEN 'weak' WHEN 'no_match' THEN '' ELSE 'strong' END AS strength FROM t LEFT JOIN m ON t.match_type = m.match_type GROUP BY t.match_type UNION ALL SELECT 'TOTAL', count(*), 1.0, '' FROM m""",
    "candidate_features": f"""WITH {CANDS}, {MD}, {_PAGES}, j AS (SELECT c.*, p_text, p_md, pid FROM c LEFT JOIN ok ON normalized_url = nurl),
{_lex("SELECT candidate_id AS id, 'tq' AS nm, title AS a, best_query AS b FROM j UNION ALL SELECT candidate_id, 'pq', substring(p_text, 1, 8000), best_query FROM j WHERE p_text <> '' UNION ALL SELECT candidate_id, 'po', substring(p_text, 1, 8000), '" + ANSWER + "' FROM j WHERE p_text <> ''")},
lx AS (SELECT id, {_sim('tq')} AS title_query_sim, {_sim('pq')} AS page_query_sim, {_sim('po')} AS page_output_sim FROM lex GROUP BY 1)
SELECT candidate_id, (ord % 3 = 0)::INTEGER AS cited, pid IS NOT NULL AS scrape_success, CASE WHEN p_text <> '' THEN {_WORDS} END AS word_count, CASE WHEN p_text <> '' THEN length(p_text) END AS char_count,
  CASE WHEN pid IS NOT NULL THEN len({_HEADS}) END AS heading_count, CASE WHEN p_text <> '' AND pid % 4 = 0 THEN {_FRESH("DATE '2024-01-15'")} END AS freshness_days, coalesce(length(p_text) > 8000, false) AS truncated, title_query_sim, page_query_sim, page_output_sim
FROM j LEFT JOIN lx ON candidate_id = id""",
    "source_features": f"""WITH {MD}, {_PAGES}, pgs AS (SELECT page_id AS source_id, {sql_norm('url')} AS n, substring(title, 1, 40) AS t, regexp_extract(url, '^[^:]+://[^/]+/([a-z]+)/', 1) || ' of the page' AS prompt FROM md), j AS (SELECT pgs.*, p_text, pid FROM pgs LEFT JOIN ok ON n = nurl),
{_lex("SELECT source_id AS id, 'tp' AS nm, t AS a, prompt AS b FROM j UNION ALL SELECT source_id, 'pp', substring(p_text, 1, 8000), prompt FROM j WHERE p_text <> '' UNION ALL SELECT source_id, 'pa', substring(p_text, 1, 8000), '" + ANSWER + "' FROM j WHERE p_text <> ''")},
lx AS (SELECT id, {_sim('tp')} AS title_prompt_similarity, {_sim('pp')} AS page_prompt_similarity, {_sim('pa')} AS page_answer_similarity FROM lex GROUP BY 1)
SELECT source_id, (source_id % 2)::INTEGER AS cited, pid IS NOT NULL AS scrape_success, CASE WHEN p_text <> '' THEN {_WORDS} END AS word_count,
  CASE WHEN p_text <> '' AND pid % 4 = 0 THEN {_FRESH("DATE '2024-01-15'")} WHEN p_text <> '' AND pid % 4 = 1 THEN NULL ELSE {_FRESH("DATE '2024-02-01'")} END AS freshness_days, title_prompt_similarity, page_prompt_similarity, page_answer_similarity
FROM j LEFT JOIN lx ON source_id = id""",
    "brand_pages": f"""WITH {MD}, {_PAGES}, s0 AS (SELECT page_id AS source_id, url, {sql_norm('url')} AS n, {sql_host('url')} AS dom, title AS t, regexp_extract(url, '^[^:]+://[^/]+/([a-z]+)/', 1) || ' of the page' AS prompt FROM md),
s1 AS (SELECT s0.*, p_title, p_text, lower(p_text) AS md, '' AS html, pid, {_HEADS} AS heads FROM s0 LEFT JOIN ok ON n = nurl),
s2 AS (SELECT *, concat_ws(chr(10), url, n, dom, nullif(t, ''), nullif(p_title, ''), nullif(array_to_string(heads, ' '), ''), p_text) AS blob, lower(p_title || chr(10) || array_to_string(heads, ' ') || chr(10) || p_text) AS al FROM s1),
s3 AS (SELECT *, {_found_sql('blob', CLIENT)} AS cl, {_found_sql('blob', COMPETITOR)} AS co FROM s2), s AS (SELECT * FROM s3 WHERE cl OR co),
hh AS (SELECT source_id, prompt, unnest(heads) AS h, generate_subscripts(heads, 1) AS i FROM s WHERE pid IS NOT NULL),
{_lex("SELECT source_id AS id, 'h' || i AS nm, prompt AS a, h AS b FROM hh UNION ALL SELECT source_id, 'begin', prompt, substring(p_text, 1, 500) FROM s WHERE p_text <> ''")},
lx AS (SELECT id, max(sim) FILTER (WHERE nm <> 'begin') AS hs, {_sim('begin')} AS bs FROM lex GROUP BY 1)
SELECT source_id, cl AS is_client_source, co AS is_competitor_source, {', '.join(f'CASE WHEN pid IS NOT NULL THEN {v} END AS {k}' for k, v in _FLAGS_SQL.items())}, CASE WHEN pid IS NOT NULL THEN {_TYPE} ELSE 'unknown' END AS page_type,
  CASE WHEN pid IS NOT NULL THEN coalesce(hs >= 0.12, false) END AS heading_prompt_match, bs AS answer_like_text_in_first_500_chars FROM s LEFT JOIN lx ON source_id = id""",
}
