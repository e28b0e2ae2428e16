"""Exports, landed service output, manifests and prompts, bound to the test tables as the JSON texts and rows that their readers take."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.operators import matching
from citeweave.plans.bindings import CT, CV, MD, ct, cv, md, read
from citeweave.plans.queries_urls import sql_norm
from citeweave.sources import export, landed, manifest, prompts, snapshots


def _fields(df):
    """With a null for every field of an export that the binding does not fill."""
    return df.select("*", *[F.lit(None).cast("string").alias(f) for f in export.FIELDS if f not in df.columns])


def _raw_prompts(spark, sf):
    """Conversations as raw export records: ids, prompts and queries in all the forms that an export may hold."""
    k = F.col("k")
    c = cv(spark, sf).select(F.col("record_id").alias("k"), "prompt", "answer")
    return _fields(c.select(
        k.alias("ordinal"), F.when(k % 3 == 0, F.concat(F.lit("R"), k)).alias("record_id"), F.when(k % 3 == 1, F.concat(F.lit("id"), k)).alias("id"), F.when(k % 4 != 1, F.concat(F.lit("  "), "prompt")).alias("prompt"),
        F.concat(F.lit("https://chat.example.com/c?x=1&q=asked"), k).alias("url"), F.col("answer").alias("answer_text"), F.when(k % 2 == 0, F.concat(F.lit("# "), "answer")).alias("answer_text_markdown"),
        F.when(k % 3 == 0, '["a b"," c "]').when(k % 3 == 1, '[{"query":"x"},{"text":"y"},{"q":"z"}]').otherwise("plain query").alias("web_search_query"),
        F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "1").when(k % 4 == 2, "false").alias("web_search_triggered")))


def export_records(spark, sf):
    r = export.parse_records(_raw_prompts(spark, sf))
    return r.select("record_id", "ord", "prompt", F.char_length("answer_text").cast("long").alias("answer_chars"), (F.col("answer_markdown") != "").alias("is_markdown"), F.array_join("web_search_query", "|").alias("queries"), "web_search_triggered")


def export_warnings(spark, sf):
    raw = _raw_prompts(spark, sf).withColumn("url", F.lit("https://chat.example.com/"))
    return export.record_warnings(export.parse_records(raw))


_RAW_SQL = f"""{CV}, raw AS (SELECT *, record_id AS k FROM cv)"""
_RECORD_ID = "CASE k % 3 WHEN 0 THEN 'R' || k WHEN 1 THEN 'id' || k ELSE 'rec-' || (k + 1) END"

#: Twelve pages make a record; every fourth one stands in the same origin, and every fifth record has a raw response only.
_PER = 12


def _raw_sources(spark, sf):
    p = read(spark, sf, "pages").select(F.floor(F.col("page_id") / _PER).cast("long").alias("rec"), (F.col("page_id") % _PER).cast("int").alias("j"))
    rec, j = F.col("rec"), F.col("j")
    url = F.concat(F.lit("https://h"), rec % 7, F.lit(".example.com/p"), j % 5, F.when(j % 2 == 1, F.lit("?utm_source=x")).otherwise(F.lit("")))
    p = p.withColumn("prio", F.when(rec % 5 == 4, 4).otherwise(j % 4))
    item = F.struct(
        url.alias("url"), F.when(j % 3 == 0, "").otherwise(F.concat(F.lit(" T"), j)).alias("title"), F.when(F.col("prio") != 4, F.concat(F.lit("D"), j)).alias("description"), F.when(F.col("prio") == 4, F.concat(F.lit("S"), j)).alias("snippet"),
        F.when((j % 8 == 0) & (rec % 2 == 1), "true").otherwise("no").alias("cited"), F.when(F.col("prio").isin(2, 4), j + 1).alias("rank"))
    items = p.groupBy("rec", "prio").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("j", item.alias("item")))), lambda x: x["item"])).alias("t"))
    of = lambda n: F.max(F.when(F.col("prio") == n, F.col("t")))
    raw = items.groupBy("rec").agg(*[of(n).alias(o) for n, o in enumerate(export.ORIGINS[:4])], F.concat(F.lit('{"deep":{"of":['), of(4), F.lit('],"n":1}}')).alias("response_raw"))
    return _fields(raw.select(F.col("rec").alias("ordinal"), F.concat(F.lit("r"), "rec").alias("record_id"), F.concat(F.lit("prompt "), "rec").alias("prompt"), *export.ORIGINS))


def _extracted(spark, sf):
    records = export.parse_records(_raw_sources(spark, sf))
    return records, export.extract_sources(records)


def extract_sources(spark, sf):
    s = _extracted(spark, sf)[1]
    return s.select("record_id", "normalized_url", "url", "source_origin", "source_group", "cited_label", "source_position", "observed_rank", "title", "description", "domain", "source_id", F.size("appearances").cast("long").alias("n_appearances"))


def run_summary(spark, sf):
    return export.run_summary(*_extracted(spark, sf))


def flatten_sources(spark, sf):
    return export.flatten_sources(*_extracted(spark, sf)).select("record_id", "normalized_url", "prompt", "cited_label")


def fetch_scopes(spark, sf):
    """What would be fetched of the extracted sources, by scope."""
    s = _extracted(spark, sf)[1].withColumn("ord", F.struct("record_id", "seq"))
    picked = lambda scope: matching.select_source_urls(s, scope).select(F.lit(scope).alias("scope"), "normalized_url", "record_id")
    return picked("all").unionByName(picked("cited")).unionByName(picked("more_only"))


_SRC = f"""it AS (SELECT page_id // {_PER} AS rec, (page_id % {_PER})::INTEGER AS j FROM pages),
a0 AS (SELECT *, CASE WHEN rec % 5 = 4 THEN 4 ELSE j % 4 END AS prio FROM it), a1 AS (SELECT *, row_number() OVER (PARTITION BY rec, prio ORDER BY j) - 1 AS pos,
  'https://h' || (rec % 7) || '.example.com/p' || (j % 5) AS normalized_url, CASE WHEN j % 2 = 1 THEN '?utm_source=x' ELSE '' END AS tail,
  (prio = 3 OR (prio = 0 AND j % 8 = 0 AND rec % 2 = 1))::INTEGER AS cited, CASE WHEN prio IN (2, 4) THEN j + 1 END AS observed_rank FROM a0),
a2 AS (SELECT *, max(cited) FILTER (WHERE prio < 3) OVER (PARTITION BY rec) AS any_cited FROM a1), a3 AS (SELECT *, prio * 1000 + pos AS seq FROM a2 WHERE prio <> 3 OR coalesce(any_cited, 0) = 0),
src AS (SELECT 'r' || rec AS record_id, normalized_url, arg_min(normalized_url || tail, seq) AS url, coalesce(arg_min(prio, seq) FILTER (WHERE cited = 1), arg_min(prio, seq)) AS o, max(cited) AS cited_label,
  arg_min(CASE WHEN prio IN (2, 4) THEN j + 1 ELSE pos + 1 END, seq)::INTEGER AS source_position, arg_min(observed_rank, seq) FILTER (WHERE observed_rank IS NOT NULL) AS observed_rank,
  coalesce(arg_min('T' || j, seq) FILTER (WHERE j % 3 <> 0), '') AS title, arg_min(CASE WHEN prio = 4 THEN 'S' ELSE 'D' END || j, seq) AS description, count(*) AS n_appearances, min(seq) AS seq, rec FROM a3 GROUP BY rec, normalized_url)"""
_GROUP = "CASE WHEN cited_label = 1 THEN 'cited' ELSE 'more_only' END"


def _serp(spark, sf):
    """Ten pages a result list."""
    j = F.col("page_id") % 10
    r = F.struct(F.when(j % 4 != 3, j * 2).cast("string").alias("position"), F.when(j % 5 != 4, F.col("url")).alias("url"), F.when(j % 5 == 4, F.col("url")).alias("link"), F.concat(F.lit("title "), F.col("page_id")).alias("title"), F.concat(F.lit("text "), j).alias("description"))
    g = read(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / 10).cast("long").alias("item_ord")).agg(F.transform(F.sort_array(F.collect_list(F.struct("page_id", r.alias("r")))), lambda x: x["r"]).alias("organicResults"))
    return g.select("item_ord", F.to_json(F.struct(F.struct(F.concat(F.lit("q"), F.col("item_ord") % 3).alias("term")).alias("searchQuery"), "organicResults")).alias("item"))


def landed_search_rows(spark, sf):
    return landed.search_rows(_serp(spark, sf), 12).select("query", "rank", "url", "title", "snippet", "result_type")


def landed_pages(spark, sf):
    k = F.col("page_id")
    item = F.to_json(F.struct(
        "url", F.when(k % 8 != 5, F.col("md")).alias("text"), F.struct("title", F.when(k % 3 == 0, "2024-01-02").alias("publishedTime"), F.when(k % 3 == 1, "2024-02-03").alias("modifiedTime")).alias("metadata"),
        F.struct(F.when(k % 9 == 0, 404).otherwise(200).alias("httpStatusCode"), F.when(k % 9 == 0, "not found").alias("errorMessage")).alias("crawl")))
    p = landed.page_rows(md(spark, sf).select(k.alias("item_ord"), item.alias("item")))
    return p.select("url", "normalized_url", "title", "published_date", "http_status", "status", "error", F.char_length("markdown").cast("long").alias("n_chars"))


def _answers(spark, sf):
    """Conversations as grounded answers, every fifth with annotations only."""
    k = F.col("record_id")
    web = lambda n: F.struct(F.struct(F.concat(F.lit("https://h"), k % 9, F.lit(f".example.com/{n}")).alias("uri"), F.lit(f"t{n}").alias("title")).alias("web"))
    support = F.struct(F.struct(F.substring("answer", 1, 9).alias("text")).alias("segment"), F.array(F.lit(0), (k % 2).cast("int")).alias("groundingChunkIndices"), F.array(F.lit(0.5)).alias("confidenceScores"))
    meta = F.when(k % 5 != 4, F.struct(F.array(web(0), web(1)).alias("groundingChunks"), F.array(F.concat(F.lit("q"), k), F.lit("more")).alias("webSearchQueries"), F.array(support).alias("groundingSupports"), F.struct(F.lit("<a>").alias("renderedContent")).alias("searchEntryPoint")))
    candidate = F.struct(F.struct(F.array(F.struct(F.col("answer").alias("text")), F.struct(F.lit("!").alias("text"))).alias("parts")).alias("content"), F.lit("STOP").alias("finishReason"), meta.alias("groundingMetadata"))
    notes = F.when(k % 5 == 4, F.array(F.struct(F.lit("https://note.example.com/").alias("url"), F.lit("note").alias("title"))))
    return cv(spark, sf).select(k.alias("item_ord"), F.to_json(F.struct(F.array(candidate).alias("candidates"), notes.alias("annotations"), F.lit("m1").alias("modelVersion"))).alias("item"))


def landed_answers(spark, sf):
    return landed.answer_rows(_answers(spark, sf))[0].select("item_ord", F.char_length("output_text").cast("long").alias("n_chars"), "finish_reason", "model", "entry_point_html")


def landed_citations(spark, sf):
    return landed.answer_rows(_answers(spark, sf))[1].select("item_ord", "idx", "raw_uri", "title")


def landed_queries(spark, sf):
    return landed.answer_rows(_answers(spark, sf))[2]


def landed_supports(spark, sf):
    s = landed.answer_supports(_answers(spark, sf))
    return s.select("item_ord", "pos", "text", F.array_join(F.col("chunk_indices").cast("array<string>"), ",").alias("chunks"), F.array_max("confidence").alias("confidence"))


def resolved_citations(spark, sf):
    resolved = read(spark, sf, "pages").where("page_id % 5 = 0").join(ct(spark, sf), F.col("page_id") == F.col("idx")).select("raw_uri", F.concat(F.lit("https://final.example.com/"), F.col("page_id") % 5).alias("final_url"))
    return landed.resolve_citations(ct(spark, sf), resolved).select("idx", "resolved_url")


def manifest_by_hash(spark, sf):
    """Half of the entries name their prompt by hash only."""
    c, k = cv(spark, sf).withColumn("h", F.sha1("prompt")), F.col("record_id")
    entries = c.where("record_id % 3 <> 1").select(k.alias("ordinal"), F.concat(F.lit("E"), k).alias("prompt_id"), F.concat(F.lit("I"), k % 5).alias("intent"), F.when(k % 2 == 0, "").otherwise(F.col("prompt")).alias("prompt"), F.when(k % 2 == 0, F.col("h")).alias("prompt_hash"), F.lit("a; B|a").alias("client_brand_terms_to_detect_in_output"), F.lit("No").alias("prompt_is_nonbranded"))
    applied = manifest.apply_manifest(c.select("record_id", "ord", "prompt", F.col("h").alias("prompt_hash")), manifest.parse_manifest(entries))
    return applied.select("record_id", "matched", "prompt_id", "intent", F.array_join("client_terms", ";").alias("client_terms"), "prompt_is_nonbranded")


def manifest_warnings(spark, sf):
    c = cv(spark, sf).select(F.col("ord").alias("ordinal"), F.when(F.col("ord") % 4 != 0, F.col("prompt")).otherwise("  ").alias("prompt"), F.when(F.col("ord") % 8 == 0, "h").alias("prompt_hash"))
    return manifest.manifest_warnings(c)


def prompt_lines(spark, sf):
    """Benchmark items as pasted lines in four forms."""
    k, t = F.col("item_id"), F.regexp_replace("text", r"\s+", " ")
    line = F.when(k % 4 == 0, F.concat(F.lit("P"), k % 100, F.lit("\tHow\t"), t)).when(k % 4 == 1, F.concat(F.lit("Where | "), t)).when(k % 4 == 2, F.concat(F.lit("  "), F.lit("AB7   "), t)).otherwise(t)
    lines = read(spark, sf, "benchmark").select(line.alias("text"))
    return prompts.prompt_block(lines, topic="bench").select("id", "intent", "prompt", "topic")


def topic_questions(spark, sf):
    """The first twelve questions of two topic packs."""
    packs = cv(spark, sf).select("topic", F.concat(F.lit("Q"), "ord").alias("id"), "ord", "intent", "prompt")
    return prompts.first_questions(prompts.topic_items(packs, ["T1", "T2"]), 12, "ord").select("topic", "id", "intent")


def pages_merged(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.col("page_id").alias("key"))
    return snapshots.merge_pages(p.where("page_id % 3 <> 0").withColumn("fetch", F.lit("old")), p.where("page_id % 4 <> 0").withColumn("fetch", F.lit("new")), "key").select("page_id", "fetch")


def fetch_failures(spark, sf):
    w = read(spark, sf, "pages").select("page_id", "url", F.col("page_id").alias("normalized_url"))
    got = w.where("page_id % 6 <> 0").select("normalized_url", F.lit("success").alias("status"))
    return matching.with_failures(w, got).select(F.col("normalized_url").alias("page_id"), "status", "error")


def request_keys(spark, sf):
    return cv(spark, sf).select("record_id", "topic").withColumn("key", snapshots.stable_hash("topic", "record_id"))


_NAMES = (
    "export_records export_warnings extract_sources run_summary flatten_sources fetch_scopes landed_search_rows landed_pages landed_answers landed_citations landed_queries landed_supports resolved_citations "
    "manifest_by_hash manifest_warnings prompt_lines topic_questions pages_merged fetch_failures request_keys"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_ENTRY = "man AS (SELECT record_id, prompt, 'E' || record_id AS prompt_id, 'I' || (record_id % 5) AS intent, record_id % 2 = 0 AS hashed FROM cv WHERE record_id % 3 <> 1)"
_KEY = lambda c: f"""trim(regexp_replace(trim(lower({c})), '\\s+', ' ', 'g'), ' ?.!"''')"""
_FLAT = "regexp_replace(text, '\\s+', ' ', 'g')"
ORACLE = {
    "export_records": f"""WITH {_RAW_SQL} SELECT {_RECORD_ID} AS record_id, k AS ord, CASE WHEN k % 4 <> 1 AND trim(prompt) <> '' THEN trim('  ' || prompt) ELSE 'asked' || k END AS prompt,
  CASE WHEN k % 2 = 0 THEN length(trim('# ' || answer)) ELSE length(trim(answer)) END AS answer_chars, k % 2 = 0 AS is_markdown,
  CASE k % 3 WHEN 0 THEN 'a b|c' WHEN 1 THEN 'x|y|z' ELSE 'plain query' END AS queries, k % 4 < 2 AS web_search_triggered FROM raw""",
    "export_warnings": f"WITH {_RAW_SQL} SELECT {_RECORD_ID} AS record_id, 'no prompt found' AS warning FROM raw WHERE k % 4 = 1 OR trim(prompt) = ''",
    "extract_sources": f"""WITH {_SRC} SELECT record_id, normalized_url, url, ['citations', 'search_sources_more', 'search_sources', 'links_attached', 'response_raw'][o + 1] AS source_origin, {_GROUP} AS source_group, cited_label, source_position, observed_rank,
  title, description, 'h' || (rec % 7) || '.example.com' AS domain, substring(sha1(record_id || ':' || normalized_url), 1, 12) AS source_id, n_appearances FROM src""",
    "run_summary": f"WITH {_SRC} SELECT (SELECT count(DISTINCT rec) FROM it) AS n_records, count(*) AS n_sources, count_if(cited_label = 1) AS n_cited, count_if(cited_label = 0) AS n_more_only, (SELECT count(*) FROM it) > 0 AND count(*) = 0 AS looks_like_input FROM src",
    "flatten_sources": f"WITH {_SRC} SELECT record_id, normalized_url, 'prompt ' || rec AS prompt, cited_label FROM src",
    "fetch_scopes": f"""WITH {_SRC}, s AS (SELECT unnest(['all', {_GROUP}]) AS scope, normalized_url, record_id, seq FROM src)
SELECT scope, normalized_url, arg_min(record_id, (record_id, seq)) AS record_id FROM s GROUP BY 1, 2""",
    "landed_search_rows": "WITH x AS (SELECT page_id % 10 AS j, page_id // 10 AS g, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS place, * FROM pages), y AS (SELECT *, (CASE WHEN j % 4 = 3 OR j = 0 THEN place ELSE j * 2 END)::INTEGER AS rank FROM x) SELECT 'q' || (g % 3) AS query, rank, url, 'title ' || page_id AS title, 'text ' || j AS snippet, 'organic' AS result_type FROM y WHERE rank <= 12",
    "landed_pages": f"""WITH {MD}, x AS (SELECT *, CASE WHEN page_id % 8 = 5 THEN '' ELSE md END AS t FROM md)
SELECT url, {sql_norm('url')} AS normalized_url, title, CASE page_id % 3 WHEN 0 THEN '2024-01-02' WHEN 1 THEN '2024-02-03' END AS published_date, CASE WHEN page_id % 9 = 0 THEN 404 ELSE 200 END AS http_status,
  CASE WHEN t <> '' AND page_id % 9 <> 0 THEN 'success' ELSE 'failed' END AS status, CASE WHEN page_id % 9 = 0 THEN 'not found' END AS error, length(t) AS n_chars FROM x""",
    "landed_answers": f"WITH {CV} SELECT record_id AS item_ord, length(answer) + 1 AS n_chars, 'STOP' AS finish_reason, 'm1' AS model, CASE WHEN record_id % 5 <> 4 THEN '<a>' END AS entry_point_html FROM cv",
    "landed_citations": f"""WITH {CV}, x AS (SELECT record_id AS item_ord, unnest([0, 1]) AS idx FROM cv WHERE record_id % 5 <> 4)
SELECT item_ord, idx, 'https://h' || (item_ord % 9) || '.example.com/' || idx AS raw_uri, 't' || idx AS title FROM x UNION ALL SELECT record_id, 0, 'https://note.example.com/', 'note' FROM cv WHERE record_id % 5 = 4""",
    "landed_queries": f"WITH {CV} SELECT record_id AS item_ord, unnest([0, 1]) AS pos, unnest(['q' || record_id, 'more']) AS query FROM cv WHERE record_id % 5 <> 4",
    "landed_supports": f"WITH {CV} SELECT record_id AS item_ord, 0 AS pos, substring(answer, 1, 9) AS text, '0,' || (record_id % 2) AS chunks, 0.5::DOUBLE AS confidence FROM cv WHERE record_id % 5 <> 4",
    "resolved_citations": f"WITH {CT}, r AS (SELECT raw_uri, min('https://final.example.com/0') AS f FROM ct WHERE idx % 5 = 0 GROUP BY 1) SELECT idx, f AS resolved_url FROM ct LEFT JOIN r USING (raw_uri)",
    "manifest_by_hash": f"""WITH {CV}, {_ENTRY},
bh AS (SELECT prompt AS p, min(record_id) AS r FROM man WHERE hashed GROUP BY 1), bk AS (SELECT {_KEY('prompt')} AS key, min(record_id) AS r FROM man WHERE NOT hashed AND {_KEY('prompt')} <> '' GROUP BY 1),
j AS (SELECT cv.record_id, coalesce(bh.r, bk.r) AS r FROM cv LEFT JOIN bh ON cv.prompt = bh.p LEFT JOIN bk ON {_KEY('cv.prompt')} = bk.key)
SELECT record_id, r IS NOT NULL AS matched, 'E' || r AS prompt_id, coalesce('I' || (r % 5), '(unmatched)') AS intent, CASE WHEN r IS NULL THEN '' ELSE 'a;B' END AS client_terms, CASE WHEN r IS NOT NULL THEN false END AS prompt_is_nonbranded FROM j""",
    "manifest_warnings": f"WITH {CV} SELECT ord AS ordinal, 'manifest row ' || (ord + 1) || ' has neither prompt nor hash, skipped' AS warning FROM cv WHERE (ord % 4 = 0 OR trim(prompt) = '') AND ord % 8 <> 0",
    "prompt_lines": f"""SELECT CASE item_id % 4 WHEN 0 THEN 'P' || (item_id % 100) WHEN 2 THEN 'AB7' ELSE '' END AS id, CASE item_id % 4 WHEN 0 THEN 'How' WHEN 1 THEN 'Where' ELSE 'Custom' END AS intent, trim({_FLAT}) AS prompt, 'bench' AS topic FROM benchmark""",
    "topic_questions": f"WITH {CV} SELECT topic, 'Q' || ord AS id, intent FROM cv WHERE topic IN ('T1', 'T2') ORDER BY ord LIMIT 12",
    "pages_merged": "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN 'new' ELSE 'old' END AS fetch FROM pages WHERE page_id % 4 <> 0 OR page_id % 3 <> 0",
    "fetch_failures": "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN page_id % 6 = 0 THEN 'not returned' END AS error FROM pages",
    "request_keys": f"""WITH {CV} SELECT record_id, topic, sha256('{{"record_id":' || record_id || ',"topic":"' || topic || '"}}') AS key FROM cv""",
}
