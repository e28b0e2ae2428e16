"""Text counts, headings, chunks, similarity, terms, content flags, dates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.functions import classify, similarity, text
from citeweave.operators import chunking
from citeweave.plans.bindings import AS_OF, MD, md, read

STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


def text_counts(spark, sf):
    d = read(spark, sf, "documents")
    t = F.col("text")
    used = text.used_text(t)
    return d.select("doc_id", F.size(text.words(t)).cast("long").alias("n_words"), F.char_length(t).cast("long").alias("n_chars"), F.char_length(used).cast("long").alias("n_used"), (F.char_length(t) > text.SIMILARITY_CHARS).alias("truncated"))


def heading_extract(spark, sf):
    return md(spark, sf).select("page_id", F.posexplode(text.headings(F.col("md"))).alias("idx", "heading"))


def chunk_windows(spark, sf):
    d = read(spark, sf, "documents")
    w = chunking.windows(text.words(F.col("text")))
    return d.select("doc_id", F.posexplode(w).alias("idx", "w")).select("doc_id", "idx", text.word_count(F.col("w")).cast("long").alias("n_words"), F.substring(F.sha1("w"), 1, 12).alias("digest"))


def chunk_segments(spark, sf):
    rows = chunking.chunk_rows(md(spark, sf), "page_id", "md")
    return rows.select("page_id", "idx", "heading", F.col("n_words").cast("long").alias("n_words"), F.substring(F.sha1("text"), 1, 12).alias("digest"))


def tf_vectors(spark, sf):
    b = read(spark, sf, "benchmark")
    return similarity.tf_vectors(b, ["item_id"], F.col("text")).select("item_id", "term", F.round("weight", 4).alias("weight"))


def _pairs(spark, sf):
    """Every document with one benchmark item, by number: the items are few and sized before they are broadcast."""
    items = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    n = items.count()
    d = read(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("item_id"))
    return d.join(F.broadcast(items) if n <= 10_000 else items, "item_id")


def lexical_similarity(spark, sf):
    return similarity.lexical(_pairs(spark, sf), ["doc_id"], text.used_text(F.col("text")), F.col("item"))


def lexical_summary(spark, sf):
    """The highest similarity of each group of documents and the mean of the three highest: no more than three are gathered."""
    s = lexical_similarity(spark, sf).select((F.col("doc_id") % 20).alias("g"), "sim")
    s = s.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.desc("sim")))).where("rank <= 3").groupBy("g").agg(F.collect_list("sim").alias("s"))
    return s.select("g", similarity.top_mean(F.col("s")).alias("t")).select("g", F.col("t.max").alias("best"), F.round("t.mean_top", 3).alias("top3"))


def dense_similarity_topk(spark, sf):
    """For each vector whose id is divisible by 100 the five most similar of all others."""
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return similarity.nearest(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e, 5)


def freshness_days(spark, sf):
    as_of = F.lit(AS_OF).cast("timestamp")
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), text.freshness_days(F.col("ts"), as_of).alias("days"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.freshness_days(text.parse_date(F.date_format("o_orderdate", "d MMM yyyy")), as_of).alias("days"))
    return e.withColumn("kind", F.lit("event")).unionByName(o.withColumn("kind", F.lit("order")))


def term_detection(spark, sf):
    found = text.detect_terms(F.col("text"), ["the", "und", "token", ".com", "nothing here"], ascii_only=True)
    return read(spark, sf, "documents").select("doc_id", F.array_join(found, ";").alias("terms"))


def _flags(spark, sf):
    page = md(spark, sf).withColumn("intent", F.lit("general the"))
    page = page.withColumn("kind", F.when(F.col("page_id") % 9 == 0, "ecommerce").when(F.col("page_id") % 9 == 1, "forum").otherwise("unknown"))
    # The markdown, and the words that all flags look at, are made once a page: what a generator gives is not
    # put into the expressions that use it.
    page = page.select("page_id", "url", "html", "intent", "kind", F.inline(F.array(F.struct("title", "md"))))
    page = page.select("*", F.inline(F.array(F.struct(text.fold(classify.all_words(F.col("title"), F.col("md"), F.col("md")), ascii_only=True).alias("n_all")))))
    return page, classify.content_flags(F.col("title"), F.col("md"), F.col("md"), F.col("html"), F.col("intent"), ascii_only=True, everything=F.col("n_all"))


def content_flags(spark, sf):
    page, flags = _flags(spark, sf)
    return page.select("page_id", *[flags[f].alias(f) for f in _FLAGS])


def page_type(spark, sf):
    page, flags = _flags(spark, sf)
    page = page.withColumns({f"f_{k}": v for k, v in flags.items()})
    return page.select("page_id", classify.page_type(F.col("url"), F.col("kind"), {k: F.col(f"f_{k}") for k in flags}).alias("page_type"))


def prompt_terms(spark, sf):
    b = read(spark, sf, "benchmark")
    items = text.split_terms(F.regexp_replace("text", r"[.,]", ";"))
    return b.select("item_id", F.size(items).cast("long").alias("n_terms"), text.prompt_key(F.col("text")).alias("prompt_key"))


_FLAGS = ["has_faq", "has_step_by_step", "has_contact_info", "has_price_or_package", "has_author", "has_phone_number", "has_email", "has_schema", "has_table", "has_bullets", "has_many_headings", "title_contains_intent_terms"]
_NAMES = "text_counts heading_extract chunk_windows chunk_segments tf_vectors lexical_similarity lexical_summary dense_similarity_topk freshness_days term_detection content_flags page_type prompt_terms".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_WORDS = lambda t: f"regexp_extract_all({t}, '[^\\s]+')"
_COUNT = lambda t: f"len(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+'))"
_WINDOWS = lambda w: f"CASE WHEN len({w}) <= 120 THEN [array_to_string({w}, ' ')] ELSE list_transform(range(0, len({w}), 95), lambda i: array_to_string({w}[i + 1 : i + 120], ' ')) END"
_TOKENS = lambda t: f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda t: NOT list_contains({STOP}, t))"
_HEAD = "'^\\s*#{1,6}\\s+(.*?)\\s*$'"
_LEX = f"""n AS (SELECT count(*) AS k FROM benchmark), p AS (SELECT doc_id, substring(d.text, 1, 8000) AS a, b.text AS b FROM documents d, n JOIN benchmark b ON b.item_id = d.doc_id % n.k),
x AS (SELECT doc_id, unnest({_TOKENS('a')}) AS t, 1 AS l FROM p UNION ALL SELECT doc_id, unnest({_TOKENS('b')}), 0 FROM p),
c AS (SELECT doc_id, t, count(*) FILTER (WHERE l = 1) AS ca, count(*) FILTER (WHERE l = 0) AS cb FROM x GROUP BY 1, 2),
w AS (SELECT doc_id, CASE WHEN ca > 0 THEN 1 + ln(ca) ELSE 0 END AS wa, CASE WHEN cb > 0 THEN 1 + ln(cb) ELSE 0 END AS wb FROM c),
s AS (SELECT doc_id, sum(wa * wb) / nullif(sqrt(sum(wa * wa)) * sqrt(sum(wb * wb)), 0) AS v FROM w GROUP BY 1),
lex AS (SELECT p.doc_id, coalesce(round(v, 4), 0.0) AS sim FROM p LEFT JOIN s ON p.doc_id = s.doc_id)"""
_any = lambda text_, words: "(" + " OR ".join(f"contains({text_}, '{w}')" for w in words) + ")"
_LINES = "string_split(md, chr(10))"
_FLAG_SQL = {f: _any("al", classify.FLAG_WORDS[f]) for f in classify.FLAG_WORDS} | {
    "has_phone_number": "regexp_matches(md, '(?:\\+?\\d[\\d\\-\\s().]{6,}\\d)')",
    "has_email": "regexp_matches(lower(md), '[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,}')",
    "has_schema": _any("lower(md || ' ' || html)", ("schema.org", "ld+json")),
    "has_table": f"(len(list_filter({_LINES}, lambda x: length(regexp_replace(x, '[^|]', '', 'g')) >= 2)) >= 2 OR contains(replace(md, ' ', ''), '|--') OR contains(lower(html), '<table'))",
    "has_bullets": f"len(list_filter({_LINES}, lambda x: regexp_matches(x, '^\\s*([-*•]|\\d+[.)])\\s+'))) > 0",
    "has_many_headings": "len(heads) >= 5",
    "title_contains_intent_terms": "false",
}
_FLAG_CTE = f"""{MD}, h AS (SELECT *, list_filter(list_transform(list_filter({_LINES}, lambda x: regexp_matches(x, {_HEAD})), lambda x: regexp_extract(x, {_HEAD}, 1)), lambda x: x <> '') AS heads FROM md),
f AS (SELECT *, lower(title || chr(10) || array_to_string(heads, ' ') || chr(10) || md) AS al FROM h)"""
_path = lambda words: _any("lower(url)", words)
ORACLE = {
    "text_counts": f"SELECT doc_id, len({_WORDS('text')}) AS n_words, length(text) AS n_chars, least(length(text), 8000) AS n_used, length(text) > 8000 AS truncated FROM documents",
    "heading_extract": f"WITH {_FLAG_CTE} SELECT page_id, (generate_subscripts(heads, 1) - 1)::INTEGER AS idx, unnest(heads) AS heading FROM h",
    "chunk_windows": f"WITH w AS (SELECT doc_id, {_WORDS('text')} AS ws FROM documents), x AS (SELECT doc_id, {_WINDOWS('ws')} AS p FROM w WHERE len(ws) > 0), y AS (SELECT doc_id, (generate_subscripts(p, 1) - 1)::INTEGER AS idx, unnest(p) AS t FROM x) SELECT doc_id, idx, {_COUNT('t')} AS n_words, substring(sha1(t), 1, 12) AS digest FROM y",
    "chunk_segments": f"""WITH {MD}, l AS (SELECT page_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS i FROM md WHERE trim(md) <> ''),
g AS (SELECT *, regexp_matches(line, {_HEAD}) AS head, sum(regexp_matches(line, {_HEAD})::INTEGER) OVER (PARTITION BY page_id ORDER BY i) AS seg FROM l),
s AS (SELECT page_id, seg, coalesce(max(regexp_extract(line, {_HEAD}, 1)) FILTER (WHERE head), '') AS heading, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head) AS body FROM g GROUP BY 1, 2),
w AS (SELECT page_id, seg, heading, {_WORDS('body')} AS ws FROM s WHERE body IS NOT NULL),
x AS (SELECT page_id, seg, heading, {_WINDOWS('ws')} AS p FROM w WHERE len(ws) > 0), y AS (SELECT page_id, seg, heading, generate_subscripts(p, 1) AS k, unnest(p) AS t FROM x),
z AS (SELECT *, {_COUNT('t')} AS n_words, (row_number() OVER (PARTITION BY page_id ORDER BY seg, k) - 1)::INTEGER AS idx FROM y WHERE {_COUNT('t')} >= 8)
SELECT page_id, idx, heading, n_words, substring(sha1(t), 1, 12) AS digest FROM z WHERE idx < 60""",
    "tf_vectors": f"WITH x AS (SELECT item_id, unnest({_TOKENS('text')}) AS term FROM benchmark) SELECT item_id, term, round(1 + ln(count(*)), 4) AS weight FROM x GROUP BY 1, 2",
    "lexical_similarity": f"WITH {_LEX} SELECT doc_id, sim FROM lex",
    "lexical_summary": f"WITH {_LEX}, g AS (SELECT doc_id % 20 AS g, list_sort(list(sim), 'DESC') AS s FROM lex GROUP BY 1) SELECT g, s[1] AS best, round(round(list_sum(s[1:3]) / len(s[1:3]), 4), 3) AS top3 FROM g",
    "dense_similarity_topk": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS sim FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) SELECT query_id, vec_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 5",
    "freshness_days": f"SELECT event_id AS id, greatest(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 86400.0), 0)::DOUBLE AS days, 'event' AS kind FROM events UNION ALL SELECT o_orderkey, greatest(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('day', o_orderdate))) / 86400.0), 0)::DOUBLE, 'order' FROM orders",
    "term_detection": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN '{t}' END" for t in ("the", "und", "token")) + ", CASE WHEN contains(lower(text), '.com') THEN '.com' END], lambda x: x IS NOT NULL), ';') AS terms FROM documents",
    "content_flags": f"WITH {_FLAG_CTE} SELECT page_id, {', '.join(f'{_FLAG_SQL[f]} AS {f}' for f in _FLAGS if f != 'title_contains_intent_terms')}, regexp_matches(lower(title), '(^|[^a-z0-9])the($|[^a-z0-9])') AND false AS title_contains_intent_terms FROM f",
    "page_type": f"WITH {_FLAG_CTE} SELECT page_id, CASE WHEN page_id % 9 = 1 THEN 'forum_thread' WHEN page_id % 9 = 0 THEN CASE WHEN {_path(classify.MARKET_WORDS)} THEN 'marketplace_page' ELSE 'product_page' END "
    + " ".join(f"WHEN {_path(w)}{' OR ' + _FLAG_SQL[g] if g else ''} THEN '{t}'" for t, w, g in classify.PATH_TYPES)
    + f" WHEN {_FLAG_SQL['has_faq']} THEN 'faq_page' WHEN {_FLAG_SQL['has_booking_or_appointment']} THEN 'appointment_page' WHEN {_FLAG_SQL['has_author']} OR {_FLAG_SQL['has_published_date']} THEN 'article' ELSE 'unknown' END AS page_type FROM f",
    "prompt_terms": """WITH x AS (SELECT item_id, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[.,]', ';', 'g'), '[;|\n]'), lambda t: trim(t)), lambda t: t <> '') AS s FROM benchmark)
SELECT item_id, len(list_distinct(list_transform(s, lambda t: lower(t)))) AS n_terms, trim(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), ' ?.!"''') AS prompt_key FROM x""",
}
