"""The domain's tables, derived from the general test tables, once as DataFrames and once as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.text import detect_terms

FR_FEATURES = ["n_chars", "word_count", "digit_count", "line_count"]
CLIENT, COMPETITOR = ["the", "example.net"], ["and", "example.org"]
EXPECTED = "src1; src2| official,brand"
AS_OF = "2024-03-01 12:00:00"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fr(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with labels, as audited sources."""
    # What is counted on a text is counted before the join, so texts are never shuffled.
    text = F.col("text")
    counts = {"word_count": F.size(F.regexp_extract_all(text, F.lit("[^ \n]+"), F.lit(0))), "digit_count": F.length(F.regexp_replace(text, "[^0-9]", "")), "line_count": F.size(F.split(text, "\n"))}
    d = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", *[c.alias(k) for k, c in counts.items()])
    # Both sides are filtered to non-null ids by the join; labels is the smaller one at every size.
    d = d.join(read(spark, sf, "labels"), "doc_id")
    return d.select(
        F.col("doc_id").alias("ord"), (F.col("doc_id") % 50).alias("record_id"), (F.col("doc_id") % 12).alias("run_id"), F.concat(F.lit("T"), F.col("doc_id") % 3).alias("topic"),
        F.col("lang").alias("intent"), F.col("source").alias("source_type"), F.col("quality").alias("cited"), F.col("n_chars"),
        "word_count", "digit_count", "line_count",
        (F.col("doc_id") % 15).alias("source_position"), F.lit(None).cast("long").alias("observed_rank"),
        (F.col("toxic") == 1).alias("is_client_source"), (F.col("doc_id") % 4 == 0).alias("is_competitor_source"), (F.col("doc_id") % 7 != 0).alias("scrape_success"),
        F.col("source").isin("src0", "src1").alias("institutional_official"), (F.col("doc_id") % 5 == 0).alias("brand_official_candidate"),
    )


FR = """fr AS (SELECT d.doc_id AS ord, d.doc_id % 50 AS record_id, d.doc_id % 12 AS run_id, 'T' || (d.doc_id % 3) AS topic, lang AS intent,
  source AS source_type, quality AS cited, n_chars, len(regexp_extract_all(text, '[^ \n]+')) AS word_count,
  length(regexp_replace(text, '[^0-9]', '', 'g')) AS digit_count, len(string_split(text, chr(10))) AS line_count, d.doc_id % 15 AS source_position,
  toxic = 1 AS is_client_source, d.doc_id % 4 = 0 AS is_competitor_source, d.doc_id % 7 <> 0 AS scrape_success,
  source IN ('src0', 'src1') AS institutional_official, d.doc_id % 5 = 0 AS brand_official_candidate
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def li(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their part's type: the large comparison."""
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    parts = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("source_type"))
    return items.join(parts, "l_partkey").withColumn("cited", (F.col("l_returnflag") == "R").cast("int"))


LI = "li AS (SELECT l.*, p_type AS source_type, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS cited FROM lineitem l JOIN part ON l_partkey = p_partkey)"
LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pg(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as search result rows."""
    return read(spark, sf, "pages").select(
        F.col("page_id").alias("ord"), F.regexp_extract("url", r"^[^:]+://[^/]+/([a-z]+)/", 1).alias("query"), (F.col("page_id") % 50 + 1).cast("int").alias("rank"),
        "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.substring(F.regexp_extract("html", "<title>([^<]*)</title>", 1), 1, 40).alias("snippet"),
    )


PG = """pg AS (SELECT page_id AS ord, regexp_extract(url, '^[^:]+://[^/]+/([a-z]+)/', 1) AS query, (page_id % 50 + 1)::INTEGER AS rank, url,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, substring(regexp_extract(html, '<title>([^<]*)</title>', 1), 1, 40) AS snippet FROM pages)"""


def ct(spark: SparkSession, sf: str) -> DataFrame:
    """Citations: every page, its URL changed by page_id % 7: one in seven leads elsewhere on its host, one in seven off it."""
    u, k = F.col("url"), F.col("page_id") % 7
    tracked = F.when(u.contains("?"), F.regexp_replace(u, r"\?", "?utm_source=x&")).otherwise(F.regexp_replace(u, "^([^#]*)(.*)$", "$1?utm_source=x$2"))
    swapped = F.when(u.startswith("https:"), F.concat(F.lit("http"), F.substring(u, 6, 4000))).otherwise(F.concat(F.lit("https"), F.substring(u, 5, 4000)))
    raw = F.when(k == 1, tracked).when(k == 2, swapped).when(k == 3, F.concat(F.regexp_extract(u, "^([^?#]*)", 1), F.lit("/"))).when(k == 4, F.regexp_replace(u, "://", "://amp."))
    raw = raw.when(k == 5, F.concat(F.regexp_extract(u, "^([^:]+://[^/]+)", 1), F.lit("/other/"), F.col("page_id").cast("string"))).when(k == 6, F.concat(F.lit("https://unknown-"), F.col("page_id").cast("string"), F.lit(".invalid/x"))).otherwise(u)
    return read(spark, sf, "pages").select(F.col("page_id").alias("idx"), raw.alias("raw_uri"), F.lit(None).cast("string").alias("resolved_url"), F.lit("").alias("title"))


CT = """ct AS (SELECT page_id AS idx, CASE page_id % 7
  WHEN 1 THEN CASE WHEN contains(url, '?') THEN regexp_replace(url, '\\?', '?utm_source=x&', 'g') ELSE regexp_replace(url, '^([^#]*)(.*)$', '\\1?utm_source=x\\2') END
  WHEN 2 THEN CASE WHEN url LIKE 'https:%' THEN 'http' || substring(url, 6) ELSE 'https' || substring(url, 5) END
  WHEN 3 THEN regexp_extract(url, '^([^?#]*)', 1) || '/' WHEN 4 THEN replace(url, '://', '://amp.')
  WHEN 5 THEN regexp_extract(url, '^([^:]+://[^/]+)', 1) || '/other/' || page_id WHEN 6 THEN 'https://unknown-' || page_id || '.invalid/x' ELSE url END AS raw_uri
  FROM pages)"""


def qd(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and the hosts shown for them."""
    host = F.regexp_extract("url", "^[^:]+://([^/]+)", 1)
    return read(spark, sf, "pages").select((F.col("page_id") % 12).alias("qid"), host.alias("domain"), (F.col("page_id") % 5 < 2).cast("int").alias("cited"))


QD = "qd AS (SELECT page_id % 12 AS qid, regexp_extract(url, '^[^:]+://([^/]+)', 1) AS domain, CASE WHEN page_id % 5 < 2 THEN 1 ELSE 0 END AS cited FROM pages)"

_STEPS = (
    (r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", ""), (r"<h[1-6][^>]*>", "\n# "), (r"</h[1-6]>", "\n"), (r"<li[^>]*>", "\n- "),
    (r"<(?:p|br|tr|div)[^>]*>", "\n"), (r"<[^>]*>", " "),
)


def markdown(html: Column) -> Column:
    for pattern, by in _STEPS:
        html = F.regexp_replace(html, pattern, by)
    return html


def md(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", "url", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), markdown(F.col("html")).alias("md"))


def _md_sql() -> str:
    x = "html"
    for pattern, by in _STEPS:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


MD = f"md AS (SELECT page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {_md_sql()} AS md FROM pages)"


def cv(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as prompts and answers."""
    c = read(spark, sf, "conversations")
    answer = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    g = c.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("prompt"), answer.alias("answer"))
    flag = F.when(F.col("conv_id") % 3 == 1, F.lit(True)).when(F.col("conv_id") % 3 == 2, F.lit(False))
    return g.select(F.col("conv_id").alias("record_id"), F.col("conv_id").alias("ord"), F.concat(F.lit("T"), F.col("conv_id") % 4).alias("topic"), F.concat(F.lit("I"), F.col("conv_id") % 3).alias("intent"),
                    F.coalesce("prompt", F.lit("")).alias("prompt"), "answer", flag.alias("nonbranded"))


CV = """cv AS (SELECT conv_id AS record_id, conv_id AS ord, 'T' || (conv_id % 4) AS topic, 'I' || (conv_id % 3) AS intent,
  coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS prompt, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS answer,
  CASE conv_id % 3 WHEN 1 THEN true WHEN 2 THEN false END AS nonbranded FROM conversations GROUP BY conv_id)"""


def brand_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(records, sources) for brand visibility; the term lists are fixed and ASCII."""
    records = cv(spark, sf)
    found = lambda c, t: detect_terms(F.col(c), t, ascii_only=True)
    records = records.withColumns({"prompt_client": found("prompt", CLIENT), "answer_client": found("answer", CLIENT), "answer_competitor": found("answer", COMPETITOR)})
    p = pg(spark, sf).withColumn("blob", F.concat_ws("\n", "url", "title"))
    sources = p.select((F.col("ord") % 97).alias("record_id"), (F.col("ord") % 5 < 2).cast("int").alias("cited"),
                       (F.size(detect_terms(F.col("blob"), CLIENT, True)) > 0).alias("client"), (F.size(detect_terms(F.col("blob"), COMPETITOR, True)) > 0).alias("competitor"))
    return records, sources


def _found_sql(text: str, terms: list[str]) -> str:
    one = lambda t: f"contains(lower({text}), '{t}')" if "." in t else f"regexp_matches(lower({text}), '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    return "(" + " OR ".join(one(t) for t in terms) + ")"


BRAND = f"""{CV}, {PG},
src AS (SELECT ord % 97 AS record_id, CASE WHEN ord % 5 < 2 THEN 1 ELSE 0 END AS cited, {_found_sql("url || chr(10) || title", CLIENT)} AS client,
  {_found_sql("url || chr(10) || title", COMPETITOR)} AS competitor FROM pg),
per AS (SELECT record_id, count(*) AS n_sources, count_if(cited = 1) AS n_cited, count_if(client) AS n_client_sources, count_if(client AND cited = 1) AS n_client_cited,
  count_if(competitor) AS n_competitor_sources, count_if(competitor AND cited = 1) AS n_competitor_cited FROM src GROUP BY 1),
j AS (SELECT cv.*, coalesce(n_sources, 0) AS n_sources, coalesce(n_cited, 0) AS n_cited, coalesce(n_client_sources, 0) AS n_client_sources, coalesce(n_client_cited, 0) AS n_client_cited,
  coalesce(n_competitor_sources, 0) AS n_competitor_sources, coalesce(n_competitor_cited, 0) AS n_competitor_cited,
  {_found_sql("prompt", CLIENT)} AS pc, {_found_sql("answer", CLIENT)} AS ac, {_found_sql("answer", COMPETITOR)} AS ak FROM cv LEFT JOIN per ON cv.record_id = per.record_id),
rec AS (SELECT *, coalesce(nonbranded, NOT pc) AS is_nonbranded_prompt, ac OR n_client_sources > 0 AS client_appeared, n_client_cited > 0 AS client_cited,
  n_client_sources > 0 AND n_client_cited = 0 AS client_more_only, ak OR n_competitor_sources > 0 AS competitor_appeared, n_competitor_cited > 0 AS competitor_cited,
  n_competitor_sources > 0 AND n_competitor_cited = 0 AS competitor_more_only, ac OR n_client_sources > 0 OR ak OR n_competitor_sources > 0 AS any_target_brand_appeared,
  n_client_cited > 0 OR n_competitor_cited > 0 AS any_target_brand_cited FROM j)"""
