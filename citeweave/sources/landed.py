"""Landed output of outside services: search results, crawled pages, grounded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.sources import jsonindex


def _get(c: str, *paths: str) -> Column:
    """The first non-empty value among JSON paths of a JSON string."""
    return F.coalesce(*[F.nullif(F.get_json_object(c, f"$.{p}"), F.lit("")) for p in paths])


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """(item_ord, item): one JSON string an item, from JSON lines or files with one array.

    A large file is split over tasks, whichever of the two it is.  ``item_ord`` is unique over all files, and follows
    a file's order.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("o"), "value")
    arrays, files = jsonindex.read_arrays(spark, path, "[")
    lines = raw.where("ltrim(value) LIKE '{%'").join(files.where("top = '['").select("f"), "f", "left_anti").select("f", "b", "o", F.lit(0).alias("pos"), F.col("value").alias("item"))
    zero = F.lit(0).cast("long")
    rows = lines.unionByName(arrays.where("item LIKE '{%'").select("f", zero.alias("b"), zero.alias("o"), F.col("ordinal").alias("pos"), "item"))
    return rows.select(F.struct("f", "b", "o", "pos").alias("item_ord"), "item")


def search_rows(items: DataFrame, top_k: int = 20) -> DataFrame:
    """Ranked result rows: rank is the position, else the rank, else the place in the list; up to ``top_k``."""
    results = F.coalesce(*[F.from_json(F.get_json_object("item", f"$.{f}"), "array<string>") for f in ("organicResults", "organic_results", "results")])
    query = F.coalesce(_get("item", "searchQuery.term", "searchQuery.query", "search_query.term", "search_query.query", "query"), F.lit(""))
    rows = items.select("item_ord", query.alias("query"), F.posexplode(results).alias("pos", "r"))
    rank = F.coalesce(F.nullif(_get("r", "position", "rank").try_cast("int"), F.lit(0)), F.col("pos") + 1)
    text = lambda *p: F.coalesce(_get("r", *p), F.lit(""))
    out = rows.select(F.struct("item_ord", "pos").alias("ord"), "query", rank.alias("rank"), text("url", "link").alias("url"), text("title").alias("title"), text("description", "snippet", "desc").alias("snippet"),
                      text("displayedUrl", "displayUrl").alias("displayed_url"), F.coalesce(_get("r", "type"), F.lit("organic")).alias("result_type"))
    return out.where((F.col("rank") <= top_k) & (F.col("url") != ""))


def page_rows(items: DataFrame) -> DataFrame:
    """Crawled pages; one has succeeded if it has text and no error."""
    g = lambda *p: _get("item", *p)
    text = F.coalesce(g("text"), F.lit(""))
    md = F.coalesce(g("markdown"), text)
    url = F.coalesce(g("url", "crawl.loadedUrl"), F.lit(""))
    error = F.when(~F.coalesce(g("errorMessages"), F.lit("[]")).rlike(r"^\[\s*\]$"), g("errorMessages"))
    error = F.coalesce(error, g("crawl.errorMessage"))
    from citeweave.functions.urls import normalize_url

    return items.select(
        url.alias("url"), normalize_url(url).alias("normalized_url"), F.coalesce(g("crawl.loadedUrl", "loadedUrl"), url).alias("final_url"), g("metadata.canonicalUrl", "metadata.canonical").alias("canonical_url"),
        F.coalesce(g("metadata.title", "title"), F.lit("")).alias("title"), F.coalesce(g("metadata.description"), F.lit("")).alias("description"), g("metadata.author").alias("author"),
        g("metadata.languageCode", "metadata.language").alias("language"), g("metadata.publishedTime", "metadata.datePublished", "metadata.published", "metadata.articlePublishedTime", "metadata.modifiedTime").alias("published_date"),
        text.alias("text"), md.alias("markdown"), g("crawl.httpStatusCode", "crawl.statusCode").try_cast("int").alias("http_status"),
        F.when((md != "") & error.isNull(), "success").otherwise("failed").alias("status"), error.alias("error"),
    )


def answer_rows(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, citations, queries) of landed grounded responses, one an item."""
    g = lambda p: f"candidates[0].{p}"
    parts = F.from_json(F.get_json_object("item", f"$.{g('content.parts')}"), "array<struct<text:string>>")
    text = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    answers = items.select(
        "item_ord", F.coalesce(F.nullif(text, F.lit("")), _get("item", "text"), F.lit("")).alias("output_text"), _get("item", g("finishReason")).alias("finish_reason"), _get("item", "promptFeedback").alias("prompt_feedback"),
        _get("item", g("groundingMetadata.searchEntryPoint.renderedContent")).alias("entry_point_html"), _get("item", "modelVersion", "model").alias("model"),
    )
    chunks = F.from_json(F.get_json_object("item", f"$.{g('groundingMetadata.groundingChunks')}"), "array<struct<web:struct<uri:string, title:string>>>")
    notes = F.from_json(F.get_json_object("item", "$.annotations"), "array<struct<url:string, title:string>>")
    found = F.coalesce(F.transform(chunks, lambda c: F.struct(c["web"]["uri"].alias("uri"), c["web"]["title"].alias("title"))), F.transform(notes, lambda c: F.struct(c["url"].alias("uri"), c["title"].alias("title"))))
    citations = items.select("item_ord", F.posexplode(found).alias("idx", "c")).select("item_ord", "idx", F.col("c.uri").alias("raw_uri"), F.lit(None).cast("string").alias("resolved_url"), F.coalesce("c.title", F.lit("")).alias("title"))
    queries = items.select("item_ord", F.posexplode(F.from_json(F.get_json_object("item", f"$.{g('groundingMetadata.webSearchQueries')}"), "array<string>")).alias("pos", "query"))
    return answers, citations.where("raw_uri <> ''"), queries


def answer_supports(items: DataFrame) -> DataFrame:
    """(item_ord, pos, text, chunk_indices, confidence): which passages of an answer rest on which citations."""
    kind = "array<struct<segment:struct<text:string>, groundingChunkIndices:array<int>, confidenceScores:array<double>>>"
    rows = items.select("item_ord", F.posexplode(F.from_json(F.get_json_object("item", "$.candidates[0].groundingMetadata.groundingSupports"), kind)).alias("pos", "s"))
    none = lambda t: F.array().cast(f"array<{t}>")
    return rows.select("item_ord", "pos", F.coalesce("s.segment.text", F.lit("")).alias("text"), F.coalesce("s.groundingChunkIndices", none("int")).alias("chunk_indices"), F.coalesce("s.confidenceScores", none("double")).alias("confidence"))


def usable(answers: DataFrame, citations: DataFrame, queries: DataFrame) -> bool:
    """Has a response any text, citation or query?  Later stages need one."""
    return not (answers.where("output_text <> ''").isEmpty() and citations.isEmpty() and queries.isEmpty())


def resolve_citations(citations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Final URLs by a landed (raw_uri, final_url) table; unresolved ones keep their own."""
    one = resolved.groupBy("raw_uri").agg(F.min("final_url").alias("final_url"))
    return citations.join(one, "raw_uri", "left").withColumn("resolved_url", F.coalesce("final_url", "resolved_url")).drop("final_url")
