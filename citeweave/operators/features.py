"""Feature rows of candidates and of export sources.

``keep`` (name, table) is called on tables that several later ones are derived from: it may write them
and give them back as read from their files (``citeweave.stages``); by default they stay lazy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import classify, similarity, text
from citeweave.operators.chunking import chunk_rows
from citeweave.operators.matching import best_query


#: Columns of a page that feature rows do not keep.
_TEXTS = ("p_text", "p_other", "p_md", "p_date")


def _lazy(name: str, df: DataFrame) -> DataFrame:
    return df


def _page_columns(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """``rows`` with their page's text, and what is counted on it; null unless it was fetched and has text.
    ``p_other`` is its markdown where that differs (``_markdown``), so a text is shuffled and written once."""
    plain, md = F.coalesce(F.nullif("text", F.lit("")), "markdown"), F.coalesce(F.nullif("markdown", F.lit("")), "text")
    ok = pages.where("status = 'success'").select("normalized_url", plain.alias("p_text"), F.when(~md.eqNullSafe(plain), md).alias("p_other"), F.col("published_date").alias("p_date"), F.lit(True).alias("fetched"))
    out = rows.join(ok, "normalized_url", "left").withColumn("scrape_success", F.coalesce("fetched", F.lit(False))).drop("fetched")
    has = F.col("p_text") != ""
    counts = {
        "word_count": F.size(text.words(F.col("p_text"))), "char_count": F.char_length("p_text"), "used_char_count": F.least(F.char_length("p_text"), F.lit(text.SIMILARITY_CHARS)),
    }
    out = out.withColumns({k: F.when(has, v) for k, v in counts.items()})
    return out.withColumns({"original_char_count": F.col("char_count"), "truncated": F.coalesce(F.col("char_count") > text.SIMILARITY_CHARS, F.lit(False)), "heading_count": F.when(F.col("scrape_success"), F.size(text.headings(_markdown())))})


def _markdown() -> Column:
    return F.coalesce("p_other", "p_text")


def _similarities(rows: DataFrame, key: str, pairs: dict[str, tuple[Column, Column]], score: Callable = similarity.lexical) -> DataFrame:
    """(key, names..): all text pairs of a row in one pass of the pair operator."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), a.cast("string").alias("a"), b.cast("string").alias("b")) for n, (a, b) in pairs.items()]))
    long = rows.select(key, cells.alias("x")).select(key, "x.*").where("a IS NOT NULL AND b IS NOT NULL")
    scored = score(long, [key, "name"], F.col("a"), F.col("b"))
    return scored.groupBy(key).pivot("name", list(pairs)).agg(F.first("sim"))


def _scored(rows: DataFrame, key: str, pairs: dict[str, tuple[Column, Column]], score: Callable) -> DataFrame:
    """``rows`` with the similarity of each pair, null where it has a null: row by row if ``score`` has ``columns``."""
    if columns := getattr(score, "columns", None):
        found = rows.withColumn("__sims", columns(list(pairs.values())))
        return found.withColumns({n: F.col("__sims")[i] for i, n in enumerate(pairs)}).drop("__sims")
    return rows.join(_similarities(rows, key, pairs, score), key, "left")


def chunk_scores(rows: DataFrame, key: str, targets: dict[str, Column], score: Callable = similarity.lexical, keep: Callable = _lazy) -> tuple[DataFrame, DataFrame]:
    """(chunks with a score a target, best score a text and target)."""
    texts = rows.where("p_md <> ''").select(key, "p_md", *[c.alias(f"t_{n}") for n, c in targets.items()])
    joined = chunk_rows(texts, key, "p_md", also=tuple(f"t_{n}" for n in targets))
    pairs = {n: (F.col("text"), F.col(f"t_{n}")) for n in targets}
    if not hasattr(score, "columns"):
        joined = keep("chunk_texts", joined.withColumn("ck", F.concat_ws("#", F.col(key).cast("string"), "idx")))
    scored = keep("chunks", _scored(joined, "ck", pairs, score).drop("ck", *[f"t_{n}" for n in targets]))
    best = scored.groupBy(key).agg(*[F.max(n).alias(f"best_{n}") for n in targets])
    return scored, best


def candidate_features(candidates: DataFrame, pages: DataFrame, flags: DataFrame, output_text: str | Column, as_of: str, fallback_query: str | Column = "", score: Callable = similarity.lexical, keep: Callable = _lazy) -> tuple[DataFrame, DataFrame]:
    """(features, chunks) of candidates; ``flags`` is cited_flags of them, ``score`` a pair operator
    (``similarity.scorer``).  Of one run the answer and the query to fall back on are texts; of many
    they are columns of ``candidates``, whose ids then name the run."""
    answer, fallback = (F.lit(x) if isinstance(x, str) else x for x in (output_text, fallback_query))
    rows = candidates.join(flags.select("candidate_id", "cited", "weak_domain_match", "match_type", "strong_match"), "candidate_id", "left")
    rows = keep("candidate_texts", _page_columns(rows.withColumn("query", best_query(F.col("queries"), fallback)), pages)).withColumn("p_md", _markdown())
    used = text.used_text(F.col("p_text"))
    out = _scored(rows, "candidate_id", {
        "title_query_sim": (F.col("title"), F.col("query")), "snippet_query_sim": (F.col("snippet"), F.col("query")),
        "page_query_sim": (F.nullif(used, F.lit("")), F.col("query")), "page_output_sim": (F.nullif(used, F.lit("")), answer)}, score)
    chunks, best = chunk_scores(rows, "candidate_id", {"output_sim": answer, "query_sim": F.col("query")}, score, keep)
    best = best.withColumnsRenamed({"best_output_sim": "max_chunk_output_sim", "best_query_sim": "max_chunk_query_sim"})
    official = classify.institutional(F.col("url"))
    out = out.withColumns({
        "serp_rank": F.col("best_rank"), "source_type": classify.source_type(F.col("url")), "institutional_official": official, "official_source": official,
        "brand_official_candidate": classify.brand_candidate(F.col("url"), F.col("title"), F.col("query"), answer),
        "freshness_days": F.when(F.col("p_text") != "", text.freshness_days(text.parse_date(F.col("p_date")), F.lit(as_of)))})
    return out.drop(*_TEXTS).join(best, "candidate_id", "left"), chunks


def source_features(sources: DataFrame, pages: DataFrame, as_of: str, score: Callable = similarity.lexical, keep: Callable = _lazy) -> tuple[DataFrame, DataFrame]:
    """(features, chunks) of export sources with their record's context (flatten_sources)."""
    asked = F.coalesce(F.nullif(F.col("prompt"), F.lit("")), F.get("web_search_query", F.lit(0)), F.lit(""))
    rows = keep("source_texts", _page_columns(sources.withColumn("prompt", asked).withColumn("cited", F.col("cited_label")), pages)).withColumn("p_md", _markdown())
    used = F.nullif(text.used_text(F.col("p_text")), F.lit(""))
    out = _scored(rows, "source_id", {
        "title_prompt_similarity": (F.col("title"), F.col("prompt")), "description_prompt_similarity": (F.col("description"), F.col("prompt")),
        "page_prompt_similarity": (used, F.col("prompt")), "page_answer_similarity": (used, F.col("answer_text"))}, score)
    chunks, best = chunk_scores(rows, "source_id", {"prompt_sim": F.col("prompt"), "answer_sim": F.col("answer_text")}, score, keep)
    best = best.withColumnsRenamed({"best_prompt_sim": "max_chunk_prompt_similarity", "best_answer_sim": "max_chunk_answer_similarity"})
    # A page's date, even one that cannot be read, takes the place of the source's.
    dated = F.when((F.col("p_text") != "") & (F.coalesce("p_date", F.lit("")) != ""), F.col("p_date")).otherwise(F.col("date_published"))
    official = classify.institutional(F.col("url"))
    out = out.withColumns({
        "source_type": classify.source_type(F.col("url")), "institutional_official": official, "official_source": official,
        "brand_official_candidate": classify.brand_candidate(F.col("url"), F.col("title"), F.col("prompt"), F.col("answer_text")),
        "freshness_days": text.freshness_days(text.parse_date(dated), F.lit(as_of)), "answer_text": F.substring("answer_text", 1, 1500)})
    return out.drop(*_TEXTS).join(best, "source_id", "left"), chunks


#: Similarity from which a heading counts as the prompt's, and the length of a page's beginning.
HEADING_MATCH, BEGINNING = 0.12, 500


def _prompt_signals(rows: DataFrame, score: Callable) -> DataFrame:
    """(source_id, heading_prompt_match, answer_like_text_in_first_500_chars) of rows with prompt, p_heads and p_begin."""
    asked = rows.where("prompt <> ''")
    heads = asked.select("source_id", "prompt", F.posexplode("p_heads").alias("i", "heading"))
    match = score(heads, ["source_id", "i"], F.col("prompt"), F.col("heading")).groupBy("source_id").agg((F.max("sim") >= HEADING_MATCH).alias("heading_prompt_match"))
    begin = asked.where("p_begin <> ''").select("source_id", "prompt", F.col("p_begin").alias("begin"))
    return score(begin, ["source_id"], F.col("prompt"), F.col("begin"), "answer_like_text_in_first_500_chars").join(match, "source_id", "full")


def _brand_facts(pages: DataFrame, client: list[str], competitor: list[str]) -> tuple[DataFrame, list[str]]:
    """(narrow rows of fetched pages, names of their flags): what brand pages need of a page's whole texts, row by
    row, so no text is shuffled or written.  Flags are null for a page without text."""
    md = F.col("p_md")
    rows = pages.where("status = 'success'").select("normalized_url", F.col("title").alias("p_title"), F.coalesce(F.nullif("text", F.lit("")), "markdown").alias("p_text"), F.col("markdown").alias("p_md"))
    same = md.eqNullSafe(F.col("p_text"))  # then it is folded once
    rows = rows.withColumns({"p_begin": F.substring("p_text", 1, BEGINNING), "p_heads": text.headings(md), "p_other": F.when(~same, md), "has_text": F.col("p_text").isNotNull(), "same": same}).drop("p_md")
    folded = {"n_title": F.col("p_title"), "n_text": F.col("p_text"), "n_other": F.col("p_other"), "n_heads": F.array_join("p_heads", " ")}
    rows = rows.select("normalized_url", "p_begin", "p_heads", "has_text", "same", *[text.fold(c).alias(n) for n, c in folded.items()])
    # What a generator gives is not put into the many rules that look at it: the texts are made once.
    rows = rows.select("*", F.inline(F.array(F.struct(F.when(F.col("same"), F.col("n_text")).otherwise(F.col("n_other")).alias("n_md"), F.concat_ws("\n", "n_title", "n_heads", "n_text").alias("n_page")))))
    rows = rows.select("*", F.inline(F.array(F.struct(text.headings(F.col("n_md")).alias("m_heads")))))
    rows = rows.select("*", F.inline(F.array(F.struct(F.lower(classify.all_words(F.col("n_title"), F.col("n_text"), F.col("n_md"), F.col("m_heads"))).alias("n_all")))))
    flags = classify.content_flags(F.col("n_title"), F.col("n_text"), F.col("n_md"), F.lit(""), F.lit(""), ascii_only=True, everything=F.col("n_all"), heads=F.col("m_heads"))
    del flags["title_contains_intent_terms"]  # the source's, not the page's
    found = {n: text.detect_terms(F.col("n_page"), terms, ascii_only=True).alias(n) for n, terms in (("p_client", client), ("p_competitor", competitor))}
    return rows.select("normalized_url", "p_begin", "p_heads", "has_text", "n_title", *found.values(), *[F.when(F.col("has_text"), v).alias(k) for k, v in flags.items()]), list(flags)


def _either(terms: list[str], *found: str) -> Column:
    """Those of ``terms``, in their order, that are in one of the columns of found terms."""
    has = lambda t: [F.coalesce(F.array_contains(c, t), F.lit(False)) for c in found]
    return F.filter(F.array(*[F.lit(t) for t in terms if t]).cast("array<string>"), lambda t: F.greatest(*has(t)))


def brand_pages(features: DataFrame, pages: DataFrame, client: list[str], competitor: list[str], score: Callable = similarity.lexical, keep: Callable = _lazy) -> DataFrame:
    """Features of sources that name a client or competitor term, with content flags and page type.  Terms are
    looked for in all that is shown of a source and in the whole text of its page."""
    facts, flags = _brand_facts(pages, client, competitor)
    rows = features.join(keep("brand_facts", facts), "normalized_url", "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    shown = F.concat_ws("\n", *[some(c) for c in ("url", "normalized_url", "domain", "title", "description")])
    found = lambda terms: text.detect_terms(F.col("n_shown"), terms, ascii_only=True)
    rows = rows.withColumn("n_shown", text.fold(shown)).withColumns({"s_client": found(client), "s_competitor": found(competitor)})
    rows = rows.withColumns({"client_terms_found": _either(client, "s_client", "p_client"), "competitor_terms_found": _either(competitor, "s_competitor", "p_competitor")})
    rows = rows.withColumns({"is_client_source": F.size("client_terms_found") > 0, "is_competitor_source": F.size("competitor_terms_found") > 0}).where("is_client_source OR is_competitor_source")
    intent = F.col("intent") if "intent" in features.columns else F.lit("")
    rows = rows.withColumn("title_contains_intent_terms", F.when(F.col("has_text"), classify.intent_in_title(F.col("n_title"), text.fold(intent), ascii_only=True)))
    # Flags come after what was found.
    made = ["client_terms_found", "competitor_terms_found", "is_client_source", "is_competitor_source", *flags, "title_contains_intent_terms"]
    rows = keep("brand_rows", rows.select(*[c for c in rows.columns if c in features.columns], *made, "has_text", "p_heads", "p_begin"))
    if "prompt" in rows.columns:
        rows = rows.join(_prompt_signals(rows.select("source_id", "prompt", "p_heads", "p_begin"), score), "source_id", "left")
        rows = rows.withColumn("heading_prompt_match", F.when(F.col("has_text"), F.coalesce("heading_prompt_match", F.lit(False))))
    kind = classify.page_type(F.col("url"), F.col("source_type"), {k: F.coalesce(F.col(k), F.lit(False)) for k in flags})
    return rows.withColumn("page_type", F.when(F.col("has_text"), kind).otherwise("unknown")).drop("has_text", "p_heads", "p_begin")
