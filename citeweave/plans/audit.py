"""The two audits and the batch over landed tables.

What several tables are derived from is a stage: written once to the shared folder and read back
(``citeweave.stages``), so an audit runs its stages when it is called, and every table's plan begins at
the files of a stage.  ``base`` names a folder in which stages last: an audit with the same inputs
takes them up again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions.similarity import lexical, scorer
from citeweave.functions.text import detect_terms, fold
from citeweave.operators import batch, brand, compare, features, intent, matching, profile, questions, stats
from citeweave.stages import Keep, Stages, plain
from citeweave.sources import export, landed, manifest

CANDIDATE_FEATURES = "serp_rank title_query_sim snippet_query_sim page_query_sim max_chunk_query_sim word_count char_count heading_count freshness_days page_output_sim max_chunk_output_sim".split()
SOURCE_FEATURES = (
    "title_prompt_similarity description_prompt_similarity page_prompt_similarity max_chunk_prompt_similarity word_count char_count heading_count freshness_days "
    "source_position observed_rank page_answer_similarity max_chunk_answer_similarity"
).split()
#: Features that are known only after the answer; they may be circular, since the answer can come from cited pages.
POST_OUTPUT = {"page_output_sim", "max_chunk_output_sim", "page_answer_similarity", "max_chunk_answer_similarity"}
CONTENT_FEATURES = (
    "has_faq has_step_by_step has_contact_info has_location_info has_price_or_package has_opening_hours has_booking_or_appointment has_phone_number has_email has_author "
    "has_reviewer has_published_date has_updated_date has_schema has_table has_bullets has_many_headings title_contains_intent_terms "
    "heading_prompt_match answer_like_text_in_first_500_chars"
).split()


class AuditError(RuntimeError):
    """A landed answer that no later stage can use."""


@dataclass
class Audit:
    """Named result tables of one audit."""

    run_id: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    stages: Stages | None = None

    def release(self) -> None:
        """Delete the stages of an audit without a base; its tables cannot be read after that."""
        if self.stages:
            self.stages.remove()

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def analysis(rows: DataFrame, numeric: list[str], sim: str, keep: Keep = plain) -> dict[str, DataFrame]:
    phase = F.when(F.col("feature").isin(*POST_OUTPUT), "post_output").otherwise("pre_answer")
    return {
        "group_compare": keep("group_compare", compare.group_compare(rows, numeric).withColumn("phase", phase)), "source_breakdown": compare.source_breakdown(rows), "official": compare.official_compare(rows),
        "correlation": compare.correlation_with_cited(rows, numeric).withColumn("phase", phase), "length_similarity": compare.length_similarity_correlation(rows, "word_count", sim),
    }


def _embedder(fn: Callable | None) -> object:
    """What stands for a function of vectors in a stage's key: its ``cache_key``, else nothing that comes again."""
    return fn and getattr(fn, "cache_key", uuid.uuid4().hex)


def search_audit(run_id: str, search_rows: DataFrame, citations: DataFrame, pages: DataFrame, output_text: str, as_of: str, prompt: str = "", method: str = "lexical", embed_fn: Callable | None = None, base: str | None = None, suffix_rules: DataFrame | None = None) -> Audit:
    """Grounded answer against the search results: match, recall, features, analysis.  ``method`` and
    ``embed_fn`` choose the similarity (``similarity.scorer``), ``suffix_rules`` the registrable domains."""
    if not output_text and citations.isEmpty():
        raise AuditError("the landed answer has no text and no citation")
    stages = Stages(search_rows.sparkSession, base, {"search": search_rows, "citations": citations, "pages": pages, "rules": suffix_rules}, output_text=output_text, as_of=as_of, prompt=prompt, method=method, embed_fn=_embedder(embed_fn))
    keep = stages.keep
    candidates = keep("candidates", matching.unique_candidates(search_rows, rules=suffix_rules))
    matches = keep("matches", matching.match_citations(citations, candidates, pages, rules=suffix_rules))
    flagged = keep("flagged", matching.cited_flags(candidates, matches))
    rows, chunks = features.candidate_features(candidates, pages, flagged, output_text, as_of, prompt, scorer(method, embed_fn), keep)
    rows = keep("features", rows)
    tables = {"serp": search_rows, "candidates": candidates, "matches": matches, "recall": matching.recall_at_k(matches), "tiers": matching.tier_table(matches), "flows": profile.flow_edges(flagged, prompt), "unmatched": matching.unmatched(matches), "features": rows, "chunks": chunks, "queries": matching.observed_queries(search_rows)}
    tables |= analysis(rows, CANDIDATE_FEATURES, "page_output_sim", keep) | {"funnel": compare.funnel(rows)}
    tables["insights"] = profile.insights(tables["group_compare"], tables["official"], rows)
    return Audit(run_id, tables, stages)


def export_audit(run_id: str, raw: DataFrame, pages: DataFrame, as_of: str, manifest_rows: DataFrame | None = None, client: list[str] | None = None, competitor: list[str] | None = None, clusters: int = 0, method: str = "lexical", embed_fn: Callable | None = None, base: str | None = None) -> Audit:
    """Export of answers: cited against shown but not cited, with intents and brands where a manifest gives them.
    ``method`` and ``embed_fn`` choose the similarity (``similarity.scorer``)."""
    score = scorer(method, embed_fn)
    stages = Stages(raw.sparkSession, base, {"raw": raw, "pages": pages, "manifest": manifest_rows}, as_of=as_of, method=method, embed_fn=_embedder(embed_fn))
    keep = stages.keep
    records = keep("records", export.parse_records(raw))
    sources = keep("sources", export.extract_sources(records))
    if manifest_rows is not None:
        records = keep("records_with_intents", manifest.apply_manifest(records, manifest.parse_manifest(manifest_rows)))
    rows, chunks = features.source_features(export.flatten_sources(records, sources), pages, as_of, score, keep)
    rows = keep("features", rows)
    asked = questions.question_rows(rows)
    tables = {"records": records, "sources": sources, "run": export.run_summary(records, sources), "warnings": export.record_warnings(records), "features": rows, "chunks": chunks, "summary": compare.summary(rows), "questions": keep("questions", questions.question_table(asked))}
    tables |= analysis(rows, SOURCE_FEATURES, "page_answer_similarity", keep)
    tables |= {"top_domains_cited": compare.top_domains(rows, 1), "top_domains_more": compare.top_domains(rows, 0)}
    if clusters:
        members = keep("clusters", questions.cluster_questions(asked, clusters), clusters)
        tables["clusters"] = questions.cluster_summary(asked, members)
    if manifest_rows is not None:
        ordered = rows.withColumn("ord", F.struct(*[F.col(f"seq.{c}") for c in ("prio", "pos")]))
        tables |= {"intent_source": intent.intent_source_long(rows), "intent_pivot": intent.intent_pivot(rows), "intent_share": intent.intent_row_share(rows), "intent_cited": intent.intent_group_pivot(rows, "cited"), "intent_more": intent.intent_group_pivot(rows, "more_only"), "intent_summary": intent.intent_summary(rows),
                   "expected": intent.expected_vs_actual(ordered), "unmatched_prompts": manifest.unmatched_prompts(records)}
        client, competitor = (sorted({*(given or []), *listed_terms(records, c)}) for given, c in ((client, "client_terms"), (competitor, "competitor_terms")))
    if client or competitor:
        tables |= brand_tables(records, sources, rows, pages, client or [], competitor or [], score, keep)
    return Audit(run_id, tables, stages)


def listed_terms(records: DataFrame, column: str) -> list[str]:
    """The distinct terms of a manifest's lists; terms are typed by hand, so they are few whatever the records."""
    return [r[0] for r in records.select(F.explode(column).alias("term")).distinct().collect()]


def brand_tables(records: DataFrame, sources: DataFrame, rows: DataFrame, pages: DataFrame, client: list[str], competitor: list[str], score: Callable = lexical, keep: Keep = plain) -> dict[str, DataFrame]:
    """Brand visibility over an export audit; the term lists are the manifest's, a handful of terms."""
    termed = lambda name, df: keep(name, df, client, competitor)
    named = termed("brand_pages", features.brand_pages(rows, pages, client, competitor, score, termed))
    flag = named.select("source_id", F.col("is_client_source").alias("client"), F.col("is_competitor_source").alias("competitor"))
    marked = sources.select("source_id", "record_id", F.col("cited_label").alias("cited")).join(flag, "source_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("client", "competitor")})
    r = records
    for c, default in (("topic", F.lit("")), ("intent", F.lit("Unspecified")), ("prompt_is_nonbranded", F.lit(None).cast("boolean"))):
        if c not in r.columns:
            r = r.withColumn(c, default)
    found = lambda c, t: detect_terms(F.col(c), t, ascii_only=True)
    r = r.withColumns({"nonbranded": F.col("prompt_is_nonbranded"), "n_prompt": fold(F.col("prompt")), "n_answer": fold(F.col("answer_text"))})
    r = r.withColumns({"prompt_client": found("n_prompt", client), "answer_client": found("n_answer", client), "answer_competitor": found("n_answer", competitor)}).drop("n_prompt", "n_answer")
    rec = termed("brand_records", brand.brand_records(r, marked))
    numeric = [f for f in [*CONTENT_FEATURES, *SOURCE_FEATURES] if f in named.columns]
    if "topic" not in named.columns:
        named = named.withColumns({"topic": F.lit(""), "intent": F.lit("Unspecified")})
    return {"brand_records": rec, "brand_by_intent": brand.by_intent(rec), "brand_overall": brand.overall(rec), "brand_versus": brand.client_vs_competitor(rec), "brand_examples": brand.examples(rec), "brand_pages": named,
            "brand_compare": termed("brand_compare", brand.cited_vs_more_only(named, numeric)), "brand_positions": termed("brand_positions", brand.position_controlled(named, numeric))}


def batch_audit(runs: dict[str, Audit], tags: dict[str, dict[str, str]], base: str | None = None) -> Audit:
    """Pooled features of several search audits with their topic and intent; all rollups in one pass each."""
    parts, recalls = [], []
    for run_id, audit in runs.items():
        tag = tags.get(run_id, {})
        parts.append(audit.features.withColumns({"run_id": F.lit(run_id), "topic": F.lit(tag.get("topic", "")), "intent": F.lit(tag.get("intent", ""))}))
        recalls.append(audit.recall.withColumn("run_id", F.lit(run_id)))
    return pooled_audit("batch", batch.pool(parts), batch.pool(recalls), base)


def pooled_audit(run_id: str, rows: DataFrame, recalls: DataFrame, base: str | None = None, keep: Keep | None = None) -> Audit:
    """Rollups of pooled feature rows (run_id, topic, intent, features) and recalls (run_id, mode, k, recall).
    ``keep``: of the audit that has made the rows a stage already."""
    stages = None if keep else Stages(rows.sparkSession, base, {"rows": rows, "recalls": recalls})
    pooled = rows if keep else stages.keep("features", rows)
    keep = keep or stages.keep
    rollup = keep("aggregate", batch.batch_aggregate(pooled, CANDIDATE_FEATURES))
    group = keep("group_stats", stats.group_stats(pooled, CANDIDATE_FEATURES))
    tables = {"features": pooled, "aggregate": rollup, "recall": batch.recall_average(recalls), "sample": batch.sample_sizes(pooled), "group_stats": group}
    tables |= analysis(pooled, CANDIDATE_FEATURES, "page_output_sim", keep)
    tables["patterns"] = batch.cite_patterns(pooled, rollup, tables["correlation"])
    return Audit(run_id, tables, stages)


def batch_search_audit(batch_id: str, runs: DataFrame, search_rows: DataFrame, citations: DataFrame, pages: DataFrame, as_of: str, method: str = "lexical", embed_fn: Callable | None = None, base: str | None = None, suffix_rules: DataFrame | None = None) -> Audit:
    """Any number of search audits as one: ``run_id`` is a key of every operator, so stages and plans are as
    many for two runs as for many thousands.

    ``runs``: run_id, prompt, output_text and, where known, topic, intent and error; ``search_rows`` and
    ``citations`` have a run_id; pages are shared.  A run that failed, or whose answer is empty, is a row
    of the table ``runs`` with its error, and the others go on.
    """
    stages = Stages(runs.sparkSession, base, {"runs": runs, "search": search_rows, "citations": citations, "pages": pages, "rules": suffix_rules}, as_of=as_of, method=method, embed_fn=_embedder(embed_fn))
    keep, by = stages.keep, ["run_id"]
    for c in ("topic", "intent"):
        filled = F.nullif(F.trim(F.col(c)), F.lit("")) if c in runs.columns else F.lit(None).cast("string")
        runs = runs.withColumn(c, F.coalesce(filled, F.lit("Custom")))
    checked = keep("checked", batch.run_errors(runs, citations))
    good = checked.where("error IS NULL").select("run_id", "prompt", "output_text", "topic", "intent")
    only = lambda df: df.join(good.select("run_id"), "run_id", "left_semi")
    # Candidates are told apart by run from here on: their ids name it.
    named = F.concat_ws("/", F.col("run_id").cast("string"), "candidate_id")
    candidates = keep("candidates", matching.unique_candidates(only(search_rows), by, suffix_rules).withColumn("candidate_id", named))
    matches = keep("matches", matching.match_citations(only(citations), candidates, pages, by, suffix_rules))
    flagged = keep("flagged", matching.cited_flags(candidates, matches, by))
    asked = candidates.join(good, "run_id")
    rows, chunks = features.candidate_features(asked, pages, flagged, F.coalesce("output_text", F.lit("")), as_of, F.col("prompt"), scorer(method, embed_fn), keep)
    rows = keep("features", rows.drop("output_text"))
    recall = matching.recall_at_k(matches, by)
    pooled = pooled_audit(batch_id, rows, recall, keep=keep)
    tables = {"runs": batch.run_overview(checked, rows, matches, recall), "candidates": candidates, "matches": matches, "recall_by_run": recall, "chunks": chunks}
    return Audit(batch_id, tables | pooled.tables, stages)


def landed_search_audit(run_id: str, serp_items: DataFrame, page_items: DataFrame, answer_items: DataFrame, as_of: str, top_k: int = 20) -> Audit:
    """search_audit over landed service output: one grounded answer, its results, its pages."""
    answers, citations, queries = landed.answer_rows(answer_items)
    if not landed.usable(answers, citations, queries):
        raise AuditError("the landed answer has no text, citation or query")
    text = answers.select("output_text").first()[0]
    first = queries.orderBy("item_ord", "pos").first()
    return search_audit(run_id, landed.search_rows(serp_items, top_k), citations, landed.page_rows(page_items), text, as_of, first["query"] if first else "")
