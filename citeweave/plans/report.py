"""Tables and reports.  Tables are written whole by Spark; a report renders aggregated tables on the
driver.  Of a table of more than ``HEAD`` rows (raw rows: ``ROWS``) a report holds the first ones in the
order of all its columns, and says so with the number of rows and the name of the whole table."""

from __future__ import annotations

import html as _html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.plans.audit import CANDIDATE_FEATURES, POST_OUTPUT, SOURCE_FEATURES, Audit

HEAD, ROWS = 200, 1500
DISCLAIMER = "All findings are observable associations, not causal claims. More-only means shown but not cited; similarity is a proxy; post-output features may be circular."
SEARCH_COLUMNS = "candidate_id url domain cited match_type serp_rank source_type institutional_official brand_official_candidate title_query_sim snippet_query_sim page_query_sim page_output_sim word_count heading_count freshness_days".split()
EXPORT_COLUMNS = "record_id source_id url domain cited source_group intent topic source_type source_position observed_rank title_prompt_similarity description_prompt_similarity page_prompt_similarity page_answer_similarity word_count heading_count freshness_days".split()


# The section headings below are those of the audited tool's reports, whose readers look for them.


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that any table can be CSV."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def compact(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select([c for c in columns if c in df.columns])


def write_tables(audit: Audit, base: str, fmt: str = "csv") -> list[str]:
    """Every table of an audit, whole, under base/run_id/; returns the paths.  An empty table is its header."""
    out = []
    for name, df in audit.tables.items():
        path = f"{base}/{audit.run_id}/{name}"
        writer = _flat(df).write.mode("overwrite")
        writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
        out.append(path)
    return out


def _rows(df: DataFrame, limit: int = HEAD) -> tuple[list[str], list[list], int]:
    """(columns, rows, number of rows): all rows in the table's own order if they are at most ``limit``,
    else the first ``limit`` in the order of all columns."""
    flat = _flat(df)
    rows = flat.limit(limit + 1).collect()
    if len(rows) <= limit:
        return flat.columns, [list(r) for r in rows], len(rows)
    return flat.columns, [list(r) for r in flat.orderBy(*flat.columns).limit(limit).collect()], flat.count()


def _note(shown: int, total: int, name: str = "") -> str:
    """What is said under a table that is not shown whole."""
    if shown == total:
        return ""
    whole = f"; all of them are in the table {name}" if name else ""
    return f"(the first {shown:,} of {total:,} rows, ordered by all columns{whole})"


def table(df: DataFrame, name: str = "", limit: int = HEAD, empty: str = "_none_") -> str:
    """A Markdown table; ``empty`` where there is no row."""
    names, rows, total = _rows(df, limit)
    if not rows:
        return empty
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    text = "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
    note = _note(len(rows), total, name)
    return f"{text}\n\n_{note}_" if note else text


def csv_block(df: DataFrame, name: str = "", limit: int = ROWS) -> str:
    import csv
    import io

    names, rows, total = _rows(df, limit)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(names)
    w.writerows(rows)
    note = _note(len(rows), total, name)
    return f"```csv\n{out.getvalue()}```" + (f"\n\n_{note}_" if note else "")


def feature_dictionary(features: list[str]) -> list[dict]:
    return [{"feature": f, "phase": "post_output" if f in POST_OUTPUT else "pre_answer", "meaning": f.replace("_", " ").replace("sim", "similarity") if f.endswith("_sim") else f.replace("_", " ")} for f in features]


def _dictionary(features: list[str]) -> str:
    return "\n".join(f"- `{d['feature']}` ({d['phase']}): {d['meaning']}" for d in feature_dictionary(features))


GUIDE = "Compare the groups by the pre-answer tables first; read the post-output tables as overlap only; weigh every difference by its n; use the raw rows for correlations of your own."


def _common(audit: Audit, features: list[str], columns: list[str], other: str) -> list[str]:
    t = audit.tables
    return [
        "## Feature dictionary", _dictionary(features), f"## Cited vs {other} — pre-answer signals (non-circular)", table(t["group_compare"].where("phase = 'pre_answer'")),
        f"## Cited vs {other} — post-output overlap (may be circular)", table(t["group_compare"].where("phase = 'post_output'")), "## Feature ↔ citation correlation (point-biserial)", table(t["correlation"]),
        "## Source-type breakdown", table(t["source_breakdown"]), "## Official signals (institutional vs brand-candidate)", table(t["official"]), "## How to analyze this", GUIDE,
        "## Limitations", DISCLAIMER, "## Raw per-source data (CSV)", csv_block(compact(t["features"], columns), "features"),
    ]


def search_report(audit: Audit, prompt: str = "") -> str:
    t = audit.tables
    head = [f"# Search audit {audit.run_id}", "## Prompt", prompt or "_none_", "## Headline metrics", table(t["funnel"]), "## Observed search queries", table(t["queries"], "queries"), "## Citation recall@K (three variants)", table(t["recall"]), "## Match-type counts", table(t["tiers"]), "## Unmatched citations", table(t["unmatched"], "unmatched"), "## Insights", table(t["insights"], "insights")]
    return "\n\n".join([*head, *_common(audit, CANDIDATE_FEATURES, SEARCH_COLUMNS, "non-cited")]) + "\n"


def export_report(audit: Audit) -> str:
    t = audit.tables
    parts = [f"# Answer export audit {audit.run_id}", "## Sample sizes", table(t["summary"]), "## Questions", table(t["questions"], "questions"), "## Top domains — cited", table(t["top_domains_cited"]), "## Top domains — more-only", table(t["top_domains_more"])]
    if "intent_pivot" in t:
        parts += ["## Intent × Source Type — counts (all surfaced)", table(t["intent_pivot"]), "## Intent × Source Type — row % within intent", table(t["intent_share"]), "## Cited source types by intent", table(t["intent_cited"], "intent_cited"), "## More-only source types by intent", table(t["intent_more"], "intent_more"), "## Per-intent cited composition", table(t["intent_summary"]),
                  "## Expected vs actual cited source types (heuristic)", table(t["expected"])]
    if "brand_overall" in t:
        parts.append(brand_report(audit))
    return "\n\n".join([*parts, *_common(audit, SOURCE_FEATURES, EXPORT_COLUMNS, "more-only")]) + "\n"


def brand_report(audit: Audit) -> str:
    t = audit.tables
    return "\n\n".join([
        "## Non-branded Brand Visibility Audit", "### Overall visibility (denominator = non-branded prompts)", table(t["brand_overall"]), "### Visibility by intent", table(t["brand_by_intent"]), "### Client vs competitor", table(t["brand_versus"]),
        "### Example prompts", table(t["brand_examples"]), "### Content features associated with cited vs more-only pages", table(t["brand_compare"].where("grp = 'all'")), "### Position-controlled content comparison", table(t["brand_positions"].where("grp = 'all'")),
    ])


def batch_report(audit: Audit) -> str:
    t = audit.tables
    level = lambda n: table(t["aggregate"].where(F.col("level") == n))
    runs = ["## Runs", table(t["runs"], "runs")] if "runs" in t else []
    return "\n\n".join(["# Batch audit", "## Sample sizes", table(t["sample"]), *runs, "## Recall@K (averaged across runs)", table(t["recall"]), "## Cited vs non-cited (pooled across prompts)", level("overall"), "## Rank test and interval", table(t["group_stats"]),
                        "## Source-type breakdown (pooled)", table(t["source_breakdown"]), "## Observable patterns", table(t["patterns"]), "## By topic", level("topic"), "## By intent", level("intent"), "## Limitations", DISCLAIMER]) + "\n"


def analysis_json(audit: Audit) -> str:
    """Tables and raw rows as one JSON text; intent and brand parts where they exist.  ``not_whole`` names
    those of which only the first rows are here."""
    wanted = "summary funnel recall tiers group_compare correlation source_breakdown official questions intent_summary intent_source expected brand_overall brand_by_intent brand_versus".split()
    export, out, notes = "sources" in audit.tables, {}, {}

    def put(key: str, name: str, df: DataFrame) -> None:
        columns, rows, total = _rows(df, ROWS)
        out[key] = [dict(zip(columns, r)) for r in rows]
        if note := _note(len(rows), total, name):
            notes[key] = note

    for n in wanted:
        if n in audit.tables:
            put(n, n, audit.tables[n])
    out["feature_dictionary"] = feature_dictionary(SOURCE_FEATURES if export else CANDIDATE_FEATURES)
    put("sources", "features", compact(audit.tables["features"], EXPORT_COLUMNS if export else SEARCH_COLUMNS))
    out["not_whole"] = notes
    out["disclaimer"] = DISCLAIMER
    return json.dumps(out, ensure_ascii=False, default=str)


def html_report(audit: Audit, names: list[str] | None = None) -> str:
    parts = [f"<h1>Audit {_html.escape(audit.run_id)}</h1><p>{DISCLAIMER}</p>"]
    for name in names or [n for n in audit.tables if n not in ("features", "chunks", "serp", "sources", "records", "candidates", "matches")]:
        columns, rows, total = _rows(audit.tables[name])
        cells = lambda values, tag: "".join(f"<{tag}>{_html.escape('' if v is None else str(v))}</{tag}>" for v in values)
        parts.append(f"<h2>{_html.escape(name)}</h2><table><tr>{cells(columns, 'th')}</tr>" + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows) + f"</table><p>{'' if rows else 'none'}{_note(len(rows), total, name)}</p>")
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Audit</title></head><body>" + "".join(parts) + "</body></html>"


def write_all(audit: Audit, base: str, report: str) -> list[str]:
    """All tables, the report (Markdown and HTML) and the JSON bundle; texts go through Spark's writer to any store."""
    spark = next(iter(audit.tables.values())).sparkSession
    out = write_tables(audit, base)
    for name, text in (("report_md", report), ("report_html", html_report(audit)), ("analysis_json", analysis_json(audit))):
        path = f"{base}/{audit.run_id}/{name}"
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        out.append(path)
    return out
