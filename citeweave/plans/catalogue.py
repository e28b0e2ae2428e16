"""All queries of the library (without the optional subpackage) and their SQL."""

from __future__ import annotations

from citeweave.plans import queries_audit, queries_brand, queries_extra, queries_landed, queries_stats, queries_text, queries_urls, queries_views, queries_whole

MODULES = (queries_urls, queries_stats, queries_text, queries_audit, queries_brand, queries_extra, queries_landed, queries_views, queries_whole)


def whole_counts(sql: str) -> str:
    """``count_if(p)`` as a filtered count: DuckDB's count_if is a 128-bit integer, Spark's a long."""
    out, at = [], 0
    while (i := sql.find("count_if(", at)) >= 0:
        end, depth = i + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:i], "count(*) FILTER (WHERE ", sql[i + len("count_if(") : end - 1], ")"]
        at = end
    return "".join([*out, sql[at:]])


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: whole_counts(s) for m in MODULES for k, s in m.ORACLE.items()}
