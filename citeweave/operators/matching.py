"""Candidates, citation matching in ordered tiers, and recall at K."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.functions.suffixes import with_registrable
from citeweave.functions.urls import is_redirect_wrapper, normalize_url, short_id, with_forms

# Tiers from strongest to weakest, those of each recall mode, the Ks.
TIERS = ("exact", "normalized", "final_redirect", "canonical", "amp_canonical", "domain_only", "no_match")
STRICT = TIERS[:3]
STRONG = TIERS[:5]
RECALL_KS = (5, 10, 20, 50)
NO_RANK = 999


def first_rows(df: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """One row a key: the first by ``order``.  A minimum of structs, so rows combine before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("r"))).alias("m")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"m.r.{c}").alias(c) for c in rest])


def unique_candidates(rows: DataFrame, by: list[str] | None = None, rules: DataFrame | None = None) -> DataFrame:
    """One row a normalised URL (``by``: and run) of (ord, query, rank, url, title, snippet, ...) search rows.

    First-seen identity, best rank, and title and snippet of the row that last improved the rank
    with a text of its own.  Only the first row of each rank can have improved it, so rows meet by URL
    and rank first: what a URL that stands in very many rows brings to one task is a row a rank, and the
    list of queries that is its result.  ``rules``: public-suffix rules (``functions.suffixes``); without
    them registrable domains follow a compact list.
    """
    by = by or []
    rows = with_forms(rows, "url", "normalized_url", "domain", "root_domain").where("normalized_url <> ''")
    if rules is not None:
        rows = with_registrable(rows.drop("root_domain"), "domain", "root_domain", rules)
    rows = rows.withColumn("rank", F.coalesce(F.nullif(F.col("rank"), F.lit(0)), F.lit(NO_RANK)))
    ranked = rows.groupBy(*by, "normalized_url", "rank").agg(
        F.min(F.struct("ord", "url", "domain", "root_domain", "title", "snippet")).alias("f"), F.collect_list(F.struct("ord", "query", "rank")).alias("q"))
    out = ranked.groupBy(*by, "normalized_url").agg(F.sort_array(F.collect_list(F.struct(F.col("f"), "rank"))).alias("steps"), F.sort_array(F.flatten(F.collect_list("q"))).alias("q"))
    seen = F.struct(F.lit(None).cast("int").alias("best"), F.lit("").alias("title"), F.lit("").alias("snippet"))
    own = lambda new, old: F.coalesce(F.nullif(new, F.lit("")), old)
    better = lambda s, x: F.when(s["best"].isNull() | (x["rank"] < s["best"]), F.struct(x["rank"].cast("int").alias("best"), own(x["f"]["title"], s["title"]).alias("title"), own(x["f"]["snippet"], s["snippet"]).alias("snippet"))).otherwise(s)
    out = out.withColumn("s", F.aggregate("steps", seen, better)).withColumn("first", F.col("steps")[0]["f"])
    queries = F.transform("q", lambda q: F.struct(q["query"].alias("query"), q["rank"].alias("rank")))
    return out.select(*by, "normalized_url", F.array_min(F.transform("steps", lambda x: x["rank"])).alias("best_rank"), F.col("first.ord").alias("ord"), F.col("s.title").alias("title"), F.col("s.snippet").alias("snippet"), queries.alias("queries"),
                      *[F.col(f"first.{c}").alias(c) for c in ("url", "domain", "root_domain")], short_id(F.col("normalized_url")).alias("candidate_id"))


def observed_queries(rows: DataFrame) -> DataFrame:
    """(query, n_results) of the searches behind a run, in the order of their first result."""
    found = rows.where("query <> ''").groupBy("query").agg(F.count("*").alias("n_results"), F.min("ord").alias("ord"))
    return found.orderBy("ord").select("query", "n_results")


def best_query(queries: Column, fallback: Column) -> Column:
    """Query of the least rank (first of ties), else the fallback."""
    ranked = F.transform(queries, lambda q, i: F.struct(q["rank"].alias("r"), i.alias("i"), q["query"].alias("q")))
    return F.coalesce(F.nullif(F.array_min(ranked)["q"], F.lit("")), fallback)


def distinct_citations(citations: DataFrame, by: list[str] | None = None, rules: DataFrame | None = None) -> DataFrame:
    """First citation of every normalised effective URL (``by``: and run); ``citations``: idx, raw_uri, resolved_url, title."""
    effective = F.coalesce(F.nullif(F.col("resolved_url"), F.lit("")), F.col("raw_uri"))
    rows = with_forms(citations.withColumn("citation_url", effective), "citation_url", "cnorm", "chost", "croot", "camp").where("cnorm <> ''")
    if rules is not None:
        rows = with_registrable(rows.drop("croot"), "chost", "croot", rules)
    rows = rows.drop("chost")
    return first_rows(rows, [*(by or []), "cnorm"], "idx")


def _segments(norm: Column) -> Column:
    path = F.regexp_extract(norm, r"^https://[^/?#]*([^?#]*)", 1)
    return F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/")


def closest_path(citations: DataFrame, candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., cnorm, weak_id, weak_url, weak_rank): per citation the candidate of its registrable domain
    that shares the most leading path segments, then ranks best, then came first.

    No pair join over a domain: every candidate is indexed once under each of its leading paths, with
    the best candidate kept; a citation looks up its own leading paths and takes the longest hit.
    """
    by = by or []
    prefixes = lambda seg: F.when(seg[0] == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(seg)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(seg, 1, k), "/")))))
    keyed = candidates.select(*by, "root_domain", F.explode(prefixes(_segments(F.col("normalized_url")))).alias("prefix"), F.struct("best_rank", "ord", "candidate_id", "url").alias("c"))
    index = keyed.groupBy(*by, "root_domain", "prefix").agg(F.min("c").alias("c"))
    asked = citations.select(*by, "cnorm", F.col("croot").alias("root_domain"), F.posexplode(prefixes(_segments(F.col("cnorm")))).alias("depth", "prefix"))
    met = asked.join(index, [*by, "root_domain", "prefix"]).groupBy(*by, "cnorm").agg(F.max_by("c", "depth").alias("c"))
    return met.select(*by, "cnorm", F.col("c.candidate_id").alias("weak_id"), F.col("c.url").alias("weak_url"), F.col("c.best_rank").alias("weak_rank"))


def match_citations(citations: DataFrame, candidates: DataFrame, pages: DataFrame | None = None, by: list[str] | None = None, rules: DataFrame | None = None) -> DataFrame:
    """One row a distinct citation (``by``: of each run) with its tier.  Every tier is a keyed candidate row; one equi-join
    finds all tiers of a citation and the strongest one is kept."""
    by = by or []
    cits = distinct_citations(citations, by, rules)
    target = F.struct(F.col("best_rank"), F.col("ord"), F.col("candidate_id"), F.col("url"))
    candidates = with_forms(candidates, "url", "__n", amp="camp").drop("__n")
    key = lambda df, tier, col: df.select(*by, F.lit(tier).alias("tier"), col.alias("key"), target.alias("c"))
    keys = key(candidates, 1, F.col("url")).unionByName(key(candidates, 2, F.col("normalized_url"))).unionByName(key(candidates, 4, F.col("camp")))
    if pages is not None:
        canonical = pages.where("canonical_url <> ''").select("normalized_url", normalize_url(F.col("canonical_url")).alias("canonical"))
        keys = keys.unionByName(key(candidates.join(canonical, "normalized_url"), 3, F.col("canonical")))
    keys = keys.groupBy(*by, "tier", "key").agg(F.min("c").alias("c"))
    ask = lambda tier, order, col: F.struct(F.lit(tier).alias("tier"), F.lit(order).alias("order"), col.alias("key"))
    asked = cits.select(*by, "cnorm", F.explode(F.array(ask(1, 0, F.col("citation_url")), ask(1, 1, F.col("raw_uri")), ask(2, 2, F.col("cnorm")), ask(3, 3, F.col("cnorm")), ask(4, 4, F.col("camp")))).alias("a")).select(*by, "cnorm", "a.*")
    strong = asked.join(keys, [*by, "tier", "key"]).groupBy(*by, "cnorm").agg(F.min(F.struct("order", "tier", "c")).alias("s"))
    out = cits.join(strong, [*by, "cnorm"], "left").join(closest_path(cits, candidates, by), [*by, "cnorm"], "left")
    tier, has = F.col("s.tier"), F.col("s").isNotNull()
    kind = F.when(tier == 1, "exact").when(tier == 2, F.when(is_redirect_wrapper(F.col("raw_uri")), "final_redirect").otherwise("normalized"))
    kind = kind.when(tier == 3, "canonical").when(tier == 4, "amp_canonical").when(F.col("weak_id").isNotNull(), "domain_only").otherwise("no_match")
    return out.select(
        *by, F.col("idx").alias("citation_index"), "citation_url", "raw_uri", "title", kind.alias("match_type"), has.alias("strong"),
        (~has & F.col("weak_id").isNotNull()).alias("weak_domain_match"), F.coalesce("s.c.candidate_id", "weak_id").alias("matched_candidate_id"),
        F.coalesce("s.c.url", "weak_url").alias("matched_url"), F.coalesce("s.c.best_rank", "weak_rank").alias("matched_rank"),
        F.col("s.c.best_rank").alias("strong_rank"), "weak_rank",
    )


def _recalled(mode: str, k: int) -> Column:
    kind, strong, weak = F.col("match_type"), F.col("strong_rank"), F.col("weak_rank")
    if mode == "domain_inclusive":
        hit = (kind.isin(*STRONG) & (strong <= k)) | ((kind == "domain_only") & (weak <= k))
    else:
        hit = kind.isin(*(STRICT if mode == "strict" else STRONG)) & (strong <= k)
    return F.coalesce(hit, F.lit(False))


def recall_at_k(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., mode, k, recall): one pass over the matches."""
    by = by or []
    cells = [(m, k) for m in ("strict", "canonical", "domain_inclusive") for k in RECALL_KS]
    sums = [F.count_if(_recalled(m, k)).alias(f"{m}_{k}") for m, k in cells]
    rows = matches.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(k).alias("k"), F.col(f"{m}_{k}").alias("hits")) for m, k in cells]))
    rate = F.coalesce(F.round(F.try_divide(F.col("x.hits"), F.col("n")), 4), F.lit(0.0))
    return rows.select(*by, "n", long.alias("x")).select(*by, "x.mode", "x.k", rate.alias("recall"))


def tier_counts(matches: DataFrame) -> DataFrame:
    """(match_type, n, rate) for every tier, zeros included."""
    rows = matches.agg(F.count("*").alias("total"), *[F.count_if(F.col("match_type") == t).alias(t) for t in TIERS])
    long = F.explode(F.array(*[F.struct(F.lit(t).alias("match_type"), F.col(t).alias("n")) for t in TIERS]))
    return rows.select("total", long.alias("x")).select("x.match_type", "x.n", F.coalesce(F.round(F.try_divide(F.col("x.n"), F.col("total")), 4), F.lit(0.0)).alias("rate"))


def tier_table(matches: DataFrame) -> DataFrame:
    """(match_type, n, rate, strength) of every tier, and a line for all of them."""
    kind = F.col("match_type")
    strength = F.when(kind == "domain_only", "weak").when(kind == "no_match", "").otherwise("strong")
    tiers = tier_counts(matches).withColumn("strength", strength)
    total = matches.agg(F.lit("TOTAL").alias("match_type"), F.count("*").alias("n"), F.when(F.count("*") > 0, 1.0).otherwise(0.0).alias("rate"), F.lit("").alias("strength"))
    return tiers.unionByName(total)


def unmatched(matches: DataFrame) -> DataFrame:
    return matches.where("match_type = 'no_match'").select("citation_index", "citation_url")


def cited_flags(candidates: DataFrame, matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``candidates`` with cited, weak_domain_match, match_type and strong_match by their strongest match."""
    by = by or []
    hits = matches.where("matched_candidate_id IS NOT NULL").groupBy(*by, F.col("matched_candidate_id").alias("candidate_id")).agg(
        F.max(F.col("strong").cast("int")).alias("cited"), F.max("weak_domain_match").alias("weak_domain_match"),
        F.min(F.struct((~F.col("strong")).alias("w"), "citation_index", "match_type")).alias("m"))
    out = candidates.join(hits, [*by, "candidate_id"], "left")
    return out.withColumns({"cited": F.coalesce("cited", F.lit(0)), "weak_domain_match": F.coalesce("weak_domain_match", F.lit(False)),
                            "match_type": F.coalesce("m.match_type", F.lit("no_match")), "strong_match": F.coalesce(F.col("cited") == 1, F.lit(False))}).drop("m")


def select_scrape_urls(candidates: DataFrame, scope: str, k: int = 12, selected: DataFrame | None = None) -> DataFrame:
    """Candidates to fetch: all, cited, selected (semi-join on normalized_url), or the top k by rank."""
    if scope == "cited":
        return candidates.where("cited = 1")
    if scope == "selected":
        return candidates.join(selected.select("normalized_url").distinct(), "normalized_url", "left_semi")
    return candidates.orderBy("best_rank", "ord").limit(k) if scope == "top_k" else candidates


def select_source_urls(sources: DataFrame, scope: str, selected: DataFrame | None = None) -> DataFrame:
    """First source of each normalised URL among those within the scope (the filter comes first)."""
    rows = sources.where("normalized_url <> ''")
    if scope in ("cited", "more_only"):
        rows = rows.where(F.col("cited_label") == (1 if scope == "cited" else 0))
    elif scope == "selected":
        rows = rows.join(selected.select("normalized_url").distinct(), "normalized_url", "left_semi")
    return first_rows(rows, "normalized_url", "ord")


def scrape_plan(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, to fetch): pages that the cache holds, and wanted URLs that it lacks."""
    return cache.join(wanted.select("normalized_url").distinct(), "normalized_url", "left_semi"), wanted.join(cache, "normalized_url", "left_anti")


def with_failures(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of all wanted URLs; what was asked for and did not come is a failed row."""
    missing = wanted.select("url", "normalized_url").join(pages, "normalized_url", "left_anti")
    return pages.unionByName(missing.withColumns({"status": F.lit("failed"), "error": F.lit("not returned")}), allowMissingColumns=True)
