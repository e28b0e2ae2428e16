"""Inputs of charts: scaled values, box statistics, mean profiles, ordered candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.operators.ordered import quantiles


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 over the (few) rows shown; 0.5 where a column is constant or null."""
    w = W.partitionBy()

    def scaled(c: str):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.coalesce(F.when(hi > lo, F.round((F.col(c) - lo) / (hi - lo), 4)), F.lit(0.5))

    return rows.withColumns({c: scaled(c) for c in columns})


def box_statistics(rows: DataFrame, key: str, value: str) -> DataFrame:
    return quantiles(rows, [key], {"q1": 0.25, "mid": 0.5, "q3": 0.75}, value).select(key, "n", "low", "q1", "mid", "q3", "high")


def average_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(c) for c in columns])


def display_order(candidates: DataFrame, k: int) -> DataFrame:
    """Fetched ones first, then by rank."""
    return candidates.orderBy(F.desc("scrape_success"), "best_rank", "ord").limit(k)


def best_chunk(chunks: DataFrame, id_col: str, score: str) -> DataFrame:
    """The chunk of highest score of each text; the earliest of ties."""
    best = F.max_by(F.struct("idx", "heading", "text", score), F.struct(F.col(score), -F.col("idx")))
    return chunks.groupBy(id_col).agg(best.alias("b")).select(id_col, "b.*")


def long_form(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys.., series, value) of wide rows: what grouped bars are drawn from."""
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("series"), F.col(v).cast("double").alias("value")) for v in values]))
    return rows.select(*keys, cells.alias("x")).select(*keys, "x.*")


def fetch_split(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count_if(F.col("status") == "success").alias("n_ok"), F.count_if(F.col("status") != "success").alias("n_failed"))


def most_similar_uncited(rows: DataFrame, sim: str, floor: float = 0.3) -> DataFrame:
    """The shown but not cited row whose overlap with the answer is highest, if above ``floor``; the earliest of ties."""
    return rows.where((F.col("cited") == 0) & (F.col(sim) > floor)).agg(F.min_by("domain", F.struct(-F.col(sim), F.col("ord"))).alias("domain"), F.max(sim).alias(sim))


def flow_edges(candidates: DataFrame, fallback: str = "", k: int = 16) -> DataFrame:
    """(source, target, n): edges of the k best-ranked candidates from their best query to their domain, and from there to cited or not."""
    from citeweave.operators.matching import best_query

    top = candidates.withColumn("query", best_query(F.col("queries"), F.lit(fallback))).orderBy("best_rank", "ord").limit(k)
    end = F.when(F.col("cited") == 1, "cited").otherwise("non-cited")
    edges = F.explode(F.array(F.struct(F.lit("query").alias("level"), F.col("query").alias("source"), F.col("domain").alias("target")), F.struct(F.lit("domain").alias("level"), F.col("domain").alias("source"), end.alias("target"))))
    return top.select(edges.alias("e")).groupBy("e.level", "e.source", "e.target").agg(F.count("*").alias("n"))


def insights(compared: DataFrame, official: DataFrame, rows: DataFrame) -> DataFrame:
    """(part, text): sentences about ranks, similarity, official sources and overlap; parts without figures are left out."""
    of = lambda f: compared.where(F.col("feature") == f)
    rank = of("serp_rank").where("cited_median IS NOT NULL AND non_cited_median IS NOT NULL").select(F.lit(1).alias("part"), F.format_string(
        "[pre-answer] cited sites ranked %s (median %.1f against %.1f)", F.when(F.col("cited_median") < F.col("non_cited_median"), "higher").otherwise("lower or alike"), "cited_median", "non_cited_median").alias("text"))
    page = of("page_query_sim").where("delta IS NOT NULL").select(F.lit(2).alias("part"), F.format_string(
        "[pre-answer] cited pages were %s to the query (%.4f against %.4f)", F.when(F.col("delta") > 0, "more similar").otherwise("no more similar"), "cited_mean", "non_cited_mean").alias("text"))
    each = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("grp", "n", "cite_rate"))), lambda x: F.format_string("%s %.4f (n=%d)", x["grp"], x["cite_rate"], x["n"])), ", ")
    rates = official.agg(F.count("*").alias("k"), each.alias("t")).where("k > 0").select(F.lit(3).alias("part"), F.concat(F.lit("[pre-answer] cite rates: "), "t").alias("text"))
    overlap = of("page_output_sim").where("delta IS NOT NULL").select(F.lit(4).alias("part"), F.format_string(
        "[post-output, circular] overlap of pages with the answer: %.4f cited, %.4f not cited", "cited_mean", "non_cited_mean").alias("text"))
    out = rank.unionByName(page).unionByName(rates).unionByName(overlap)
    if "page_output_sim" in rows.columns:
        high = most_similar_uncited(rows, "page_output_sim").where("domain IS NOT NULL")
        out = out.unionByName(high.select(F.lit(5).alias("part"), F.format_string("a page that is not cited overlaps with the answer all the same (%.4f, %s)", "page_output_sim", "domain").alias("text")))
    return out
