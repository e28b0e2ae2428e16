import pytest
from pyspark.sql import functions as F

from citeweave.operators import matching as m

SERP = "ord long, query string, rank int, url string, title string, snippet string"
CITE = "idx long, raw_uri string, resolved_url string, title string"


@pytest.fixture()
def candidates(spark):
    rows = [(0, "q1", 1, "https://a.com/guide/one", "One", "s"), (1, "q1", 9, "https://a.com/other", "Other", "s"), (2, "q2", 2, "https://b.org/x", "B", "s"), (3, "q2", 1, "http://www.b.org/x?utm_source=z", "", "better")]
    return m.unique_candidates(spark.createDataFrame(rows, SERP))


def test_unique_candidates(candidates):
    rows = {r["normalized_url"]: r for r in candidates.collect()}
    b = rows["https://b.org/x"]
    assert (b["url"], b["best_rank"], b["title"], b["snippet"]) == ("https://b.org/x", 1, "B", "better")
    assert [q["rank"] for q in b["queries"]] == [2, 1]
    got = candidates.select(m.best_query(F.col("queries"), F.lit("-"))).collect()
    assert {r[0] for r in got} == {"q1", "q2"}


def test_tiers_and_recall(spark, candidates):
    cites = spark.createDataFrame([
        (0, "https://a.com/guide/one", None, ""), (1, "https://vertexaisearch.cloud.google.com/grounding-api-redirect/z", "https://www.b.org/x/", ""), (2, "https://a.com/guide/two", None, ""),
        (3, "https://nowhere.net/", None, ""), (4, "https://amp.b.org/x", None, ""), (5, "http://a.com/guide/one#again", None, "")], CITE)
    got = {r["citation_index"]: r for r in m.match_citations(cites, candidates).collect()}
    assert {i: r["match_type"] for i, r in got.items()} == {0: "exact", 1: "final_redirect", 2: "domain_only", 3: "no_match", 4: "amp_canonical"}
    assert got[2]["matched_url"] == "https://a.com/guide/one" and not got[2]["strong"] and got[2]["weak_domain_match"]
    matches = m.match_citations(cites, candidates)
    recall = {(r["mode"], r["k"]): r["recall"] for r in m.recall_at_k(matches).collect()}
    assert recall["strict", 10] == 0.4 and recall["canonical", 10] == 0.6 and recall["domain_inclusive", 10] == 0.8
    for mode in ("strict", "canonical", "domain_inclusive"):
        values = [recall[mode, k] for k in m.RECALL_KS]
        assert values == sorted(values)
    flags = {r["normalized_url"]: r["cited"] for r in m.cited_flags(candidates, matches).collect()}
    assert flags == {"https://a.com/guide/one": 1, "https://a.com/other": 0, "https://b.org/x": 1}
    assert sum(r["n"] for r in m.tier_counts(matches).collect()) == 5


def test_weak_match_is_never_cited(spark, candidates):
    cites = spark.createDataFrame([(0, "https://a.com/zzz", None, "")], CITE)
    assert m.cited_flags(candidates, m.match_citations(cites, candidates)).agg(F.sum("cited")).first()[0] == 0


def test_canonical_tier(spark, candidates):
    pages = spark.createDataFrame([("https://a.com/other", "https://canon.com/page")], "normalized_url string, canonical_url string")
    cites = spark.createDataFrame([(0, "https://canon.com/page", None, "")], CITE)
    assert m.match_citations(cites, candidates, pages).first()["match_type"] == "canonical"


def test_empty_inputs(spark, candidates):
    none = spark.createDataFrame([], CITE)
    assert m.match_citations(none, candidates).count() == 0
    assert {r["recall"] for r in m.recall_at_k(m.match_citations(none, candidates)).collect()} == {0.0}


def test_scrape_plan(spark):
    wanted = spark.createDataFrame([("u1", "n1"), ("u2", "n2")], "url string, normalized_url string")
    cache = spark.createDataFrame([("n1", "success")], "normalized_url string, status string")
    hits, todo = m.scrape_plan(wanted, cache)
    assert hits.count() == 1 and [r["normalized_url"] for r in todo.collect()] == ["n2"]
    assert {r["status"] for r in m.with_failures(wanted, cache).collect()} == {"success", "failed"}


def test_source_scope_filters_before_dedup(spark):
    rows = spark.createDataFrame([(0, "u0", "n", 0), (1, "u1", "n", 1)], "ord long, url string, normalized_url string, cited_label int")
    assert [r["url"] for r in m.select_source_urls(rows, "cited").collect()] == ["u1"]
    assert [r["url"] for r in m.select_source_urls(rows, "all").collect()] == ["u0"]
