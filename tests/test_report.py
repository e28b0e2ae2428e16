"""Whole audits, what they write and what reports say; runs on a handful of rows."""

import json

import pytest
from pyspark.sql import functions as F

from citeweave.functions import classify, similarity, text
from citeweave.operators import batch, matching, profile, questions, stats
from citeweave.plans import audit, report
from citeweave.sources import export, landed, manifest, prompts, snapshots

PAGES = "normalized_url string, url string, title string, status string, text string, markdown string, published_date string, canonical_url string"


@pytest.fixture(scope="module")
def search(spark):
    rows = spark.createDataFrame([(i, f"q{i % 2}", i + 1, f"https://s{i}.example.com/a", f"title {i}", "snippet of clean water") for i in range(8)], "ord long, query string, rank int, url string, title string, snippet string")
    cited = spark.createDataFrame([(0, "https://s1.example.com/a", None, ""), (1, "https://s3.example.com/a?utm_source=x", None, ""), (2, "https://else.test/", None, "")], "idx int, raw_uri string, resolved_url string, title string")
    pages = spark.createDataFrame([(f"https://s{i}.example.com/a", "", f"title {i}", "success", f"clean water number {i} and more words", f"# Clean water\nclean water number {i}", "2024-01-02", None) for i in range(6)], PAGES)
    done = audit.search_audit("S1", rows, cited, pages, "clean water is found in clean wells", "2024-02-01", "clean water")
    yield done
    done.release()


def test_search_report_and_files(spark, search, tmp_path):
    text_ = report.search_report(search, "clean water")
    for part in ("# Search audit S1", "## Citation recall@K", "TOTAL", "## Insights", "[pre-answer] cite rates", "https://else.test/", "```csv", report.DISCLAIMER):
        assert part in text_, part
    paths = report.write_all(search, str(tmp_path), text_)
    assert spark.read.csv(f"{tmp_path}/S1/features", header=True).count() == 8
    assert spark.read.text(f"{tmp_path}/S1/report_md", wholetext=True).first()[0] == text_ + "\n"
    bundle = json.loads(spark.read.text(f"{tmp_path}/S1/analysis_json", wholetext=True).first()[0])
    assert len(bundle["sources"]) == 8 and bundle["not_whole"] == {} and bundle["disclaimer"] == report.DISCLAIMER
    assert "<h2>tiers</h2>" in spark.read.text(f"{tmp_path}/S1/report_html", wholetext=True).first()[0]
    assert len(paths) == len(search.tables) + 3


def test_flows_and_tiers(search):
    edges = {(r.source, r.target): r.n for r in search.tables["flows"].collect()}
    assert edges[("q1", "s1.example.com")] == 1 and edges[("s1.example.com", "cited")] == 1 and edges[("s0.example.com", "non-cited")] == 1
    tiers = {r.match_type: r.n for r in search.tables["tiers"].collect()}
    assert (tiers["exact"], tiers["normalized"], tiers["no_match"], tiers["TOTAL"]) == (1, 1, 1, 3)


def test_long_tables_say_that_they_are_cut(spark):
    df = spark.range(50).select((49 - F.col("id")).alias("n"))
    cut = report.table(df, "numbers", limit=10)
    assert "| 0 |" in cut and "| 9 |" in cut and "| 10 |" not in cut
    assert "(the first 10 of 50 rows, ordered by all columns; all of them are in the table numbers)" in cut
    assert "first" not in report.table(df, limit=50) and report.table(df.where("n < 0")) == "_none_"
    assert "the first 10 of 50" in report.csv_block(df, "numbers", 10)


def test_batch_of_runs(search):
    runs = {"A": search, "B": search}
    done = audit.batch_audit(runs, {"A": {"topic": "t1", "intent": "x"}, "B": {"topic": "t2"}})
    group = {r.feature: r for r in done.tables["group_stats"].collect()}
    assert group["serp_rank"].n_cited == 4 and group["serp_rank"].p_value is not None and group["serp_rank"].ci_low <= group["serp_rank"].median_diff <= group["serp_rank"].ci_high
    text_ = report.batch_report(done)
    assert "## By topic" in text_ and "t2" in text_ and "cite rate" in text_
    done.release()


def test_export_audit_with_brands(spark):
    item = lambda i, cited: {"url": f"https://b{i}.example.com/p", "title": "Acme tools" if i % 2 else "Other", "cited": cited}
    raw = [(i, None, str(i), f"which tools {i}", None, "Acme is good", None, None, None, None, None, None, None, json.dumps([item(1, True), item(2, True)]), json.dumps([item(3, False)]), None, None, None) for i in range(4)]
    raw = spark.createDataFrame(raw, "ordinal long, " + ", ".join(f"{f} string" for f in export.FIELDS))
    pages = spark.createDataFrame([(f"https://b{i}.example.com/p", "", "Acme tools", "success", "which tools are best, an FAQ of tools", "# Which tools\nFAQ of tools", None, None) for i in range(1, 4)], PAGES)
    entries = spark.createDataFrame([(i, f"which tools {i}", "howto", "T", "Acme", "Rival") for i in range(3)], "ordinal long, prompt string, intent string, topic string, client_brand_terms_to_detect_in_output string, competitor_terms_to_detect_in_output string")
    done = audit.export_audit("E1", raw, pages, "2024-02-01", entries)
    brand = {r.url: r for r in done.tables["brand_pages"].collect()}
    one = brand["https://b1.example.com/p"]
    assert one.is_client_source and one.has_faq and one.heading_prompt_match and one.answer_like_text_in_first_500_chars > 0.3
    assert {"brand_records", "brand_by_intent", "brand_versus", "brand_examples", "brand_compare", "brand_positions"} <= set(done.tables)
    asked = {r.qid: r for r in done.tables["questions"].collect()}
    assert asked["0"].prompt == "which tools 0" and asked["0"].intent == "howto" and asked["3"].intent == "(unmatched)"
    done.release()


def test_flag_words_are_folded_as_texts_are(spark):
    df = spark.createDataFrame([("คำถามที่พบบ่อย เวลาทำการ",)], "t string")
    flags = classify.content_flags(F.lit(""), F.col("t"), F.col("t"), F.lit(""), F.lit(""))
    got = df.select(flags["has_faq"].alias("a"), flags["has_opening_hours"].alias("b"), flags["has_author"].alias("c")).first()
    assert tuple(got) == (True, True, False)


def test_similarity_by_method(spark):
    pairs = spark.createDataFrame([(1, "aa", "ab"), (2, "aa", ""), (3, "xyz", "aa")], "k int, a string, b string")
    fn = lambda texts: [[t.count("a"), t.count("b"), t.count("x")] for t in texts]
    score = lambda s: {r.k: r.sim for r in s(pairs, ["k"], F.col("a"), F.col("b")).collect()}
    assert score(similarity.scorer("embedding", fn)) == {1: 0.7071, 2: 0.0, 3: 0.0}
    assert similarity.scorer("embedding") is similarity.lexical and similarity.scorer("lexical", fn) is similarity.lexical


def test_nearest_equals_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(similarity, "QUERY_BLOCK", 3)
    monkeypatch.setattr(similarity, "ROW_BLOCK", 20)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((90, 4)).tolist()
    x[7], x[11], x[13], x[20] = x[3], None, [0.0] * 4, [1.0, 2.0]
    rows = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = similarity.nearest(rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), rows, 4)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.sim) for r in got.collect()}

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or not np.any(a) or not np.any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 4)

    for q in range(0, 90, 10):
        best = sorted((-cosine(x[q], x[i]), i) for i in range(90) if i != q)[:4]
        assert [got[(q, n + 1)] for n in range(4)] == [(i, -s) for s, i in best], q


def test_files_keep_their_records_apart(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"data": [{"prompt": f"{name} {i}"} for i in range(2)]}))
    (tmp_path / "bad.json").write_text("{nothing")
    ids = [r.record_id for r in export.parse_records(export.read_export(spark, f"{tmp_path}/*.json")).collect()]
    assert len(set(ids)) == 4 and all(i.startswith("rec-") for i in ids)
    alone = export.parse_records(export.read_export(spark, f"{tmp_path}/one.json"))
    assert {r.record_id: r.prompt for r in alone.collect()} == {"rec-1": "one 0", "rec-2": "one 1"}
    warned = {r.file.rsplit("/", 1)[1]: r.warning for r in export.file_warnings(spark, f"{tmp_path}/*.json").collect()}
    assert warned == {"bad.json": "JSON parse failed"}
    (tmp_path / "noext").write_text("prompt,url\nhello,\n")
    assert export.parse_records(export.read_export(spark, f"{tmp_path}/noext")).first().prompt == "hello"
    m = tmp_path / "m"
    m.mkdir()
    (m / "a.csv").write_text("prompt,intent\np1,\n,\np3,how\n")
    raw = manifest.read_manifest(spark, f"{m}/a.csv")
    assert [(r.prompt_id, r.prompt) for r in manifest.parse_manifest(raw).orderBy("ordinal").collect()] == [("P1", "p1"), ("P3", "p3")]
    assert [r.ordinal for r in manifest.manifest_warnings(raw).collect()] == [1]


def test_landed_lines_and_arrays(spark, tmp_path):
    page = lambda i: json.dumps({"url": f"https://x{i}.test/", "text": "t"})
    (tmp_path / "a.jsonl").write_text("\n".join(page(i) for i in range(3)))
    (tmp_path / "b.json").write_text("[" + ",\n".join(page(i) for i in range(3, 5)) + "]")
    items = landed.read_landed(spark, str(tmp_path))
    assert items.select("item_ord").distinct().count() == 5
    assert sorted(r.url for r in landed.page_rows(items).collect()) == [f"https://x{i}.test/" for i in range(5)]


def test_small_views(spark):
    rows = spark.createDataFrame([("a", 1, 0.9, "d1", 1), ("b", 0, 0.8, "d2", 2), ("c", 0, 0.8, "d3", 3)], "qid string, cited int, sim double, domain string, ord int")
    assert profile.most_similar_uncited(rows, "sim").first().domain == "d2"
    clusters = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "qid string, cluster int")
    topics = questions.cluster_topics(rows.withColumn("topic", F.concat(F.lit("T"), "ord")), clusters)
    assert {r.cluster: r.topics for r in topics.collect()} == {0: "T1, T2", 1: "T3"}
    shown = spark.createDataFrame([(None, None), (0.125, 12.5), (0.5, 12345.6)], "p double, n double").select(text.percent_text(F.col("p")).alias("p"), text.number_text(F.col("n")).alias("n"))
    assert [tuple(r) for r in shown.collect()] == [("—", "—"), ("12%", "12.50"), ("50%", "12,346")]
    packs = spark.createDataFrame([("T1", 2), ("T1", 1), ("T2", 0)], "topic string, i int")
    assert [r.i for r in prompts.first_questions(prompts.topic_items(packs, ["T1"]), 1, "i").collect()] == [1]
    old, new = (spark.createDataFrame(x, "normalized_url string, v int") for x in ([("a", 1), ("b", 1)], [("b", 2)]))
    assert {tuple(r) for r in snapshots.merge_pages(old, new).collect()} == {("a", 1), ("b", 2)}
    assert matching.tier_table(spark.createDataFrame([], "match_type string")).where("match_type = 'TOTAL'").first().n == 0
    assert batch.recall_average(spark.createDataFrame([("strict", 5, 0.3333), ("strict", 5, 0.3334)], "mode string, k int, recall double")).first().recall == 0.3334
    assert stats.group_stats(rows.withColumn("x", F.col("ord")), ["x"]).first().p_value is None
