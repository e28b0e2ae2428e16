import json

import pytest
from pyspark.sql import functions as F

from citeweave.plans import audit, report
from citeweave.sources import export, landed, manifest, prompts, snapshots

RECORDS = [
    {"url": "https://chat/?q=best%20shoes", "answer_text": "plain", "answer_text_markdown": "**md** acme shoes", "web_search_query": ["shoes", {"q": "boots"}], "web_search_triggered": "yes",
     "citations": [{"url": "https://a.com/x?utm_source=z", "title": "A", "cited": True}, {"url": "https://b.com/", "cited": False}],
     "search_sources_more": [{"url": "https://www.a.com/x", "title": "other", "description": "desc"}, {"url": "https://b.com/", "title": "late title"}], "search_sources": [{"url": "https://c.com", "rank": 4, "date_published": "2024-01-01"}],
     "links_attached": ["https://never.com"]},
    {"record_id": "r2", "prompt": "  What is  ACME? ", "links_attached": ["https://l.com/1", {"url": "https://l.com/2"}]},
    {"prompt": "raw only", "response_raw": {"deep": [{"link": "https://deep.com", "snippet": "s", "rank": 2}, {"url": "https://no-text.com"}]}},
]


@pytest.fixture()
def raw(spark, tmp_path):
    p = tmp_path / "export.json"
    p.write_text(json.dumps({"data": RECORDS}))
    return export.read_export(spark, str(p))


def test_records(raw):
    got = {r["record_id"]: r for r in export.parse_records(raw).collect()}
    assert set(got) == {"rec-1", "r2", "rec-3"}
    r = got["rec-1"]
    assert (r["prompt"], r["answer_text"], r["web_search_query"], r["web_search_triggered"]) == ("best shoes", "**md** acme shoes", ["shoes", "boots"], True)


def test_sources(raw):
    records = export.parse_records(raw)
    got = {(r["record_id"], r["normalized_url"]): r for r in export.extract_sources(records).collect()}
    a, b = got["rec-1", "https://a.com/x"], got["rec-1", "https://b.com/"]
    assert (a["cited_label"], a["title"], a["description"], a["source_origin"], len(a["appearances"])) == (1, "A", "desc", "citations", 2)
    assert (b["cited_label"], b["title"], b["source_group"]) == (0, "late title", "more_only")
    assert got["rec-1", "https://c.com"]["observed_rank"] == 4 and ("rec-1", "https://never.com") not in got
    assert {u for r, u in got if r == "r2"} == {"https://l.com/1", "https://l.com/2"} and got["r2", "https://l.com/1"]["cited_label"] == 1
    assert {u for r, u in got if r == "rec-3"} == {"https://deep.com"}
    s = export.run_summary(records, export.extract_sources(records)).first()
    assert (s["n_records"], s["n_sources"], s["n_cited"], s["looks_like_input"]) == (3, 6, 3, False)


def test_csv_cells_and_input_files(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('prompt,answer_text,citations\n"two\nlines","ans","[{""url"": ""https://a.com"", ""cited"": true}, {""url"": ""https://b.com""}]"\n')
    records = export.parse_records(export.read_export(spark, str(p)))
    assert records.first()["prompt"] == "two\nlines" and export.extract_sources(records).count() == 2
    q = tmp_path / "in.csv"
    q.write_text("prompt\none\ntwo\n")
    records = export.parse_records(export.read_export(spark, str(q)))
    assert export.run_summary(records, export.extract_sources(records)).first()["looks_like_input"]


def test_bad_json_gives_no_rows(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    assert export.read_json(spark, str(tmp_path / "bad.json")).count() == 0


def test_walk_is_bounded_and_in_order():
    node = {"a": [{"url": f"u{i}", "title": "t"} for i in range(100)]}
    found = export.walk(json.dumps(node))
    assert len(found) == 60 and json.loads(found[0])["url"] == "u0" and export.walk("nope") == [] and export.walk(None) == []


MANIFEST = "prompt_id,topic,intent,prompt,expected_source_types,client_brand_terms_to_detect_in_output,prompt_is_nonbranded\n1,Shoes,buy,BEST   shoes?,news; gov,acme; acme.com,\n2,,, what is acme,,acme,no\n,,,,,,\n"


@pytest.fixture()
def entries(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text(MANIFEST)
    return manifest.read_manifest(spark, str(p))


def test_manifest(raw, entries):
    parsed = manifest.parse_manifest(entries)
    assert [(r["prompt_id"], r["intent"], r["expected_source_types"], r["prompt_is_nonbranded"]) for r in parsed.orderBy("ordinal").collect()] == [("1", "buy", ["news", "gov"], None), ("2", "Unspecified", [], False)]
    got = {r["record_id"]: (r["intent"], r["topic"]) for r in manifest.apply_manifest(export.parse_records(raw), parsed).collect()}
    assert got == {"rec-1": ("buy", "Shoes"), "r2": ("Unspecified", ""), "rec-3": ("(unmatched)", "(unmatched)")}


def test_prompt_lines(spark):
    block = "ID Intent Prompt\nQ1\tbuy\tfirst one\nQ2 | compare | second | with bar\nbuy | third\nQ4   fourth\na bare prompt\nx | y | z\n\n"
    got = [(r["id"], r["intent"], r["prompt"]) for r in prompts.prompt_block(spark.createDataFrame([(block,)], "text string")).orderBy("pos").collect()]
    assert got == [("Q1", "buy", "first one"), ("Q2", "compare", "second with bar"), ("", "buy", "third"), ("Q4", "Custom", "fourth"), ("", "Custom", "a bare prompt"), ("", "Custom", "x y z")]
    assert [r["prompt"] for r in prompts.simple_prompts(spark.createDataFrame([("id , intent, prompt\na | b\n\n c",)], "text string")).orderBy("pos").collect()] == ["a | b", "c"]


def pages(spark):
    body = "# FAQ\n" + " ".join(["best shoes from acme with price and contact"] * 30)
    return spark.createDataFrame([("https://a.com/x", "https://a.com/x", "", "Acme shoes", body, body, "2024-01-05", "success")], "url string, normalized_url string, canonical_url string, title string, text string, markdown string, published_date string, status string")


def test_export_features(spark, raw):
    from citeweave.operators.features import _page_columns

    records = export.parse_records(raw)
    flat = export.flatten_sources(records, export.extract_sources(records))
    f = {r["url"]: r for r in _page_columns(flat, pages(spark)).collect()}
    a = f["https://a.com/x?utm_source=z"]
    assert a["scrape_success"] and a["word_count"] == 242 and a["heading_count"] == 1
    assert f["https://c.com"]["word_count"] is None and not f["https://c.com"]["scrape_success"]
    assert "| url |" in report.table(flat.select("url")) and report.csv_block(flat.select("url")).count("\n") == 8


def test_search_audit_and_snapshots(spark, tmp_path):
    serp = [{"searchQuery": {"term": "best shoes"}, "organicResults": [{"position": 1, "url": "https://a.com/x", "title": "Acme shoes", "description": "shoes"}, {"url": "https://z.org/y", "title": "Z"}, {"position": 99, "url": "https://far.com"}]}]
    crawl = [{"url": "https://a.com/x", "metadata": {"title": "Acme", "canonicalUrl": "https://a.com/canon"}, "text": "best shoes " * 40, "crawl": {"httpStatusCode": 200}}, {"url": "https://z.org/y", "crawl": {"errorMessage": "timeout"}}]
    answer = [{"candidates": [{"content": {"parts": [{"text": "Acme makes "}, {"text": "shoes."}]}, "groundingMetadata": {"webSearchQueries": ["best shoes"], "groundingChunks": [{"web": {"uri": "https://a.com/canon", "title": "t"}}, {"web": {"uri": "https://gone.net", "title": "g"}}]}}]}]
    read = {}
    for name, items in (("serp", serp), ("crawl", crawl), ("answer", answer)):
        (tmp_path / f"{name}.json").write_text(json.dumps(items))
        read[name] = landed.read_landed(spark, str(tmp_path / f"{name}.json"))
    rows, fetched = landed.search_rows(read["serp"]), landed.page_rows(read["crawl"])
    answers, citations, queries = landed.answer_rows(read["answer"])
    assert landed.usable(answers, citations, queries) and answers.first()["output_text"] == "Acme makes shoes."
    assert sorted(r["rank"] for r in rows.collect()) == [1, 2] and [r["status"] for r in fetched.orderBy("url").collect()] == ["success", "failed"]
    assert [r["query"] for r in queries.collect()] == ["best shoes"] and citations.count() == 2
    snapshots.save_run({"rows": rows, "pages": fetched}, str(tmp_path / "runs"), "S1", "2024-02-01T00:00:00")
    assert snapshots.list_runs(spark, str(tmp_path / "runs")).first()["run_id"] == "S1"
    assert snapshots.load_run(spark, str(tmp_path / "runs"), "rows", "S1").count() == 2
    empty = spark.createDataFrame([], "idx long, raw_uri string, resolved_url string, title string")
    with pytest.raises(audit.AuditError):
        audit.search_audit("S2", spark.createDataFrame([], "ord long, query string, rank int, url string, title string, snippet string"), empty, pages(spark), "", "2024-02-01")


def test_cache(spark):
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "k string")
    cache = spark.createDataFrame([("k1", "success"), ("k2", "failed")], "k string, status string")
    hits, todo = snapshots.cached(asked, cache, "k")
    assert [r["k"] for r in hits.collect()] == ["k1"] and sorted(r["k"] for r in todo.collect()) == ["k2", "k3"]
    assert spark.range(1).select(F.length(snapshots.stable_hash("id"))).first()[0] == 64


def test_stream(spark, tmp_path):
    from citeweave.streaming.events import start_counts, tumbling_counts

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    q = start_counts(spark, str(tmp_path / "in"), src.schema, str(tmp_path / "out"), str(tmp_path / "cp"), "1 hour", "0 seconds")
    q.awaitTermination(120)
    got = spark.read.schema(tumbling_counts(src, "1 hour").schema).parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    assert 0 < got <= src.count()
