"""Audits in stages: taken up again, small plans, runs that fail, whole reports."""

import json

import pytest
from pyspark.sql import functions as F

from citeweave.operators import matching
from citeweave import stages
from citeweave.plans import audit, report
from citeweave.sources import export

PAGES = "normalized_url string, url string, title string, status string, text string, markdown string, published_date string, canonical_url string"


def nodes(df):
    """Operators of the optimised plan."""
    return len(df._jdf.queryExecution().optimizedPlan().toString().strip().splitlines())


@pytest.fixture(scope="module")
def exported(spark):
    item = lambda i, cited: {"url": f"https://b{i}.example.com/p", "title": "Acme tools" if i % 2 else "Other", "cited": cited}
    raw = [(i, None, str(i), f"which tools {i}", None, "Acme is good", None, None, None, None, None, None, None, json.dumps([item(1, True), item(2, True)]), json.dumps([item(3, False)]), None, None, None) for i in range(4)]
    raw = spark.createDataFrame(raw, "ordinal long, " + ", ".join(f"{f} string" for f in export.FIELDS))
    pages = spark.createDataFrame([(f"https://b{i}.example.com/p", "", "Acme tools", "success", "which tools are best, an FAQ of tools", "# Which tools\nFAQ of tools", None, None) for i in range(1, 4)], PAGES)
    entries = spark.createDataFrame([(i, f"which tools {i}", "howto", "T", "Acme", "Rival") for i in range(3)], "ordinal long, prompt string, intent string, topic string, client_brand_terms_to_detect_in_output string, competitor_terms_to_detect_in_output string")
    return raw, pages, entries


def test_export_audit_is_taken_up_again(spark, exported, tmp_path, monkeypatch):
    raw, pages, entries = exported
    base = str(tmp_path)
    whole = stages.Stages.keep

    def stops(self, name, *rest):
        if name == "brand_compare":
            raise RuntimeError("the driver went")
        return whole(self, name, *rest)

    monkeypatch.setattr(stages.Stages, "keep", stops)
    with pytest.raises(RuntimeError):
        audit.export_audit("E1", raw, pages, "2024-02-01", entries, base=base)
    monkeypatch.setattr(stages.Stages, "keep", whole)
    # The same rows in another order are the same input.
    done = audit.export_audit("E1", raw.orderBy(F.desc("ordinal")), pages, "2024-02-01", entries, base=base)
    assert {"records", "sources", "features", "brand_pages", "brand_records"} <= set(done.stages.found)
    assert set(done.stages.written) == {"brand_compare", "brand_positions"}
    assert {name: n for name, df in done.tables.items() if (n := nodes(df)) > 100} == {}
    # Other terms leave the stages before the brands as they are; another row or date does not.
    other = audit.export_audit("E1", raw, pages, "2024-02-01", entries, client=["Other"], base=base)
    assert {"records", "sources", "features", "group_compare"} <= set(other.stages.found) and "brand_pages" in other.stages.written
    assert "features" in audit.export_audit("E1", raw, pages, "2024-02-02", base=base).stages.written
    assert "records" in audit.export_audit("E1", raw.where("ordinal < 3"), pages, "2024-02-01", base=base).stages.written
    done.release()  # stages of a base stay
    assert done.tables["features"].count() == 12

    text = report.export_report(done)
    for part in ("# Answer export audit E1", "## Sample sizes", "## Questions", "which tools 2", "## Top domains — cited", "b1.example.com", "## Top domains — more-only", "b3.example.com", "## Non-branded Brand Visibility Audit", "howto",
                 "## Cited source types by intent", "## More-only source types by intent", "### Example prompts", "```csv", report.DISCLAIMER):
        assert part in text, part
    share = {(r.intent, r.source_type): (r.n, r.pct) for r in done.tables["intent_share"].collect()}
    assert sum(n for n, _ in share.values()) == 12  # all surfaced sources, cited or not
    for intent in {i for i, _ in share}:
        assert abs(sum(p for (i, _), (_, p) in share.items() if i == intent) - 100) < 0.01


def test_a_stage_half_written_is_written_anew(spark, tmp_path):
    df = spark.range(5).withColumn("nothing", F.lit(None))
    one = stages.Stages(spark, str(tmp_path), {"in": df.drop("nothing")}, k=1)
    assert one.keep("t", df).count() == 5 and one.written == ["t"]
    again = stages.Stages(spark, str(tmp_path), {"in": df.drop("nothing")}, k=1)
    assert again.keep("t", df).count() == 5 and again.found == ["t"]
    at, store = again._path(f"{again.paths[0]}/_SUCCESS")
    store.delete(at, False)
    third = stages.Stages(spark, str(tmp_path), {"in": df.drop("nothing")}, k=1)
    assert third.keep("t", df).count() == 5 and third.written == ["t"]
    scratch = stages.Stages(spark, None, {"in": df})
    kept = scratch.keep("t", df)
    assert kept.count() == 5
    scratch.remove()
    at, store = scratch._path(scratch.paths[0])
    assert not store.exists(at)


def landed(spark, n):
    """n runs of four results and three citations; the second has failed, the third has nothing."""
    runs = spark.createDataFrame([(f"R{i}", "clean water" if i % 2 else "wells", "" if i == 2 else f"clean water is found in wells {i}", f"T{i % 2}", "", "Timeout" if i == 1 else None) for i in range(n)], "run_id string, prompt string, output_text string, topic string, intent string, error string")
    rows = spark.createDataFrame([(f"R{i}", j, f"q{j % 2}", j % 3 + 1, f"https://s{(i + j) % 6}.example.com/a", f"title {j}", "clean water") for i in range(n) for j in range(4)], "run_id string, ord long, query string, rank int, url string, title string, snippet string")
    cited = spark.createDataFrame([(f"R{i}", j, f"https://s{(i + 2 * j) % 6}.example.com/{'a' if j < 2 else 'b'}", None, "") for i in range(n) for j in range(3) if i != 2], "run_id string, idx int, raw_uri string, resolved_url string, title string")
    pages = spark.createDataFrame([(f"https://s{i}.example.com/a", "", f"title {i}", "success", f"clean water number {i} and more words", f"# Clean water\nclean water number {i}", "2024-01-02", None) for i in range(5)], PAGES)
    return runs, rows, cited, pages


def test_batch_is_its_runs_one_by_one(spark):
    runs, rows, cited, pages = landed(spark, 6)
    done = audit.batch_search_audit("B", runs, rows, cited, pages, "2024-02-01")
    table = {r.run_id: r for r in done.tables["runs"].collect()}
    assert len(table) == 6 and table["R1"].error == "Timeout" and table["R2"].error.startswith("AuditError") and table["R1"].n_candidates is None
    per_run = {r.asDict()["candidate_id"]: r for r in done.tables["features"].collect()}
    for i in (0, 3):
        mine = lambda df: df.where(F.col("run_id") == f"R{i}").drop("run_id")  # noqa: B023, E731
        text, prompt = runs.where(F.col("run_id") == f"R{i}").select("output_text", "prompt").first()
        single = audit.search_audit("S", mine(rows), mine(cited), pages, text, "2024-02-01", prompt)
        want = {r.candidate_id: r for r in single.tables["features"].collect()}
        got = {k.split("/")[1]: v for k, v in per_run.items() if k.startswith(f"R{i}/")}
        assert set(got) == set(want)
        for k, w in want.items():
            assert {c: got[k][c] for c in w.asDict() if c != "candidate_id"} == {c: v for c, v in w.asDict().items() if c != "candidate_id"}
        recall = {(r["mode"], r.k): r.recall for r in done.tables["recall_by_run"].where(F.col("run_id") == f"R{i}").collect()}
        assert recall == {(r["mode"], r.k): r.recall for r in single.tables["recall"].collect()}
        assert table[f"R{i}"].n_candidates == len(want) and table[f"R{i}"].recall_strict_10 == recall[("strict", 10)]
    assert done.tables["sample"].first().n_runs == 4
    text = report.batch_report(done)
    assert "## By topic" in text and "T1" in text and "Timeout" in text
    done.release()


def test_plan_of_a_batch_does_not_grow_with_its_runs(spark):
    few, many = (audit.batch_search_audit("B", *landed(spark, n), "2024-02-01") for n in (4, 60))
    assert {k: nodes(df) for k, df in few.tables.items()} == {k: nodes(df) for k, df in many.tables.items()}
    assert many.tables["runs"].count() == 60
    for done in (few, many):
        done.release()


def test_candidates_equal_the_rows_put_in_order(spark):
    """The last row that improved the best rank with a text of its own, by a loop over the rows."""
    import random

    rng = random.Random(3)
    rows = [(rng.choice("AB"), i, f"q{rng.randrange(3)}", rng.choice([0, 1, 2, 3, 5, 8, None]), f"https://s{rng.randrange(4)}.example.com/", rng.choice(["", f"t{i}", None]), rng.choice(["", f"s{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "run_id string, ord long, query string, rank int, url string, title string, snippet string")
    want = {}
    for run, i, query, rank, url, title, snippet in rows:
        rank = rank or 999
        c = want.setdefault((run, url), {"best": None, "title": "", "snippet": "", "ord": i, "queries": []})
        c["queries"].append((query, rank))
        if c["best"] is None or rank < c["best"]:
            c |= {"best": rank, "title": title or c["title"], "snippet": snippet or c["snippet"]}
    got = {(r.run_id, r.url): {"best": r.best_rank, "title": r.title, "snippet": r.snippet, "ord": r.ord, "queries": [tuple(q) for q in r.queries]} for r in matching.unique_candidates(df, ["run_id"]).collect()}
    assert got == want
