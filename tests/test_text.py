import datetime as dt
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from citeweave.functions import classify, similarity, text
from citeweave.operators import chunking, features
from citeweave.plans import queries_views
from citeweave.plans.bindings import md
from citeweave.plans.queries_views import ANSWER


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_tokens_and_prompt_key(spark):
    assert one(spark, text.tokens(F.col("t")), t="The Best of ÉCOLE tools, tools 2024") == ["cole", "tools", "tools", "2024"]
    assert one(spark, text.prompt_key(F.col("t")), t='  "What\n IS  this?! ') == "what is this"
    assert one(spark, text.split_terms(F.col("t")), t="TCC; tcc |Big, Co\n x.com") == ["TCC", "Big, Co", "x.com"]
    assert one(spark, text.split_expected(F.col("t")), t="news; gov,|") == ["news", "gov"]


def test_words_and_headings(spark):
    assert one(spark, text.words(F.col("t")), t=" a b　c\x1cd  ") == ["a", "b", "c", "d"]
    assert one(spark, text.headings(F.col("t")), t="# One\ntext\n  ## Two  \n#no\n###   ") == ["One", "Two"]
    assert one(spark, text.word_count(F.col("t")), t="ab_c, d9 é!") == 3


@pytest.mark.parametrize("s,want", [("2024-01-02", dt.datetime(2024, 1, 2)), ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)), ("2024/01/02", dt.datetime(2024, 1, 2)), ("2 Jan 2024", dt.datetime(2024, 1, 2)), ("Jan 2, 2024", dt.datetime(2024, 1, 2)), ("soon", None), (None, None)])
def test_dates(spark, s, want):
    assert one(spark, text.parse_date(F.col("t")), t=s) == want


def test_freshness(spark):
    as_of = F.lit("2024-01-10 12:00:00").cast("timestamp")
    got = [one(spark, text.freshness_days(text.parse_date(F.col("t")), as_of), t=t) for t in ("2024-01-08", "2025-01-01", "x")]
    assert got == [2.0, 0.0, None]


def test_terms(spark):
    terms = ["TCC", "brand.com", "โรงพยาบาล", "Ｆull"]
    found = lambda s: one(spark, text.detect_terms(F.col("t"), terms), t=s)
    assert found("the tcc clinic") == ["TCC"] and found("fatcc") == [] and found("see www.BRAND.com/x") == ["brand.com"]
    assert found("ไปโรงพยาบาลนี้") == ["โรงพยาบาล"] and found("a full stop") == ["Ｆull"] and found(None) == []


def test_lexical_similarity(spark):
    def plain(a, b):
        v = [{t: 1 + math.log(c) for t, c in Counter(x.split()).items()} for x in (a, b)]
        dot = sum(v[0][t] * v[1].get(t, 0) for t in v[0])
        return round(dot / math.sqrt(sum(w * w for w in v[0].values()) * sum(w * w for w in v[1].values())), 4)

    pairs = [(0, "red red car fast", "red car"), (1, "alpha beta", "gamma"), (2, "", "x1"), (3, "the of", "x1"), (4, "same words", "same words")]
    df = spark.createDataFrame(pairs, "id int, a string, b string")
    got = {r["id"]: r["sim"] for r in similarity.lexical(df, ["id"], F.col("a"), F.col("b")).collect()}
    assert got == {0: plain(*pairs[0][1:]), 1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}


def test_terms_of_a_text_are_not_shuffled(spark):
    """Similarities of rows and of chunks come without an exchange; halves are rounded up, nulls stay null."""
    df = spark.createDataFrame([(0, "a1 b1 c1 d1", "a1 e1 f1 g1"), (1, None, "x1"), (2, " ".join(f"w{i}" for i in range(32 * 32)), "w5")], "id int, a string, b string")
    scored = similarity.lexical(df, ["id"], F.col("a"), F.col("b"))
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["sim"] for r in scored.collect()} == {0: 0.25, 1: 0.0, 2: 0.0313}
    pairs = df.select("id", similarity.lexical_cosines([(F.col("a"), F.col("b")), (F.col("b"), F.col("b"))]).alias("s"))
    assert {r["id"]: r["s"] for r in pairs.collect()} == {0: [0.25, 1.0], 1: [None, 1.0], 2: [0.0313, 1.0]}
    rows = df.select("id", F.col("a").alias("p_md"), "b")
    chunks, _ = features.chunk_scores(rows, "id", {"sim": F.col("b")})
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
    assert {r["id"] for r in chunks.collect()} == {2}


def test_only_texts_beyond_ascii_go_to_python(spark):
    df = spark.createDataFrame([("Abc",), ("Straße Ａ",), (None,), ("",)], "t string")
    out = df.select("t", text.fold(F.col("t")).alias("f"))
    assert "CASE WHEN NOT" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["t"]: r["f"] for r in out.collect()} == {"Abc": "abc", "Straße Ａ": "strasse a", None: "", "": ""}


def test_markdown_is_made_once_for_all_flags(spark):
    """The rules of flags and page types look at columns, not at the expressions that make them."""
    from citeweave.plans import queries_text

    for query in (queries_text.page_type, queries_text.content_flags):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(?:script|style)[^>]*>.*") == 1


def test_dense_and_top(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.9, 0.1, 0.5, 0.4])], "a array<double>, b array<double>, s array<double>")
    r = df.select(similarity.dense_cosine(F.col("a"), F.col("b")).alias("c"), similarity.top_mean(F.col("s")).alias("t")).first()
    assert round(r["c"], 6) == round(1 / math.sqrt(2), 6) and (r["t"]["max"], r["t"]["mean"], r["t"]["mean_top"]) == (0.9, 0.475, 0.6)


def test_embed_once(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "t string")
    known = spark.createDataFrame([("a", [1.0])], "t string, embedding array<double>")

    def fn(batch):
        if "a" in batch:
            raise ValueError("asked again")
        return [[2.0] for _ in batch]

    got = {r["t"]: r["embedding"] for r in similarity.embed_new(texts, known, "t", fn).collect()}
    assert got == {"a": [1.0], "b": [2.0]}


def chunks(spark, md, **kw):
    return [(r["idx"], r["heading"], r["n_words"]) for r in chunking.chunk_rows(spark.createDataFrame([(1, md)], "id int, md string"), "id", "md", **kw).orderBy("idx").collect()]


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(200))
    assert chunks(spark, f"# Head\n{words}") == [(0, "Head", 120), (1, "Head", 105), (2, "Head", 10)]
    assert chunks(spark, "intro too short\n# A\n" + "one two three four five six seven eight\n# B\nshort") == [(0, "A", 8)]
    assert chunks(spark, "# Only a heading that is rather long for a title\n# And another") == [(0, "", 12)]
    assert chunks(spark, "  ") == [] and len(chunks(spark, " ".join(["w"] * 9000))) == 60


def test_best_page_chunk_looks_at_all_chunks(spark, tmp_path):
    """The best chunk is the 70th of its page; result and SQL agree on it."""
    page = "<title>t</title>" + "".join(f"<h2>part {i}</h2><p>{(ANSWER if i == 70 else 'nothing that is like it stands in here at all')}</p>" for i in range(90))
    spark.createDataFrame([(1, "https://a.com/x", page), (2, "https://a.com/y", "<p>a page of one chunk that has some words of an answer</p>")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries_views.best_page_chunk(spark, tmp_path).collect())
    assert [r[:4] for r in got] == [(1, 70, "part 70", 1.0), (2, 0, "", got[1][3])]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(queries_views.ORACLE["best_page_chunk"]).fetchall())
    assert [r["idx"] for r in chunking.chunk_rows(md(spark, tmp_path), "page_id", "md", most=None).where("page_id = 1").collect()] == list(range(90))


def test_brand_pages_look_at_whole_texts(spark, tmp_path):
    """Terms stand behind 4,000 characters of a text, or behind 40 of a title whose page was not fetched."""
    filler = "zebra " * 800
    html = {1: f"<title>t</title><p>{filler} the</p>", 2: f"<title>t</title><p>{filler} See EXAMPLE.org</p>", 3: f"<title>t</title><p>{filler} thesis</p>", 4: f"<title>t</title><h1>and</h1><p>{filler}</p>", 6: f"<title>{'w' * 50} the</title><p>x</p>", 12: f"<title>t</title><p>{filler} the</p>"}
    spark.createDataFrame([(k, f"https://a{k}.test/guide/x", h) for k, h in html.items()], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in queries_views.brand_pages(spark, tmp_path).collect()), key=lambda r: r[0])
    assert [r[:3] for r in got] == [(1, True, False), (2, False, True), (4, False, True), (6, True, False)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(queries_views.ORACLE["brand_pages"]).fetchall())


def test_brand_terms_of_source_and_page_are_united(spark):
    """Found terms keep the order of the list, whichever of source and page shows them."""
    sources = spark.createDataFrame([(i, f"https://b{i}.test", f"https://b{i}.test", f"b{i}.test", t, "") for i, t in enumerate(["Zeta", "none", "none", "Ｚｅｔａ"])], "source_id int, url string, normalized_url string, domain string, title string, description string")
    sources = sources.withColumn("source_type", F.lit("unknown"))
    page = lambda i, status, text_, md_: (f"https://b{i}.test", "page", status, text_, md_)
    pages = spark.createDataFrame([page(0, "success", "x " * 3000 + "Alpha", "# Rival\nfaq"), page(1, "success", "", "é " * 3000 + "ＡＬＰＨＡ"), page(2, "failed", "alpha", "alpha"), page(3, "success", None, None)], "normalized_url string, title string, status string, text string, markdown string")
    out = features.brand_pages(sources, pages, ["Alpha", "Zeta"], ["rival"])
    got = {r["source_id"]: (r["client_terms_found"], r["competitor_terms_found"], r["has_faq"], r["page_type"]) for r in out.collect()}
    assert got == {0: (["Alpha", "Zeta"], ["rival"], False, "unknown"), 1: (["Alpha"], [], False, "unknown"), 3: (["Zeta"], [], None, "unknown")}
    assert not {"p_text", "p_heads", "p_begin", "has_text", "n_text"} & set(out.columns)


def test_email_and_table_flags(spark):
    rows = [("mail x@b.co", "a|b"), (" @b.co", "a | b\n|c|"), ("a@b", "||\n||"), ("é@b.co", "| --"), ("A.B-@c.dE", "none")]
    df = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(rows)], "id int, t string, m string")
    flags = classify.content_flags(F.lit(""), F.col("t"), F.col("m"), F.lit(""), F.lit(""))
    got = df.select("id", flags["has_email"].alias("e"), flags["has_table"].alias("t")).orderBy("id").collect()
    assert [r["e"] for r in got] == [True, False, False, False, True] and [r["t"] for r in got] == [False, False, True, True, False]


def test_content_flags_and_page_type(spark):
    md = "# FAQ\n| a | b |\n|---|---|\n- item\nCall +66 2 123 4567 or a@b.com. ราคา 100"
    df = spark.createDataFrame([("Price list", md)], "title string, md string")
    flags = classify.content_flags(F.col("title"), F.col("md"), F.col("md"), F.lit(""), F.lit("price check"))
    r = df.select(*[c.alias(n) for n, c in flags.items()]).first()
    on = {n for n in flags if r[n]}
    assert {"has_faq", "has_table", "has_bullets", "has_phone_number", "has_email", "has_price_or_package", "title_contains_intent_terms"} <= on
    assert not {"has_author", "has_schema", "has_many_headings", "has_reviewer"} & on
    kind = lambda u, k: df.select(classify.page_type(F.lit(u), F.lit(k), {n: F.lit(False) for n in flags})).first()[0]
    assert [kind("https://a.com/contact", "unknown"), kind("https://a.com/x", "forum"), kind("https://a.com/search", "ecommerce"), kind("https://a.com/", "unknown")] == ["contact_page", "forum_thread", "marketplace_page", "unknown"]
