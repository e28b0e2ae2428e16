from urllib.parse import parse_qsl, unquote, urlencode, urlparse

import pytest
from pyspark.sql import functions as F

from citeweave.functions import classify, urls


def run(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("u")).alias("x")).collect()]


CASES = {
    "http://www.Example.com/a/?utm_source=x&b=2&a=1#f": "https://example.com/a?a=1&b=2", "example.com": "https://example.com", "https://e.com/": "https://e.com/",
    "https://e.com//": "https://e.com", "http://h:80/x": "https://h:80/x", "https://h:443/x": "https://h/x", "https://u:p@h.com/x;v=1": "https://h.com/x",
    "https://e.com/a%20b?q=a+b&z=": "https://e.com/a b?q=a+b", "https://e.com/?REF=1&k=~*": "https://e.com/?k=~%2A", "": "", "https://e.com/%zz": "https://e.com/%zz",
}


def test_normalize(spark):
    assert run(spark, urls.normalize_url, list(CASES)) == list(CASES.values())


def test_bad_port_is_null(spark):
    assert run(spark, urls.normalize_url, ["https://h:99999/x", "https://h:ab/x"]) == [None, None]


def test_idempotent(spark):
    once = run(spark, urls.normalize_url, [c for c in CASES if "%" not in c])
    assert run(spark, urls.normalize_url, once) == once


def test_agrees_with_a_plain_model(spark):
    def model(u):
        p = urlparse(u)
        host = p.hostname.removeprefix("www.")
        path = unquote(p.path)
        path = path.rstrip("/") if len(path) > 1 and path.endswith("/") else path
        q = urlencode(sorted((k, v) for k, v in parse_qsl(p.query) if k.lower() not in urls.TRACKING))
        return f"https://{host}{path}" + (f"?{q}" if q else "")

    samples = [f"http{s}://{w}a{i}.example.org/{p}{q}#x" for i, (s, w, p, q) in enumerate((s, w, p, q) for s in ("", "s") for w in ("", "www.", "m.") for p in ("", "a/", "a/b", "%E0%B8%81") for q in ("", "?b=1&a=2", "?gclid=1&x=y%20z"))]
    assert run(spark, urls.normalize_url, samples) == [model(s) for s in samples]


def test_domains(spark):
    assert run(spark, urls.domain, ["https://WWW.a.co.uk/x", "b.com:8080/y"]) == ["a.co.uk", "b.com"]
    assert run(spark, urls.root_domain, ["https://x.a.co.uk/", "https://a.b.c.com", "https://10.0.0.1/", "localhost"]) == ["a.co.uk", "c.com", "10.0.0.1", "localhost"]


@pytest.mark.parametrize("url,want", [("https://amp.e.com/a/amp/", "https://e.com/a"), ("https://e.com/amp/a", "https://e.com/a"), ("https://e.com/a.amp.html", "https://e.com/a.html"), ("https://e.com/a", "https://e.com/a")])
def test_strip_amp(spark, url, want):
    assert run(spark, urls.strip_amp, [url]) == [want]


def test_wrapper_and_query(spark):
    assert run(spark, urls.is_redirect_wrapper, ["https://www.google.com/url?q=x", "https://google.com/x", "https://a.com/url?x", None]) == [True, False, False, False]
    assert run(spark, lambda c: urls.query_parameter(c, ["q", "prompt"]), ["https://c.com/?prompt=a%20b&q=", "https://c.com/"]) == ["a b", ""]


def test_classify_order(spark):
    cases = {"https://www.moh.go.th/x": "government", "https://x.ac.uk": "education", "https://en.wikipedia.org/a": "reference", "https://docs.foo.com": "documentation", "https://a.github.io": "documentation",
             "https://foo-shop.com": "ecommerce", "https://mynews.com": "news", "https://foo.com": "unknown", "https://gov.uk": "unknown"}
    assert run(spark, classify.source_type, list(cases)) == list(cases.values())


def test_brand_candidate(spark):
    rows = spark.createDataFrame([("https://nickstailor.com/about", "Nick's Tailor", "", ""), ("https://reddit.com/r", "Reddit thread", "", ""), ("https://bigcorp.com/", "", "what is bigcorp", ""), ("https://abc.com", "abc", "", "")], "u string, t string, q string, a string")
    got = [r[0] for r in rows.select(classify.brand_candidate(F.col("u"), F.col("t"), F.col("q"), F.col("a"))).collect()]
    assert got == [True, False, True, False]


def test_sql_functions(spark):
    urls.register(spark)
    r = spark.sql("SELECT url_domain('http://www.A.com:80/x') AS d, short_id('a') AS s").first()
    assert (r["d"], len(r["s"])) == ("a.com", 12)


# Hosts and registrable domains of the suffix list's own test cases, with the rules that they need.
SUFFIX_LINES = "// a comment\ncom\nbiz\ncy\n*.mm\njp\nac.jp\nkyoto.jp\nide.kyoto.jp\n*.kobe.jp\n!city.kobe.jp\n*.ck\n!www.ck\nus\nak.us\nk12.ak.us\ncn\n公司.cn\n中国\nuk\nco.uk\n// ===BEGIN PRIVATE DOMAINS===\nuk.com\n".split("\n")
SUFFIX_CASES = {
    "example.com": "example.com", "www.example.com": "example.com", "com": "com", "example.biz": "example.biz", "b.example.biz": "example.biz", "a.b.example.biz": "example.biz", "example.uk.com": "uk.com",
    "c.mm": "c.mm", "b.c.mm": "b.c.mm", "a.b.c.mm": "b.c.mm", "jp": "jp", "test.jp": "test.jp", "www.test.jp": "test.jp", "ac.jp": "ac.jp", "test.ac.jp": "test.ac.jp", "kyoto.jp": "kyoto.jp", "test.kyoto.jp": "test.kyoto.jp",
    "ide.kyoto.jp": "ide.kyoto.jp", "b.ide.kyoto.jp": "b.ide.kyoto.jp", "a.b.ide.kyoto.jp": "b.ide.kyoto.jp", "c.kobe.jp": "c.kobe.jp", "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp",
    "ck": "ck", "test.ck": "test.ck", "b.test.ck": "b.test.ck", "www.ck": "www.ck", "www.www.ck": "www.ck", "test.k12.ak.us": "test.k12.ak.us", "www.test.k12.ak.us": "test.k12.ak.us", "www.食狮.公司.cn": "食狮.公司.cn", "shishi.xn--55qx5d.cn": "shishi.xn--55qx5d.cn",
    "xn--85x722f.xn--fiqs8s": "xn--85x722f.xn--fiqs8s", "a.unlisted": "a.unlisted", "b.a.unlisted": "a.unlisted", "1.2.3.4": "1.2.3.4", "": "", "sub.a.co.uk": "a.co.uk",
}


def test_registrable_domains_by_rules(spark):
    from citeweave.functions import suffixes

    rules = suffixes.suffix_rules(spark, SUFFIX_LINES)
    hosts = spark.createDataFrame([(h,) for h in [*SUFFIX_CASES, "www.example.com", None]], "host string")
    got = suffixes.with_registrable(hosts, "host", "root", rules).collect()
    assert len(got) == len(SUFFIX_CASES) + 2
    assert {r.host: r.root for r in got} == SUFFIX_CASES | {None: None}
    private = suffixes.suffix_rules(spark, SUFFIX_LINES, private=True)
    assert suffixes.with_registrable(hosts.where("host = 'example.uk.com'"), "host", "root", private).first().root == "example.uk.com"


def test_matching_by_rules(spark, tmp_path):
    """Under a rule with a free label two hosts are strangers that the compact list takes for one site."""
    from citeweave.functions import suffixes
    from citeweave.operators import matching

    (tmp_path / "rules.dat").write_text("// rules\nck\n*.ck\n!www.ck\n")
    rules = suffixes.read_suffix_rules(spark, str(tmp_path / "rules.dat"))
    rows = spark.createDataFrame([(0, "q", 1, "https://a.test.ck/x", "t", "s"), (1, "q", 2, "https://a.www.ck/x", "t", "s")], "ord long, query string, rank int, url string, title string, snippet string")
    cited = spark.createDataFrame([(0, "https://b.test.ck/y", None, ""), (1, "https://b.www.ck/y", None, "")], "idx int, raw_uri string, resolved_url string, title string")
    kind = lambda rules: {r.citation_index: r.match_type for r in matching.match_citations(cited, matching.unique_candidates(rows, rules=rules), rules=rules).collect()}
    assert kind(None) == {0: "domain_only", 1: "domain_only"}
    assert kind(rules) == {0: "no_match", 1: "domain_only"}
