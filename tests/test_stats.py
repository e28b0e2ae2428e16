from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.operators import batch, brand, compare, intent, questions, stats


@pytest.fixture()
def rows(spark):
    data = [(i, i % 2, float(v), s, i % 3 == 0, False, f"d{i % 3}", "buy" if i < 4 else "", "T") for i, (v, s) in enumerate([(5, "news"), (1, "blog"), (7, "news"), (1, "blog"), (9, "news"), (2, None), (9, "forum"), (2, "blog")])]
    return spark.createDataFrame(data, "ord int, cited int, x double, source_type string, institutional_official boolean, brand_official_candidate boolean, domain string, intent string, topic string")


def test_group_compare(rows):
    r = compare.group_compare(rows, ["x"]).first()
    assert (r["cited_mean"], r["non_cited_mean"], r["cited_median"], r["non_cited_median"], r["delta"], r["n_cited"], r["n_non_cited"]) == (1.5, 7.5, 1.5, 8.0, -6.0, 4, 4)


def test_breakdown_drops_null_keys(rows):
    got = {r["source_type"]: (r["n"], r["n_cited"]) for r in compare.source_breakdown(rows).collect()}
    assert got == {"news": (3, 0), "blog": (3, 3), "forum": (1, 0)}


def test_correlation_guards(spark, rows):
    got = {r["feature"]: r["corr"] for r in compare.correlation_with_cited(rows, ["x", "ord"]).collect()}
    x, y = np.array([5, 1, 7, 1, 9, 2, 9, 2.0]), np.array([0, 1] * 4)
    assert got["x"] == round(np.corrcoef(x, y)[0, 1], 4)
    flat = spark.createDataFrame([(1, 2.0), (0, 2.0), (1, 2.0)], "cited int, x double")
    assert compare.correlation_with_cited(flat, ["x"]).first()["corr"] is None
    assert compare.number.__doc__


def test_numbers_are_coerced(spark):
    df = spark.createDataFrame([("1.5", 1), ("x", 0), ("NaN", 1), (None, 0)], "v string, cited int")
    assert [r["value"] for r in compare.long_features(df, ["v"], ["cited"]).collect()] == [1.5, None, None, None]


def test_mann_whitney_by_hand(rows):
    r = stats.mann_whitney(rows, ["x"]).first()
    assert (r["n1"], r["n2"], r["u"], r["tie_term"]) == (4, 4, 0.0, 18.0)
    assert abs(r["p_value"] - 0.0194) < 0.002


def test_bootstrap_is_reproducible(rows):
    a, b = (stats.bootstrap_median_diff(rows.repartition(n), ["x"]).first() for n in (1, 3))
    assert a == b


def test_questions(spark):
    data = [("q1", "a.com", 1), ("q1", "b.com", 1), ("q2", "a.com", 1), ("q2", "b.com", 1), ("q3", "z.com", 1), ("q4", "y.com", 0), ("q3", None, 1)]
    rows = spark.createDataFrame(data, "record_id string, domain string, cited int")
    rows = questions.question_rows(rows)
    clusters = {r["qid"]: r["cluster"] for r in questions.cluster_questions(rows, 2).collect()}
    assert clusters["q1"] == clusters["q2"] != clusters["q3"] and clusters["q4"] == -1
    table = {r["qid"]: r for r in questions.question_table(rows).collect()}
    assert table["q1"]["top_domains"] == "a.com, b.com" and table["q4"]["top_domains"] == "" and table["q3"]["n_total"] == 2
    assert {(r["a"], r["b"], r["jaccard"]) for r in questions.jaccard_pairs(questions.domain_sets(rows)).collect()} == {("q1", "q2", 1.0)}
    m = {r["qid"]: r.asDict() for r in questions.question_matrix(rows, 2).collect()}
    assert m["q1"]["a.com"] == 1 and m["q3"]["a.com"] == 0


def linked_by_a_loop(sets, k):
    """Cluster of each question by a loop over all pairs in exact fractions: the nearest merge, of ties the first pair."""
    ids = sorted(sets)
    near = lambda a, b: Fraction(round(questions.UNIT * len(sets[a] & sets[b]) / len(sets[a] | sets[b])), questions.UNIT)
    active, members = list(ids), {q: [q] for q in ids}
    while len(active) > max(1, k):
        best = None
        for x, a in enumerate(active):
            for b in active[x + 1 :]:
                mean = sum(near(p, q) for p in members[a] for q in members[b]) / (len(members[a]) * len(members[b]))
                if best is None or mean > best[0]:
                    best = mean, a, b
        _, a, b = best
        members[a] += members.pop(b)
        active.remove(b)
    return {q: c for c, a in enumerate(active) for q in members[a]}


def random_sets(rng, n, domains):
    return {f"q{i:02d}": {f"d{rng.randrange(domains)}" for _ in range(rng.randrange(1, 5))} for i in range(n)}


def test_local_linkage_equals_a_loop():
    """300 tables with many ties: the merges of one task against all pairs in exact fractions."""
    import random

    rng = random.Random(4)
    for _ in range(300):
        sets = random_sets(rng, rng.randrange(2, 11), rng.choice([3, 6, 12]))
        ids = sorted(sets)
        s = np.array([[round(questions.UNIT * len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for b in ids] for a in ids])
        merges = questions.average_linkage(s, np.ones(len(ids), int))
        assert all(x[2] >= y[2] for x, y in zip(merges, merges[1:]))
        for k in {n for n in (1, 2, 4, len(ids)) if n >= len(ids) - len(merges)}:
            root = {q: q for q in ids}
            for i, j, _ in merges[: max(0, len(ids) - k)]:
                root = {q: ids[i] if r == ids[j] else r for q, r in root.items()}
            number = {r: c for c, r in enumerate(sorted(set(root.values())))}
            assert {q: number[r] for q, r in root.items()} == linked_by_a_loop(sets, k)


@pytest.mark.parametrize("local", [1000, 3])
def test_clusters_equal_a_loop(spark, monkeypatch, local):
    """Rounds of mutual nearest neighbours, and the rest in one task; equal sets, ties, nothing shared."""
    import random

    monkeypatch.setattr(questions, "LOCAL", local)
    rng = random.Random(9)
    tables = [(random_sets(rng, 12, 9), 3), ({"a": {"x"}, "b": {"x"}, "c": {"x"}, "d": {"y"}, "e": {"z"}, "f": {"y", "z"}}, 4), ({"a": {"x"}, "b": {"y"}, "c": {"z"}, "d": {"w"}}, 2)]
    for sets, k in tables:
        df = spark.createDataFrame([(q, d, 1) for q, ds in sets.items() for d in ds] + [("none", None, 1), ("shown", "x", 0)], "qid string, domain string, cited int")
        got = {r["qid"]: r["cluster"] for r in questions.cluster_questions(df, k).collect()}
        assert got.pop("none") == got.pop("shown") == -1
        assert got == linked_by_a_loop(sets, k)


def test_no_stage_holds_pairs_of_questions(spark, monkeypatch):
    """Forty questions that all share a domain, in blocks of a few: stages of a row a question, the merges of a loop."""
    import random

    monkeypatch.setattr(questions, "LOCAL", 3)
    monkeypatch.setattr(questions, "BLOCK", 15)
    rng = random.Random(5)
    sets = {q: ds | {"all"} for q, ds in random_sets(rng, 40, 14).items()}
    df = spark.createDataFrame([(q, d, 1) for q, ds in sets.items() for d in ds], "qid string, domain string, cited int")
    held = {}

    def keep(name, table, *parameters):
        table = table.localCheckpoint()
        held[(name, *parameters)] = table.count()
        return table

    questions.linkage_merges(questions.domain_sets(df), keep)
    assert max(held.values()) <= len(sets) and ("merges", 2) in held
    got = {r["qid"]: r["cluster"] for r in questions.cluster_questions(df, 4).collect()}
    assert got == linked_by_a_loop(sets, 4)


def test_tiles_add_up(monkeypatch):
    """Sums over clusters whose sets lie in several tiles, items in several parts; weights of equal sets."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(questions, "TILE", 4)
    monkeypatch.setattr(questions, "ITEMS", 3)

    def side(n):
        codes = np.unique(rng.integers(0, 5, n), return_inverse=True)[1]
        return [np.unique(rng.integers(0, 12, rng.integers(1, 6))) for _ in range(n)], np.sort(codes), rng.integers(1, 4, n)

    (a, ca, na), (b, cb, nb) = left, right = side(13), side(10)
    want = np.zeros((ca[-1] + 1, cb[-1] + 1), np.int64)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            want[ca[i], cb[j]] += na[i] * nb[j] * round(questions.UNIT * len({*x} & {*y}) / len({*x} | {*y}))
    assert (questions.similarity_sums(left, right) == want).all()


def test_cluster_query_equals_a_loop(spark):
    """The registered clusters over their table, and the topics of each."""
    from citeweave.plans import queries_stats
    from citeweave.plans.bindings import qd

    rows = qd(spark, "/root/testdata/sf0.001")
    sets: dict = {}
    for r in rows.where("cited = 1 AND domain <> ''").collect():
        sets.setdefault(r["qid"], set()).add(r["domain"])
    want: dict = {}
    for q, c in linked_by_a_loop(sets, 4).items():
        want.setdefault(c, set()).add(str(q))
    got = {r["cluster"]: set(r["members"].split(", ")) for r in queries_stats.question_clusters(spark, "/root/testdata/sf0.001").collect()}
    assert {c: m for c, m in got.items() if c >= 0} == want
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("page_id div 20 AS qid", "regexp_extract(url, '^[^:]+://([^/]+)', 1) AS domain", "page_id % 5 < 2 AS cited").where("cited AND domain <> ''")
    sets = {}
    for r in pages.collect():
        sets.setdefault(r["qid"], set()).add(r["domain"])
    got = {r["qid"]: r["cluster"] for r in queries_stats.question_groups(spark, "/root/testdata/sf0.001").collect()}
    assert {q: c for q, c in got.items() if c >= 0} == linked_by_a_loop(sets, 8)


def test_intents(spark, rows):
    s = {r["intent"]: r for r in intent.intent_summary(rows).collect()}
    assert set(s) == {"buy", "Unspecified"} and s["buy"]["n_cited"] == 2 and s["buy"]["top_cited_type"] == "blog"
    # Shares are of all surfaced sources of an intent, cited or not.
    shown = spark.createDataFrame([("buy", "blog", 1), ("buy", "blog", 0), ("buy", "news", 0), ("buy", "news", 0), ("", "shop", 1)], "intent string, source_type string, cited int")
    share = {(r["intent"], r["source_type"]): (r["n"], r["pct"]) for r in intent.intent_row_share(shown).collect()}
    assert share == {("buy", "blog"): (2, 50.0), ("buy", "news"): (2, 50.0), ("Unspecified", "shop"): (1, 100.0)}
    more = spark.createDataFrame([(0, "r", 1, "news", True, False, ["gov", "shop", "press"], "i", "p"), (1, "r", 1, "blog", False, True, [], "i", "p"), (2, "s", 1, "blog", False, False, None, "i", "p")],
                                 "ord int, record_id string, cited int, source_type string, institutional_official boolean, brand_official_candidate boolean, expected_source_types array<string>, intent string, prompt string")
    r, = intent.expected_vs_actual(more).collect()
    assert (r["cited_found"], r["expected_missing"], r["unexpected_cited"], r["coverage"]) == ("gov; press", "shop", "blog", 0.6667)


def test_batch_levels(rows):
    got = {(r["level"], r["name"]) for r in batch.batch_aggregate(rows, ["x"]).collect()}
    assert got == {("overall", "(all)"), ("topic", "T"), ("intent", "buy")}
    assert batch.pool([rows.select("ord"), rows.select("x")]).columns == ["ord", "x"]


def test_brand_denominator_is_non_branded_prompts(spark):
    rec = [("a", 0, True, [], [], []), ("b", 1, True, [], [], []), ("c", 2, None, [], ["acme"], []), ("d", 3, None, ["acme"], ["acme"], [])]
    records = spark.createDataFrame([(r, o, "t", "i", f"prompt {r}", n, p, a, k) for r, o, n, p, a, k in rec], "record_id string, ord int, topic string, intent string, prompt string, nonbranded boolean, prompt_client array<string>, answer_client array<string>, answer_competitor array<string>")
    sources = spark.createDataFrame([("a", 1, True, False), ("b", 0, False, True), ("b", 1, False, False), ("d", 1, True, True)], "record_id string, cited int, client boolean, competitor boolean")
    table = brand.brand_records(records, sources)
    o = brand.overall(table).first()
    assert (o["total_prompts"], o["nonbranded_prompts"], o["client_cited_rate"], o["competitor_more_only_rate"], o["client_appeared_rate"]) == (4, 3, 0.3333, 0.3333, 0.6667)
    assert o["n_client_source_pages"] == 2
    assert [r["topic"] for r in brand.client_vs_competitor(table).orderBy("topic").collect()] == ["(all)", "t"]
    assert brand.by_intent(table).first()["example_prompts"] == "prompt a | prompt b | prompt c"
    kinds = {r["kind"] for r in brand.examples(table).collect()}
    assert "client_cited" in kinds and "competitor_only" in kinds
    page = spark.createDataFrame([(1, True, True, 2, None, "t", "i", 3.0), (0, True, False, None, 12, "t", "i", 1.0), (0, False, True, None, None, "t", "i", None)], "cited int, is_client_source boolean, is_competitor_source boolean, source_position int, observed_rank int, topic string, intent string, f double")
    got = {(r["grp"], r["n_cited"], r["n_more_only"]) for r in brand.cited_vs_more_only(page, ["f"]).collect()}
    assert got == {("all", 1, 1), ("client", 1, 1), ("competitor", 1, 0), ("by_intent", 1, 1)}
    assert {r["position_band"] for r in brand.position_controlled(page, ["f"]).collect()} == {"1-3", "11+", "unknown"}


@pytest.mark.parametrize("few", [50_000, 3])
def test_quantiles_and_medians_equal_numpy(spark, monkeypatch, few):
    from citeweave.operators import ordered, profile

    monkeypatch.setattr(ordered, "FEW", few)
    monkeypatch.setattr(ordered, "HELD", few)
    rng = np.random.default_rng(3)
    groups = {"a": np.round(rng.lognormal(3, 2, 700), 2), "b": np.r_[-np.exp(rng.normal(0, 5, 300)), np.zeros(50)], None: np.full(40, 1e12) + rng.integers(-20, 20, 40), "one": np.array([4.5])}
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("none", None), ("far", float("inf")), ("far", float("-inf")), ("far", 2.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    got = {r["k"]: r for r in profile.box_statistics(df, "k", "v").collect()}
    for k, vs in groups.items():
        r = got[k]
        assert (r["n"], r["low"], r["high"]) == (len(vs), vs.min(), vs.max())
        assert np.allclose([r["q1"], r["mid"], r["q3"]], np.percentile(vs, [25, 50, 75]), rtol=1e-12)
    assert (got["none"]["n"], got["none"]["mid"], got["far"]["mid"]) == (0, None, 2.0)
    sides = df.selectExpr("v", "if(k = 'a', 1, 0) AS cited")
    r = compare.group_compare(sides.where("k IN ('a', 'b')"), ["v"]).first()
    assert (r["cited_median"], r["non_cited_median"]) == (round(float(np.median(groups["a"])), 4), round(float(np.median(groups["b"])), 4))
    assert ordered.quantiles(df.where("false"), ["k"], {"mid": 0.5}, "v").count() == 0


def test_groups_without_values_stay(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "cited int, x double")
    r = compare.group_compare(df, ["x"]).first()
    assert (r["feature"], r["n_cited"], r["n_non_cited"], r["cited_mean"], r["non_cited_median"]) == ("x", 0, 0, None, None)


def test_values_of_one_magnitude_are_dealt_over_bins(spark, monkeypatch):
    """A million times within one day, beside a group with two clusters far apart."""
    from citeweave.operators import ordered

    seconds = F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(86_400))
    near = F.when(F.col("id") % 2 == 0, F.col("id") * 1e-9).otherwise(F.lit(1e12) + F.col("id"))
    df = spark.range(1_000_000).select(F.explode(F.array(F.struct(F.lit("day").alias("k"), seconds.cast("double").alias("value")), F.struct(F.lit("two").alias("k"), near.alias("value")))).alias("x")).select("x.*")
    counts, few = ordered.counted(df, ["k"])
    assert not few
    bins = {r["k"]: (r["bins"], r["most"]) for r in counts.groupBy("k", "bin").count().groupBy("k").agg(F.count("*").alias("bins"), F.max("count").alias("most")).collect()}
    assert bins["day"][0] >= 100 and bins["two"][0] >= 20 and max(m for _, m in bins.values()) <= ordered.FEW
    monkeypatch.setattr(ordered, "HELD", ordered.FEW)
    got = {r["k"]: r for r in ordered.quantiles(df, ["k"], {"q": 0.3, "mid": 0.5}).collect()}
    pdf = df.toPandas()
    for k, r in got.items():
        values = pdf.loc[pdf["k"] == k, "value"].to_numpy()
        assert np.allclose([r["q"], r["mid"]], np.percentile(values, [30, 50]), rtol=1e-12) and r["n"] == 1_000_000


@pytest.mark.parametrize("few", [50_000, 3])
def test_ranks_of_ties_over_bins(spark, monkeypatch, few):
    from citeweave.operators import ordered

    monkeypatch.setattr(ordered, "FEW", few)
    rng = np.random.default_rng(5)
    v = np.r_[rng.integers(-50, 50, 400), rng.normal(0, 1e6, 200)]
    df = spark.createDataFrame([("f", float(x), i % 2) for i, x in enumerate(v)], "feature string, value double, cited int").repartition(5)
    order = np.sort(v)
    want = {float(x): (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2 for x in v}
    assert {r["value"]: r["rank"] for r in stats.average_ranks(df).collect()} == want
    r1 = sum(want[float(x)] for i, x in enumerate(v) if i % 2)
    u = r1 - 300 * 301 / 2
    assert stats.mann_whitney(df.select("cited", "value"), ["value"]).first()["u"] == min(u, 300 * 300 - u)


@pytest.mark.parametrize("few", [50_000, 30])
def test_bootstrap_has_the_distribution_of_drawn_values(spark, monkeypatch, few):
    from citeweave.operators import ordered

    monkeypatch.setattr(ordered, "FEW", few)
    rng = np.random.default_rng(8)
    a, b = rng.normal(10, 3, 400), rng.normal(8, 2, 301)
    df = spark.createDataFrame([(i, int(i < 400), float(x)) for i, x in enumerate(np.r_[a, b])], "ord int, cited int, x double").repartition(3)
    draws = np.random.default_rng(1)
    drawn = [np.median(draws.choice(a, len(a))) - np.median(draws.choice(b, len(b))) for _ in range(1500)]
    got = stats.bootstrap_median_diff(df, ["x"]).first()
    assert got["median_diff"] == round(float(np.median(a) - np.median(b)), 4)
    assert abs(got["ci_low"] - np.percentile(drawn, 2.5)) < 0.12 and abs(got["ci_high"] - np.percentile(drawn, 97.5)) < 0.12
    one = stats.bootstrap_median_diff(df.where("cited = 1 OR ord < 402"), ["x"]).first()
    assert one["median_diff"] is not None and one["ci_low"] is None
    none = stats.bootstrap_median_diff(df.where("cited = 1"), ["x"]).first()
    assert none["median_diff"] is None and none["ci_low"] is None
