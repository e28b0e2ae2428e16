import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citeweave.llm import embeddup


def exact(x):
    s = x @ x.T >= embeddup.THRESHOLD
    np.fill_diagonal(s, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min([root[i], *root[s[i]]]) for i in range(len(x))])
        if (new == root).all():
            return s.sum(axis=1), root
        root = new


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((250, 16))
    near = [base[i % 20] + 0.12 * rng.standard_normal(16) for i in range(200)]
    x = np.concatenate([base, near, np.repeat(base[:1], 60, axis=0)])
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    bad = [(9001, None), (9002, [0.0] * 16), (9003, [1.0] * 15 + [None]), (9004, [float("nan")] * 16), (9005, [float("inf")] + [0.0] * 15), (9006, [1.0, 2.0]), (9007, [])]
    return x, spark.createDataFrame(rows + [(i, v, 1, "y") for i, v in bad], "vec_id long, embedding array<double>, n_links int, kept string")


def test_links_and_components(vectors):
    x, df = vectors
    n, root = exact(x / np.linalg.norm(x, axis=1, keepdims=True))
    got = {r["vec_id"]: r for r in embeddup.near_duplicates(df).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.98 * n.sum()
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(x))]) > 0.98
    for i in range(9001, 9008):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert len(got) == df.count()


def test_audit(vectors):
    _, df = vectors
    rows = embeddup.audit_recall(df, embeddup.near_duplicates(df), every=10).collect()
    assert len(rows) > 40 and sum(r["n_links"] for r in rows) >= 0.9 * sum(r["true_links"] for r in rows)


def test_large_shards_are_dealt_anew(vectors, monkeypatch):
    x, df = vectors
    monkeypatch.setattr(embeddup, "CENTRES", 2)
    monkeypatch.setattr(embeddup, "MOST", 60)
    n, _ = exact(x / np.linalg.norm(x, axis=1, keepdims=True))
    got = embeddup.near_duplicates(df.where("vec_id < 9000")).agg(F.sum("n_links")).first()[0]
    assert 0.95 * n.sum() <= got <= n.sum()


def test_vectors_no_centre_tells_apart_are_dealt_by_hash(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "MOST", 50)
    monkeypatch.setattr(embeddup, "LEVELS", 1)
    x = unit(np.ones((200, 8)) + 1e-12 * np.random.default_rng(9).standard_normal((200, 8)))
    links_equal(spark, np.unique(x, axis=0))


def test_lengths_stand_apart(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [1.0, 2.0]), (4, [1.0, 2.001]), (5, [1.0, 2.0, 0.0]), (6, [7.0]), (15, [1.0, -5.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), 15: (0, 15)}


def test_empty_repeats_and_null_ids(spark):
    schema = "vec_id long, embedding array<double>"
    assert embeddup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [2.0, 0.0]), (None, [0.0, 1.0])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(5, 3, 5), (5, 3, 5), (None, 3, 5), (7, 3, 5), (None, 0, None)], key=repr)


def test_scale_does_not_matter():
    assert np.allclose(embeddup.clean([3e300, 4e300]), [0.6, 0.8]) and np.allclose(embeddup.clean([3e-300, 4e-300]), [0.6, 0.8])


def test_robust_prune_keeps_near_and_bounded():
    x = np.random.default_rng(0).standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = embeddup.robust_prune(x)
    s = x @ x.T - 3 * np.eye(300)
    assert all(len(a) <= 2 * embeddup.DEGREE for a in lists) and all(s[i].argmax() in a for i, a in enumerate(lists))
    assert [len(a) for a in embeddup.robust_prune(x[:1])] == [0] and embeddup.robust_prune(x[:0]) == []


def test_search_is_by_the_graph():
    """What lists do not lead to is not reached, however near."""
    x = unit(np.random.default_rng(1).standard_normal((40, 8)))
    x[20:] = x[:20] + 1e-3
    x = unit(x)
    ring = np.arange(20)
    lists = (np.arange(1, 41), np.r_[(ring + 1) % 20, 20 + (ring + 1) % 20])
    _, seen = embeddup.reach(x[:20], x, lists, ring, 0)
    assert seen[:, :20].all() and not seen[:, 20:].any()


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def links_equal(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    result = embeddup.near_duplicates(df)
    n, root = exact(x)
    got = {r["vec_id"]: r for r in result.collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == n.tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == root.tolist()
    assert all(r["n_links"] == r["true_links"] for r in embeddup.audit_recall(df, result, every=10).collect())


def test_dense_group_above_a_shard_keeps_all_links(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "SHARD", 20)
    monkeypatch.setattr(embeddup, "MOST", 80)
    rng = np.random.default_rng(5)
    centre = unit(rng.standard_normal(32))
    group = unit(centre + 0.02 * rng.standard_normal((400, 32)))  # 20 * SHARD near copies
    links_equal(spark, unit(np.concatenate([group, rng.standard_normal((100, 32))])))


def test_two_tight_groups_in_one_shard_find_each_other(spark):
    rng = np.random.default_rng(6)
    a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    angle = np.arccos(0.96)
    ends = [a, np.cos(angle) * a + np.sin(angle) * b]
    links_equal(spark, unit(np.concatenate([unit(rng.standard_normal((50, 32))), *[e + 1e-3 * rng.standard_normal((150, 32)) for e in ends]])))


def test_recall_at_size_with_a_dense_ball(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "MOST", 1_500)
    rng = np.random.default_rng(7)
    centre = unit(rng.standard_normal(24))
    ball = unit(centre + 0.03 * rng.standard_normal((2_000, 24)))  # above MOST
    pairs = unit(rng.standard_normal((1_500, 24)))
    near = unit(pairs + 0.04 * rng.standard_normal((1_500, 24)))
    x = unit(np.concatenate([ball, pairs, near, rng.standard_normal((15_500, 24))]))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>").repartition(8)
    audit = embeddup.audit_recall(df, embeddup.near_duplicates(df)).toPandas()
    assert len(audit) == 205 and (audit["n_links"] <= audit["true_links"]).all()
    assert audit["n_links"].sum() >= 0.98 * audit["true_links"].sum() and audit["true_links"].sum() > 20 * 1_900
    rest = audit[(audit["vec_id"] >= 2_000) & (audit["true_links"] > 0)]
    assert len(rest) and rest["n_links"].sum() >= 0.9 * rest["true_links"].sum()
