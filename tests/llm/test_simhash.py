import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from citeweave.llm import simhash
from citeweave.llm.components import components
from tests.llm.conftest import rows_of


def brute(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(prints):
    root = {p: p for p in prints}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(prints, 2):
        if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def test_masks_cover_every_pair_of_positions():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for r in (0, 1, 2):
        for bits in itertools.combinations(range(64), r):
            d = sum(1 << b for b in bits)
            assert any(m & d == 0 for m in masks)


def test_fingerprints_equal_brute_force(docs):
    got = {(r["doc_id"], r["fingerprint"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(r["doc_id"], f"{brute(r['text']):016x}") for r in docs.collect()}


def test_fingerprint_blocks():
    hs = np.array([random.Random(i).getrandbits(64) for i in range(1000)], np.uint64)
    assert simhash.fingerprint(hs) == simhash.fingerprint(hs, block=7)


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) - (1 << 63) for _ in range(60)}
    for p in list(prints)[:20]:  # chains and stars of close ones, the top bit among them
        for _ in range(6):
            q = p
            for b in rng.sample(range(64), rng.choice((1, 2, 3))):
                q ^= 1 << b if b < 63 else -(1 << 63)
            prints.add(q)
            p = rng.choice((p, q))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.close_edges(df)).collect()}
    want = classes(sorted(prints))
    assert {p: got.get(p, p) for p in prints} == want


def test_document_classes(docs):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(g for g in got if g[0] in (0, 4)) == [(0, 0), (4, 0)]
    assert {c for d, c in got if d in (1, 2, 3)} == {1}  # null, empty and blank texts
    assert [c for d, c in got if d == 5] == [5, 5] and len(got) == docs.count()


def test_keep_first(docs, no_docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
    assert ids == [-1, 0, 1, 5, 6, 7, 8, 9]
    assert simhash.keep_first(no_docs).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 180)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (7, None)]
    df = spark.createDataFrame(path, "a long, b long")
    got = components(df).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert sorted((r["root"], r["n"]) for r in got) == [(100, 81), (1000, 200)]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_id_on_rows_of_different_texts(spark):
    a, b, c = ("the quick brown fox jumps over it", "a text of its own that nobody else holds at all", "yet another one of quite other words here")
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "w"), (7, b, "v"), (8, c, "u"), (8, c, "u"), (None, a, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __fp_ string")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert rows_of(kept, "doc_id", "text") == sorted([(1, a), (5, b), (8, c), (None, a)], key=repr)


def test_an_id_keeps_a_row_for_each_class_it_comes_first_in(spark):
    a, b, c = ("the quick brown fox jumps over it", "a text of its own that nobody else holds at all", "yet another one of quite other words here")
    df = spark.createDataFrame([(5, a), (5, b), (7, b), (9, c), (5, a)], "doc_id long, text string")
    assert rows_of(simhash.keep_first(df), "doc_id", "text") == sorted([(5, a), (5, b), (9, c)])


def test_columns_of_any_name(spark):
    a, b = "the quick brown fox jumps over it", "a text of its own that nobody else holds at all"
    rows = [(1, a, "p", 1, 2, 3), (2, a, "q", 4, 5, 6), (2, b, "r", 7, 8, 9), (3, b, "s", 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, __fp long, __PRINT long, __print_kept long")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
