import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from citeweave.llm import periodic


def brute(w):
    """Every maximal stretch of every period, kept if no shorter period fits it."""
    n, out = len(w), []
    for q in range(1, n + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    k = rng.choice([1, 2, 3, 5, 20])
    w = [rng.randrange(k) for _ in range(rng.randrange(20))]
    for _ in range(rng.randrange(4)):
        b = [rng.randrange(k) for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.3:
            b = b * rng.randrange(1, 6) + [rng.randrange(k)]
        w += b * rng.randrange(1, 8) + [rng.randrange(k) for _ in range(rng.randrange(6))]
    return w


@pytest.mark.parametrize("cost", [0.0, 1e-3, 0.2, 1e9])  # all words heavy, some, few, none
def test_counts_and_runs_equal_brute_force(monkeypatch, cost):
    monkeypatch.setattr(periodic, "FFT_COST", cost)
    rng, found = random.Random(int(cost * 1000)), 0
    for _ in range(500):
        w = random_words(rng)
        if w:
            most = max(1, len(w) // 4)
            assert periodic.lag_counts(np.array(w), most).tolist() == [sum(w[i] == w[i + q] for i in range(len(w) - q)) for q in range(most + 1)]
        got = periodic.find_runs(np.array(w, np.int64))
        assert got == brute(w)
        found += len(got)
    assert found > 300


def test_kept_words():
    #       0  1  2  3  4  5  6  7
    w = [9, 1, 1, 1, 1, 1, 1, 2]
    runs = periodic.find_runs(np.array(w))
    assert runs == [(1, 6, 1)]
    assert periodic.kept_words(8, runs).tolist() == [True, True, False, False, False, False, False, True]


def test_long_repeats_take_their_time_only():
    rng = np.random.default_rng(0)
    cases = {"one": (np.zeros(300_000, np.int64), [(0, 300_000, 1)]), "two": (np.arange(100_000) % 2, [(0, 100_000, 2)]), "free": (rng.integers(0, 100_000, 300_000), [])}
    block = rng.integers(0, 1000, 20_000)
    cases["block"] = (np.tile(block, 5), [(0, 100_000, 20_000)])
    for name, (w, want) in cases.items():
        began = time.time()
        assert periodic.find_runs(np.asarray(w, np.int64)) == want, name
        assert time.time() - began < 30, name


def expected(doc_id, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(listed), digest(kept))


def test_table(spark, docs, no_docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(120)))) for i in range(150)]
    rows += [(500, "x " * 300), (501, "a\tb\nc\x0bd\x0ce\rf " * 9), (502, "a\xa0b " * 8 + "a\x1cb " * 8), (None, "y y y y y y y"), (503, None), (503, ""), (10, "z z z z z"), (11, "w w w w w w")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, length int, runs string")
    got = sorted(map(tuple, periodic.periodic_runs(df, loops=True).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in rows), key=repr)
    assert periodic.periodic_runs(no_docs, loops=True).count() == 0
    assert periodic.periodic_runs(docs).count() == docs.count()
    one = periodic.periodic_runs(df.where("doc_id = 500"), with_text=True).first()
    assert [tuple(r) for r in one["runs"]] == [(0, 300, 1)] and one["collapsed"] == "x"


def test_query_equals_brute_force(spark):
    from citeweave.llm.queries import op13_periodic_runs

    sf = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = {r["doc_id"]: r["text"] for r in docs if len(r["text"] or "") < 3000}  # brute force is quadratic
    got = {r["doc_id"]: tuple(r) for r in op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    assert {i: got[i] for i in short} == {i: expected(i, t) for i, t in short.items()}
    assert any(got[i][1] for i in short)
