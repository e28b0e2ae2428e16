import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeweave.llm import common, lm

SF = "/root/testdata/sf0.01"


def held(c="doc_id"):
    return F.crc32(F.col(c).cast("string")) % 10 == 0


def base_model(rows):
    counts, tokens = collections.Counter(), []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [None]
        tokens.append((i, w))
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    z = np.log10(n + 0.1 * (v + 1))
    return n, [(i, len(w), sum(counts[x] > 0 for x in w), float(sum(np.log10(counts[x] + 0.1) - z for x in w))) for i, w in tokens]


@pytest.mark.parametrize("head", [300_000, 20, 0])
def test_base_score_equals_brute_force(docs, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)  # words beyond the head go through the join
    n, want = base_model([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = lm.score_documents(docs, held()).collect()
    assert {r["train_tokens"] for r in got} == {n}
    key = lambda x: (repr(x[0]), x[1], x[2], round(x[3], 6))
    assert sorted(key((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"])) for r in got) == sorted(map(key, want))
    assert all(r["score"] < 0 for r in got)


def test_empty(no_docs):
    assert lm.score_documents(no_docs, held()).count() == 0


def test_nothing_to_learn_from(docs):
    got = lm.score_documents(docs, F.lit(True)).collect()
    assert {r["train_tokens"] for r in got} == {0} and {r["n_known"] for r in got} == {0}


def test_split_is_ascii_white_space():
    words, sizes = lm.split(pa.array(["  Foo\tBar\x0bÉ  ", "", None, "a\x1cb\xa0c d"]))
    assert words.to_pylist() == ["foo", "bar", "É", "a\x1cb\xa0c", "d"] and sizes.tolist() == [3, 0, 0, 2]


def test_word_table_equals_encoder(monkeypatch):
    monkeypatch.setattr(lm, "CACHE_WORDS", 3)  # cleared again and again
    table = lm.Words(lm.default_ranks())
    for text in ["the cat sat", "a\xa0b the \x1c zz", "naïve 日本 the", "cat"]:
        at, _ = table.read(pa.array([text]))
        assert table.expand(at).tolist() == [x for w in text.split(" ") if w.strip(" ") for x in table.encoder.encode_ordinary(" " + w)]


@pytest.fixture(scope="module")
def trained():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 100, 3000)
    layout = lm.Layout(counts)
    return layout, lm.initial(layout), rng


def test_gradients(trained):
    layout, p, rng = trained
    p = {k: v.astype(np.float64) for k, v in p.items()}
    rows = rng.integers(0, layout.rows, (3, lm.CONTEXT))
    target = rng.integers(-1, layout.classes, (3, lm.STRIDE))
    _, g = lm.gradients(p, rows, target, layout.pad)
    for k in lm.NAMES:
        flat = np.argsort(-np.abs(g[k]).ravel())[:3]
        for i in flat:
            at = np.unravel_index(i, p[k].shape)
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += 1e-5
            up = lm.gradients(q, rows, target, layout.pad)[0]
            q[k][at] -= 2e-5
            down = lm.gradients(q, rows, target, layout.pad)[0]
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3 * max(1, abs(g[k][at])), k


def test_probabilities_sum_to_one_and_are_causal(trained):
    layout, p, rng = trained
    scorer = lm.Scorer(p, layout)
    assert np.allclose(np.bincount(layout.group, weights=10.0**layout.share, minlength=layout.classes)[np.unique(layout.group)], 1.0)
    rows = rng.integers(0, layout.rows - 2, (1, lm.CONTEXT))
    each = np.array([scorer.windows(rows, np.full((1, lm.STRIDE), -1) + (np.arange(lm.STRIDE) == 4) * (c + 1))[0] for c in range(layout.classes)])
    assert abs((10**each).sum() - 1) < 1e-3
    later = rows.copy()
    later[0, lm.STRIDE + 5 :] = 0  # what comes after a target changes nothing
    goal = np.where(np.arange(lm.STRIDE) == 4, 7, -1)[None]
    assert np.isclose(scorer.windows(rows, goal), scorer.windows(later, goal))


def test_each_token_is_scored_once(trained):
    layout, p, rng = trained
    scorer = lm.Scorer(p, layout)
    sizes = np.array([1, lm.STRIDE, lm.STRIDE + 1, 100])
    ids = rng.integers(0, 3000, int(sizes.sum()))
    want, at = [], 0
    for n in sizes:
        seq, total = ids[at : at + n], 0.0
        at += n
        for i, token in enumerate(seq):
            start = i // lm.STRIDE * lm.STRIDE
            inputs = [layout.pad] * lm.STRIDE + [layout.begin] + layout.row[seq].tolist()
            window = (inputs[start : start + lm.CONTEXT] + [layout.pad] * lm.CONTEXT)[: lm.CONTEXT]
            goal = np.full(lm.STRIDE, -1)
            goal[i - start] = layout.group[token]
            total += scorer.windows(np.array([window]), goal[None])[0] + layout.share[token]
        want.append(total)
    assert np.allclose(scorer.score(ids, sizes), want, rtol=1e-4)


def test_model_beats_unigram_of_subwords(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ranks = lm.default_ranks()
    train = docs.where(~held()).select("doc_id", "text")
    counts = np.zeros(lm.subwords(ranks)[1] + 1, np.int64)
    for r in lm.corpus_counts(train, ranks).where("kind = 1").collect():
        counts[r["key"]] = r["n"]
    layout = lm.Layout(counts)
    table = lm.Words(ranks)
    at, sizes = table.read(pa.array([r["text"] for r in docs.where(held()).collect()]))
    ends = np.cumsum(sizes)
    texts = [np.r_[table.expand(at[e - n : e]), table.end] for e, n in zip(ends, sizes)]
    ids, size = np.concatenate(texts), np.array([len(t) for t in texts])
    p = lm.train(lm.training_windows(train, ranks), layout)
    unigram = np.log10((counts + 0.1) / (counts + 0.1).sum())[ids].sum()
    assert lm.Scorer(p, layout).score(ids, size).sum() > unigram + 0.02 * abs(unigram)


def test_every_training_token_is_a_target_once(docs, monkeypatch):
    monkeypatch.setattr(lm, "ROW_WINDOWS", 5)  # long texts go on in further rows
    ranks, training = lm.default_ranks(), docs.where(~held())
    want = {r["key"]: r["n"] for r in lm.corpus_counts(training, ranks).where("kind = 1").collect()}
    goals = np.concatenate([lm.windows_of(np.frombuffer(r["w"], np.int32))[:, lm.STRIDE + 1 :].ravel() for r in lm.training_windows(training, ranks).collect()])
    assert collections.Counter(goals[goals >= 0].tolist()) == want


def plain_score(p, layout, ids):
    """log10 probability of a text's ids, one token at a time, by attention written out."""
    total, d = 0.0, lm.WIDTH
    line = [layout.begin, *layout.row[ids].tolist()]
    for i, token in enumerate(ids):
        start = i // lm.STRIDE * lm.STRIDE - lm.STRIDE  # inputs start .. i, of which those before the text are not seen
        seen = [(k, line[start + k]) for k in range(i - start + 1) if start + k >= 0]
        x = [p["E"][r].astype(float) + p["P"][k] for k, r in seen]
        q, mine = x[-1] @ p["Q"], x[-1]
        a = np.array([q @ (v @ p["K"]) / np.sqrt(d) for v in x])
        a = np.exp(a - a.max())
        a /= a.sum()
        logits = (mine + sum(w * (v @ p["V"]) for w, v in zip(a, x))) @ p["C"] + p["b"]
        total += (logits[layout.group[token]] - logits.max() - np.log(np.exp(logits - logits.max()).sum())) / np.log(10) + layout.share[token]
    return total


def test_scores_equal_a_plain_loop(docs, monkeypatch):
    kept = {}
    rng = np.random.default_rng(3)

    def train(windows, layout, rounds=2):
        kept["p"], kept["layout"] = {k: v + 0.1 * rng.standard_normal(v.shape).astype(np.float32) for k, v in lm.initial(layout).items()}, layout
        return kept["p"]

    monkeypatch.setattr(lm, "train", train)
    rows = docs.where("doc_id IS NULL OR doc_id <> 5")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(rows, held()).collect()}
    encode = lm.subwords(lm.default_ranks())
    for r in rows.collect():
        words = (r["text"] or "").encode().lower().split()
        ids = np.array([x for w in words for x in encode[0].encode_ordinary(" " + w.decode())] + [encode[1]])
        assert np.isclose(got[r["doc_id"]], plain_score(kept["p"], kept["layout"], ids), rtol=1e-4), r["doc_id"]


def test_the_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "UNIT", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    got = []
    for n in (3, 11):
        rows = lm.score_documents(docs.repartition(n), held()).collect()
        got.append(np.array([r["score"] for r in sorted(rows, key=lambda r: r["doc_id"])]))
    assert np.allclose(got[0], got[1], rtol=1e-6)


def test_units_hold_every_window_once(docs, spark, monkeypatch):
    monkeypatch.setattr(lm, "ROW_WINDOWS", 5)
    monkeypatch.setattr(lm, "UNIT", 1_500)
    windows = lm.training_windows(docs.where(~held()), lm.default_ranks())
    flat = lambda lines: sorted(tuple(w) for x in lines for w in lm.windows_of(np.frombuffer(x, np.int32)).tolist())
    units = [r["lines"] for r in lm.training_units(windows, 40_000).collect()]
    assert len(units) > 3 and flat([x for u in units for x in u]) == flat([r["w"] for r in windows.collect()])


def test_gradients_of_extreme_logits_are_finite(trained):
    layout, p, rng = trained
    p = {k: v.copy() for k, v in p.items()}
    p["b"] += 500
    loss, g = lm.gradients(p, rng.integers(0, layout.rows, (3, lm.CONTEXT)), rng.integers(-1, layout.classes, (3, lm.STRIDE)), layout.pad)
    assert np.isfinite(loss) and all(np.isfinite(x).all() for x in g.values())


def test_context_classes_and_passes_do_not_shrink():
    assert (lm.CONTEXT, lm.STRIDE, lm.OWN_CLASSES + lm.SHARED_CLASSES) == (32, 16, 224)
    assert lm.ROUNDS * lm.EPOCHS >= 2


def test_every_target_sees_sixteen_earlier_ids(trained):
    layout, p, rng = trained
    scorer, ids = lm.Scorer(p, layout), rng.integers(0, 900, 64)
    for i in (16, 31, 36, 48):
        other = ids.copy()
        other[i - 16] = (other[i - 16] + 450) % 900
        first = [scorer.score(x[: n + 1], np.array([n + 1]))[0] for x in (ids, other) for n in (i - 1, i)]
        assert abs((first[1] - first[0]) - (first[3] - first[2])) > 1e-9


def test_gradients_do_not_depend_on_the_windows_worked_on_at_one_time(trained, monkeypatch):
    layout, p, rng = trained
    p = {k: v.astype(np.float64) for k, v in p.items()}
    rows, target = rng.integers(0, layout.rows, (70, lm.CONTEXT)), rng.integers(-1, layout.classes, (70, lm.STRIDE))
    rows[40:50, : lm.STRIDE] = layout.pad
    got = []
    for n in (32, 1000):
        monkeypatch.setattr(lm, "GRADIENT_WINDOWS", n)
        got.append(lm.gradients(p, rows, target, layout.pad))
    assert np.isclose(got[0][0], got[1][0]) and all(np.allclose(got[0][1][k], got[1][1][k], rtol=1e-9, atol=1e-15) for k in lm.NAMES)


def test_units_are_stored_in_row_groups_of_a_few(spark, docs, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(lm, "UNIT", 500)
    stored, keep = [], lm.materialise

    def materialise(df, **options):
        stored.append(keep(df, **options))
        return stored[-1]

    monkeypatch.setattr(lm, "materialise", materialise)
    training = docs.where(~held()).coalesce(1)
    lm.train(lm.training_windows(training, lm.default_ranks()), lm.Layout(np.ones(lm.subwords(lm.default_ranks())[1] + 1, np.int64)), rounds=1)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in stored[0].inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) > 4 and max(groups) <= 4


def test_arrow_batches_are_bounded_in_bytes(spark):
    keys = [f"spark.sql.execution.arrow.{k}PerBatch" for k in ("maxRecords", "maxBytes")]
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.unset(keys[1])
        common.configure(spark)
        rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("a"), 1 << 20).cast("binary").alias("w"))
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
        assert max(r["n"] for r in sizes) < common.ARROW_BYTES + (2 << 20)
        spark.conf.set(keys[1], "1m")
        common.configure(spark)
        assert spark.conf.get(keys[1]) == "1m"  # never raised
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
