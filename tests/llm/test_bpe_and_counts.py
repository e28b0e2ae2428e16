import hashlib
import random

import numpy as np
import pytest

from citeweave.llm import bpe, tokencount


@pytest.fixture(scope="module")
def library():
    return bpe.Codec(bpe.default_vocabulary()).library


def samples(n, seed):
    rng = random.Random(seed)
    parts = [" ", "\n", "  ", "a", "b", "the", "é", ".", "!", "'s", "\t", "\r\n", "<|endoftext|>", "12", "\xa0", "日本", "x" * 5, " \n ", "aaaa", "\x1c", "ſ", "　", "don't", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_ids_equal_the_library(library, monkeypatch, small):
    if small:  # boundaries everywhere, so that nearly every join is repaired
        monkeypatch.setattr(bpe, "LEAST", 1)
        monkeypatch.setattr(bpe, "MASK", 3)
        monkeypatch.setattr(bpe, "ROLL", 2)
    codec = bpe.Codec(bpe.default_vocabulary())
    for s in samples(800, 3):
        want = library.encode(s, add_special_tokens=False).ids
        got = codec.ids(s)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(s)
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_long_text_reuses_chunks(library):
    codec = bpe.Codec(bpe.default_vocabulary())
    passage = " ".join(f"shared passage number {i} of words" for i in range(2000))
    a, b = "start one. " + passage, "another beginning, longer than the first; " + passage + " end"
    for t in (a, b, "x" * 50_000):
        assert np.frombuffer(codec.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    shared = set(bpe.chunks(a)) & set(bpe.chunks(b))
    assert sum(map(len, shared)) > 0.8 * len(passage)


def test_boundaries_join_to_the_text():
    for t in ["", "a", "é" * 1000, "ab " * 20_000]:
        assert "".join(bpe.chunks(t)) == t


def test_codec_table(docs, no_docs, library):
    out = bpe.encode_documents(docs, with_ids=True)
    texts = sorted((r["text"] or "" for r in docs.collect()))
    got = out.collect()
    want = sorted(hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for t in texts)
    assert sorted(r["ids_sha256"] for r in got) == want
    assert sorted(r["decoded_sha256"] for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert sorted(r["text"] for r in bpe.decode_ids(out).collect()) == texts
    assert bpe.encode_documents(no_docs).count() == 0


def test_counts_equal_the_library(library):
    s = samples(1500, 9) + ["", None, "aaaaaaaaaaaaaaaaaaaaaaa", "x" * 30_000]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in s]
    assert tokencount.Counter(bpe.default_vocabulary()).count_all(s) == want


def test_merge_of_overlapping_pairs():
    ranks = tokencount.PairRanks(np.array([1, 2]), np.array([1, 2]), np.array([2, 3]))
    counts = tokencount.merge_counts(np.array([1] * 5 + [1, 1] + [7]), np.array([5, 2, 1]), ranks)
    assert counts.tolist() == [2, 1, 1]  # 11111 -> 2 2 1 -> 3 1


def test_count_table(docs, no_docs, library):
    got = sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(docs).collect())
    want = sorted((len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for t in (r["text"] for r in docs.collect()))
    assert got == want and tokencount.count_tokens(no_docs).count() == 0


def test_piece_model():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["Hello world", "", None, "日本語 text"]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert tokencount.count_texts(texts, path) == [len(model.encode(t or "")) for t in texts]


def test_odd_characters_are_cut_out(library):
    codec = bpe.Codec(bpe.default_vocabulary())
    plain = " ".join(f"word{i % 97} and some more text, line {i}." for i in range(400))
    lines = "\r\n".join(["The first line of the text", "and  the second one ", " third\xa0here", "x", "", "<|endoftext|> end it's here"] * 30)
    for t in (lines, plain + "\r\n" + plain, plain + " <|endoftext|>" + plain, "\ufeff" + plain, plain + "\u200b", "a \xa0 b", "\r", "a\r b", "a \r", "it 's\r it's x\r\ny"):
        assert np.frombuffer(codec.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]
        assert "".join(r for _, r in codec.runs(t)) == t
    odd = [r for o, r in codec.runs(plain + "\r\n" + plain) if o]
    assert len(odd) == 1 and len(odd[0]) < 30  # the rest goes by chunks


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_the_library(library, seed):
    rng = random.Random(seed)
    parts = [" ", " a", " the", "b", "\r", "\r\n", "\xa0", " 1", "'s", " !", "<|endoftext|>", "<|endo", "\u3000", "  ", "\n", "é", " É", "日"]
    codec = bpe.Codec(bpe.default_vocabulary())
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(codec.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_copies_cost_one_encoding(spark):
    text = " ".join(f"token{i * 7919 % 5003} of text {i}" for i in range(3000))
    df = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").repartition(4)
    r = bpe.chunk_reuse(df).first()
    assert r["chunks"] == 40 * len(bpe.chunks(text)) and r["encoded"] <= 4 * len(bpe.chunks(text))
    one = bpe.Codec(bpe.default_vocabulary())
    assert len({one.ids(text) for _ in range(3)}) == 1 and one.encoded == len(bpe.chunks(text)) == one.met // 3
    assert tuple(bpe.chunk_reuse(df.limit(0)).first()) == (0, 0)
