import random
import zlib
from collections import Counter

import numpy as np
import pytest

from citeweave.llm import bpe, packing, wordtable


@pytest.fixture(scope="module")
def library():
    return bpe.Codec(bpe.default_vocabulary()).library


PLAIN = [" ", "\n", "  ", "a", "the", "é", ".", "!", "'s", "12", " \n ", "aaaa", "don't", "'", "'tis", "\n\n", " '", "ü", "Ab", "3.5%", "'ll", "'L"]
ODD = [*PLAIN, "\t", "\r\n", "<|endoftext|>", "\xa0", "日本", "\x1c", "ſ", "😀", "×", "÷", "\x00"]


def texts_of(parts, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("parts", [PLAIN, ODD])
def test_word_table_equals_the_library(library, parts):
    table = wordtable.WordTable(bpe.default_vocabulary())
    for seed in range(20):
        texts = texts_of(parts, 40, seed)
        for t, got in zip(texts, table.encode([*texts, None])):
            assert got.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_table_that_is_full_or_has_clashes(library, monkeypatch):
    table = wordtable.WordTable(bpe.default_vocabulary(), most=30)
    want = lambda t: library.encode(t, add_special_tokens=False).ids
    for seed in range(10):
        texts = texts_of(PLAIN, 30, seed)
        assert [x.tolist() for x in table.encode(texts)] == [want(t) for t in texts]
    plain = wordtable.WordTable.hashes
    monkeypatch.setattr(wordtable.WordTable, "hashes", lambda *a: plain(*a) & np.uint64(0xF000000000000000))
    table = wordtable.WordTable(bpe.default_vocabulary())
    for seed in range(3):
        texts = texts_of(PLAIN, 30, seed)
        assert [x.tolist() for x in table.encode(texts)] == [want(t) for t in texts]


def test_long_text_in_blocks(library, monkeypatch):
    monkeypatch.setattr(wordtable, "BLOCK", 50)
    table = wordtable.WordTable(bpe.default_vocabulary())
    for t in texts_of(PLAIN, 50, 4) + [" word" * 300, "x" * 500, "\n\n".join(["two words"] * 80)]:
        assert table.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_lengths_are_powers_of_two():
    for n in [*range(1, 300), 1023, 1024, 1025, 5000]:
        sizes = packing.lengths(n, 64)
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and all(s & (s - 1) == 0 and s <= 64 for s in sizes)
        assert all(c == 1 for s, c in Counter(sizes).items() if s < 64)
    assert packing.lengths(1, 1) == [1] and packing.lengths(3, 1) == [1, 1, 1]


def held(packed, docs, library, longest):
    """The pieces of every document, by brute force, and what holds for sequences."""
    rows = packed.collect()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        at, rest = 0, len(ids)
        while rest:
            size = longest if rest >= longest else 1 << rest.bit_length() - 1
            want[r["doc_id"], at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids), tuple(ids[at : at + size])] += 1
            at, rest = at + size, rest - size
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], tuple(r["ids"])) for r in rows) == want
    assert all(r["offset"] == 0 for r in rows)
    rows.sort(key=lambda r: r["sequence_id"])
    assert [r["sequence_id"] for r in rows] == list(range(len(rows)))
    assert [r["length"] for r in rows] == sorted((r["length"] for r in rows), reverse=True)  # bucket by bucket
    batches = {}
    for r in rows:
        batches.setdefault(r["batch_id"], []).append(r["length"])
    assert sorted(batches) == list(range(len(batches)))
    assert all(len(set(x)) == 1 for x in batches.values())
    return batches


def test_table(docs, no_docs, library):
    batches = held(packing.pack_documents(docs, longest=64, batch_tokens=256, with_ids=True), docs, library, 64)
    assert all(sum(x) <= 256 for x in batches.values())
    out = packing.pack_documents(docs)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "batch_id"]
    assert packing.pack_documents(no_docs).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, longest=1000)


def test_query_over_the_table(spark, library):
    from citeweave.llm.queries import op11_pack

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held(packing.pack_documents(docs, with_ids=True), docs, library, 1024)
    got = op11_pack(spark, sf)
    want = packing.pack_documents(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
