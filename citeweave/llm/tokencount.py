"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one ragged numpy array of symbol ids.  In each round
every sequence finds its lowest-rank pair, and all occurrences of it (left to right, without
overlap) are merged at once in all sequences; a sequence without a known pair is done.  The
symbols that survive are its tokens.  Merging all occurrences of the lowest rank at once equals
merging one at a time, for a merge's product only takes part in pairs of higher rank.

Counts of pre-tokens are kept in a bounded cache of the worker process.  The library is asked only
for its pre-tokens, never for its token ids.  Strings of added tokens count as one token each, as
the library has it by default.  A ``.model`` vocabulary, whose merges follow scores over whole
texts, is counted by its own library.

Null texts count as empty: zero bytes, zero tokens.  Repeated rows and rows with a null id keep their
own result; an empty table gives an empty result; other columns, whatever their names, play no part.
Very long texts are counted whole; the memory is one text, its pre-tokens and the cache.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citeweave.llm.bpe import ODD, PIECE, _byte_alphabet, default_vocabulary
from citeweave.llm.common import id_text, slices

LIMIT = 1024
CACHE_PIECES = 800_000
_EMPTY = np.int64(-1)


class PairRanks:
    """(left id, right id) -> rank and product, as an open-addressing table in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, product: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(left) + 16))))
        size = 1 << self.bits
        self.keys, self.rank, self.product = np.full(size, _EMPTY), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
        key = (left << 32) | right
        slot, todo = self._slot(key), np.arange(len(key))
        self.probes = 0
        while len(todo):  # one key takes each free slot; the others move on by one
            self.probes += 1
            at = slot[todo]
            free = self.keys[at] == _EMPTY
            first = np.zeros(len(todo), bool)
            first[np.unique(np.where(free, at, -1), return_index=True)[1]] = True
            win = first & free
            self.keys[at[win]], self.rank[at[win]], self.product[at[win]] = key[todo[win]], todo[win], product[todo[win]]
            todo = todo[~win]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        slot = self._slot(key)
        out, todo = np.full(len(key), -1, np.int64), np.arange(len(key))
        for _ in range(self.probes):
            at = slot[todo]
            kept = self.keys[at]
            hit = kept == key[todo]
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (kept != _EMPTY)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return out


def merge_counts(symbols: np.ndarray, lengths: np.ndarray, ranks: PairRanks) -> np.ndarray:
    """Symbols left of each ragged sequence after all merges."""
    n = len(lengths)
    owner = np.repeat(np.arange(n), lengths)
    ids = symbols.astype(np.int64)
    counts = lengths.astype(np.int64).copy()
    far = np.iinfo(np.int64).max
    while len(ids) > 1:
        slot = ranks.find((ids[:-1] << 32) | ids[1:])
        slot[owner[:-1] != owner[1:]] = -1
        rank = np.where(slot >= 0, ranks.rank[slot], far)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(np.r_[rank, far], starts)
        mine = np.repeat(lowest, np.diff(np.r_[starts, len(ids)]))
        hit = (rank == mine[:-1]) & (rank < far)
        if not hit.any():
            break
        # Of a run of overlapping hits (a a a), every other one from its start on is merged.
        at = np.flatnonzero(hit)
        runs = np.cumsum(np.r_[True, np.diff(at) > 1]) - 1
        first = at[np.r_[True, np.diff(at) > 1]]
        at = at[(at - first[runs]) % 2 == 0]
        ids[at] = ranks.product[slot[at]]
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        # Sequences that had no known pair, or are down to one symbol, leave the arrays.
        busy = mine < far
        counts -= np.bincount(owner[at], minlength=n)
        stay &= busy
        ids, owner = ids[stay], owner[stay]
    return counts


class Counter:
    """Tokens of whole texts under a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        alphabet = _byte_alphabet()
        self.first = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        side = lambda k: np.array([vocab[p[k]] for p in pairs], np.int64)
        self.ranks = PairRanks(side(0), side(1), np.array([vocab[a + b] for a, b in pairs], np.int64))
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.encoded = {c: b for c, b in alphabet.items()}
        self.known: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> None:
        """Counts of distinct pieces, merged as one batch."""
        plain = [p for p in pieces if not p.isspace()]
        # "\\n" stands apart from the pieces on both sides of it, so one call splits them all.
        owner, words = [], []
        at = 0
        for word, _ in self.split("\n".join(plain)) if plain else []:
            if word == "Ċ":
                at += 1
            else:
                owner.append(at)
                words.append(word)
        for p in pieces:
            if p.isspace():
                for word, _ in self.split(p):
                    owner.append(len(plain))
                    words.append(word)
                plain.append(p)
        if not words:
            return
        # Byte-level pre-tokens write each byte as one character of the alphabet.
        data = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        to_id = np.zeros(1024, np.int64)
        for c, b in self.encoded.items():
            to_id[ord(c)] = self.first[b]
        counts = merge_counts(to_id[data], np.fromiter(map(len, words), np.int64, len(words)), self.ranks)
        totals = np.bincount(np.array(owner), weights=counts, minlength=len(plain)).astype(np.int64)
        self.known.update(zip(plain, totals.tolist()))

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; the new pieces of all of them are merged together."""
        parts, extra = [], []
        for t in texts:
            special = self.added.findall(t) if t and self.added else []
            runs = self.added.split(t) if special else [t or ""]
            found: list[str] = []
            for r in runs:
                found += self.whole(r) if ODD.search(r) else PIECE.findall(r)
            parts.append(found)
            extra.append(len(special))
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known = self.known
        got = [list(map(known.get, p)) for p in parts]
        missing = {w for p, g in zip(parts, got) if None in g for w, n in zip(p, g) if n is None}
        if missing:
            self.learn(sorted(missing))
            got = [list(map(known.get, p)) if None in g else g for p, g in zip(parts, got)]
        return [sum(g) + x for g, x in zip(got, extra)]

    def whole(self, run: str) -> list[str]:
        """Pre-tokens of a text with unusual white space, split by the library; each is its own piece."""
        return [run[a:b] for _, (a, b) in self.split(run)]


@functools.lru_cache(maxsize=2)
def counter_for(path: str) -> Counter:
    return Counter(path)


def count_texts(texts: list[str | None], path: str) -> list[int]:
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(x) for x in pieces.encode([t or "" for t in texts], num_threads=1)]
    return counter_for(path).count_all(texts)


def count_tokens(documents: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.  Map-only; the memory is one slice and the cache."""
    import citeweave.llm.tokencount as own

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or own.default_vocabulary()
        for batch in slices(batches):
            n = own.count_texts(batch.column("text").to_pylist(), path)
            size = pa.compute.binary_length(batch.column("text")).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_text(documents, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
