"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its bytes matches a mask, so equal passages give equal chunks
wherever they stand.  A task keeps the ids of the chunks it has met (bounded, oldest go first) and
encodes a chunk once; the ids of neighbouring chunks are then joined and each join is repaired: the
pieces around it are encoded again as one, reaching further out until both ends agree with the
stored ids.  ``encode_documents`` first deals the documents by the least hash of their chunks
(a MinHash of the chunk set), so copies and near copies meet in one task, next to each other.

Exactness: the pre-tokenizer splits text into pieces ``\\s+(?!\\S)| ?\\S+|\\s`` that no merge ever
crosses, so a token list can be cut between pieces.  A chunk is stored by its pieces; the repair
window begins and ends at a piece.  Where a text holds white space outside the plain set, or an
added token's string, the run up to the next plain word on either side is cut out and encoded by
the library; the rest goes by chunks.

Null texts count as empty: no ids.  Repeated rows each get their own result, null ids too; an empty
table gives an empty result; other columns, whatever their names, play no part.  Very long texts are
handled chunk by chunk; the memory is one text, its ids and the bounded cache.  ``chunk_reuse`` tells
how many chunks a table's tasks meet and how many of them they encode.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm.common import id_text, slices

#: Rolling hash: window in bytes, mask (one boundary in about 2,048 bytes), least and largest chunk.
ROLL, MASK, LEAST, MOST = 16, (1 << 11) - 1, 256, 1 << 14
PRIME = 0x9E3779B97F4A7C15
CACHE_CHUNKS, CACHE_PIECES = 2_000, 300_000
#: Pieces at either end of a stored chunk that stay apart; those between are stored as one.
EDGE = 16

PIECE = re.compile(r"\s+(?!\S)| ?\S+|\s")
#: Text on which all libraries agree about letters, digits and space.
LATIN = re.compile("[\n -~\u00c0-\u024f]*")
#: Between two plain words: the one space there begins a piece, whatever stands further off.
CUT = re.compile(r"(?<=[!-~])(?= [!-~])")
#: Characters whose class differs between regular-expression libraries, or that some call space.
ODD = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0 ᠎ -‏ -  -⁤　﻿]")


def boundaries(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data`` (the last is its length)."""
    n = len(data)
    if n <= max(LEAST, ROLL):
        return [n] if n else []
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    h, power = np.zeros(n - ROLL + 1, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(ROLL):  # h[i] = sum of data[i + ROLL - 1 - j] * PRIME^j
            h += b[ROLL - 1 - j : n - j] * power
            power = np.uint64((int(power) * PRIME) & 0xFFFFFFFFFFFFFFFF)
    hits = np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + ROLL
    out, at = [], 0
    for x in hits.tolist():
        while x - at > MOST:
            at += MOST
            out.append(at)
        if x - at >= LEAST and x < n:
            out.append(x)
            at = x
    while n - at > MOST:
        at += MOST
        out.append(at)
    return [*out, n]


def chunks(text: str) -> list[str]:
    """Content-defined chunks of ``text``; a boundary within a character moves to its end."""
    data = text.encode()
    out, at = [], 0
    for end in boundaries(data):
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if end > at:
            out.append(data[at:end].decode())
            at = end
    return out


class Codec:
    """Encodes and decodes whole texts as the library does, reusing chunks and pieces."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.added = [t["content"] for t in spec["added_tokens"]]
        # Added tokens that reach beyond their own string leave no place to cut.
        reach = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in spec["added_tokens"])
        odd = "|".join([ODD.pattern, *map(re.escape, sorted(self.added, key=len, reverse=True))])
        self.odd, self.whole = re.compile(odd), reach
        self.met = self.encoded = 0
        alphabet = _byte_alphabet()
        self.bytes = {i: t.encode() if t in self.added else bytes(alphabet[c] for c in t) for t, i in self.library.get_vocab().items()}
        newline = self.library.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None
        self.quick = self._rank_encoder(spec)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, list] = {}

    def _rank_encoder(self, spec: dict):
        """A rank encoder of the same vocabulary, which is faster on new pieces; None unless ids follow
        the order of the merges, as such an encoder needs."""
        import public_tokenizers
        import tiktoken

        vocab = spec["model"]["vocab"]
        merged = ["".join(m.split(" ")) if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        if [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))):
            return None
        ranks = {self.bytes[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    # -- pieces: what no merge crosses, encoded by the library and kept as little-endian ids
    def _learn(self, pieces: set[str]) -> None:
        plain = [p for p in pieces if not p.isspace()] if self.newline is not None else []
        if plain:
            line = "\n".join(plain)
            if self.quick is not None and LATIN.fullmatch(line):
                ids = self.quick.encode_to_numpy(line, disallowed_special=()).astype("<u4")
            else:
                ids = np.array(self.library.encode(line, add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.newline)
            if len(cuts) == len(plain) - 1:
                raw, at = ids.tobytes(), 0
                for p, c in zip(plain, [*cuts.tolist(), len(ids)]):
                    self.pieces[p] = raw[4 * at : 4 * c]
                    at = c + 1
        for p in pieces:
            if p not in self.pieces:
                self.pieces[p] = self._library(p)

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, text: str) -> tuple[list[str], list[bytes]]:
        """Pieces of ``text`` and the ids of each."""
        parts = PIECE.findall(text)
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        known = self.pieces
        ids = list(map(known.get, parts))
        if None in ids:
            self._learn(set(parts).difference(known))
            ids = list(map(known.get, parts))
        return parts, ids

    def _chunk(self, chunk: str) -> list:
        """Pieces and their ids of a chunk, encoded once; the pieces between its edges are held as one."""
        found = self.chunks.get(chunk)
        self.met += 1
        if found is None:
            self.encoded += 1
            if len(self.chunks) >= CACHE_CHUNKS:
                for old in list(self.chunks)[: CACHE_CHUNKS // 2]:
                    del self.chunks[old]
            parts, ids = self._encode(chunk)
            if len(parts) > 2 * EDGE + 1:
                fold = lambda x, empty: [*x[:EDGE], empty.join(x[EDGE:-EDGE]), *x[-EDGE:]]
                parts, ids = fold(parts, ""), fold(ids, b"")
            found = self.chunks[chunk] = [parts, ids]
        return found

    def runs(self, text: str) -> list[tuple[bool, str]]:
        """(odd, run): the runs around odd characters and added tokens, cut between plain words, and the rest."""
        odd = [m.span() for m in self.odd.finditer(text)]
        if not odd:
            return [(False, text)]
        if self.whole:
            return [(True, text)]
        cuts = np.array([0, *(m.start() for m in CUT.finditer(text)), len(text)])
        spans = np.array(odd)
        first, last = np.searchsorted(cuts, spans[:, 0], "right") - 1, np.searchsorted(cuts, spans[:, 1])
        out, at = [], 0
        for a, b in sorted(set(zip(cuts[first].tolist(), cuts[last].tolist()))):
            if out and a < at:  # shares a run with the one before
                out[-1] = (True, out[-1][1] + text[at:b])
            else:
                out += [(False, text[at:a])] * (a > at) + [(True, text[a:b])]
            at = max(at, b)
        return out + [(False, text[at:])] * (at < len(text))

    def ids(self, text: str | None) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        out = []
        for odd, run in self.runs(text):
            if not odd:
                out.append(self._plain(run))
            elif (ids := self.pieces.get(run)) is None:
                out.append(self._library(run))
                if len(run) <= 256:
                    self.pieces[run] = out[-1]
            else:
                out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        out: list[bytes] = []
        tail: list[str] = []  # pieces at the end of what is in ``out``, by which a join is repaired
        for chunk in chunks(text):
            parts, ids = self._chunk(chunk)
            if not out:
                out, tail = list(ids), list(parts)
                continue
            back = fore = 1
            while True:  # reach further out until both ends of the window agree with the stored ids
                back, fore = min(back, len(tail)), min(fore, len(parts))
                window, again = self._encode("".join(tail[len(tail) - back :]) + "".join(parts[:fore]))
                left = back == len(tail) or (len(window) > 1 and window[0] == tail[len(tail) - back] and again[0] == out[len(out) - back])
                right = fore == len(parts) or (len(window) > 1 and window[-1] == parts[fore - 1] and again[-1] == ids[fore - 1])
                if left and right:
                    break
                back, fore = back + (0 if left else 2), fore + (0 if right else 2)
            out[len(out) - back :] = [*again, *ids[fore:]]
            # Pieces before this chunk's first untouched one can still be needed by a short next chunk.
            tail = [*tail[max(0, len(tail) - back - 8) : len(tail) - back], *window, *parts[fore:]]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The library's decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _byte_alphabet() -> dict[str, int]:
    """Character by which byte-level vocabularies write a byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def codec_for(path: str) -> Codec:
    """One codec a worker process, so that its caches outlive a task."""
    return Codec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def with_route(documents: DataFrame) -> DataFrame:
    """(doc_id, text, route): the least hash of a text's chunks, by which texts that share most chunks
    meet, as likely as their sets of chunks overlap; a text without chunks goes by its id."""
    import citeweave.llm.bpe as own

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            routes = [min((xxhash.xxh64_intdigest(c.encode()) >> 1 for c in own.chunks(t)), default=None) if t else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(routes, pa.int64())], names=["doc_id", "text", "route"])

    return documents.mapInArrow(scan, "doc_id long, text string, route long").withColumn("route", F.coalesce("route", F.xxhash64("doc_id")))


def _dealt(documents: DataFrame) -> DataFrame:
    # Rebalanced by route: Spark splits a route that is too large for one task, and joins small ones.
    return with_route(documents).hint("rebalance", "route").sortWithinPartitions("route")


def encode_documents(documents: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text (``with_ids``: the ids too) for every row."""
    import citeweave.llm.bpe as own

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = own.codec_for(vocabulary or own.default_vocabulary())
        for batch in slices(batches):
            ids = [codec.ids(t) for t in batch.column("text").to_pylist()]
            digest = lambda x: hashlib.sha256(x).hexdigest()
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([digest(x) for x in ids], pa.string()),
                       pa.array([digest(codec.decode(x).encode()) for x in ids], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
                values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _dealt(id_text(documents, id_col, text_col)).mapInArrow(code, _SCHEMA + (", ids array<int>" if with_ids else ""))


def decode_ids(rows: DataFrame, vocabulary: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``rows`` with the decoded ``text`` of an array of ids (null ids: null text)."""
    import citeweave.llm.bpe as own

    @F.pandas_udf(T.StringType())
    def text(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = own.codec_for(vocabulary or own.default_vocabulary())
        for s in it:
            yield s.map(lambda x: None if x is None else codec.decode(np.asarray(x, "<u4").tobytes()))

    return rows.withColumn("text", text(F.col(ids_col)))


def chunk_reuse(documents: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (chunks, encoded): chunks that the tasks of ``encode_documents`` meet, and those among
    them that they encode; the others are reused."""
    import citeweave.llm.bpe as own

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = own.Codec(vocabulary or own.default_vocabulary())
        for batch in slices(batches):
            for t in batch.column("text").to_pylist():
                codec.ids(t)
        yield pa.RecordBatch.from_arrays([pa.array([codec.met], pa.int64()), pa.array([codec.encoded], pa.int64())], names=["met", "encoded"])

    dealt = _dealt(id_text(documents, id_col, text_col))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return dealt.mapInArrow(count, "met long, encoded long").agg(zero("met").alias("chunks"), zero("encoded").alias("encoded"))
