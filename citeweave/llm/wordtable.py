"""Token ids of many texts at once, by a table of words in numpy arrays.

The texts of a batch are laid end to end as bytes and cut where a pre-token surely begins: before a
run of white space, before the last character of such a run, behind a line end, and between letters
and other characters except behind an apostrophe.  Every piece is keyed by a polynomial hash, taken
from one running sum over the batch, and looked up in an open-addressing table; the piece's bytes
are then compared with the stored ones, so a clash of hashes costs time and never a wrong id.  New
pieces are encoded once, all of a batch in one call of a rank encoder.

Only texts of plain Latin letters, printable ASCII, spaces and line ends take this way.  All others
go to ``bpe.Codec``, which agrees with the library on any text.
"""

from __future__ import annotations

import functools

import numpy as np

from citeweave.llm.bpe import CUT, LATIN, Codec

#: Pieces kept by a worker; a full table begins anew with the batch that does not fit.
MOST = 1_000_000
#: Characters of a text that are cut and looked up at one time.
BLOCK = 1 << 20
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)
SPACE, LETTER, OTHER, END = 1, 2, 3, 0


def _classes() -> np.ndarray:
    out = np.full(256, LETTER, np.uint8)  # bytes of letters above ASCII
    out[:128] = OTHER
    out[[10, 32]] = SPACE
    out[65:91] = out[97:123] = LETTER
    out[0] = END
    return out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one run behind the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordTable:
    def __init__(self, path: str, most: int = MOST):
        self.codec, self.most, self.kind = Codec(path), most, _classes()
        self.power = self.back = np.ones(1, np.uint64)
        self.bits = int(np.ceil(np.log2(2 * max(most, 2 * BLOCK) + 16)))  # a batch fits, whatever its pieces
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)  # the piece in each slot
        self.hash = np.zeros(0, np.uint64)
        self.text, self.at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.first, self.count = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def plain(self, text: str) -> bool:
        return bool(LATIN.fullmatch(text)) and "×" not in text and "÷" not in text and not any(a in text for a in self.codec.added) and self.codec.quick is not None and self.codec.newline is not None

    # -- cutting and hashing
    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Starts of the pieces of ``b``, whose texts end with a zero byte each."""
        k = self.kind[b]
        a, c = k[:-1], k[1:]
        ahead = np.r_[k[2:], END]
        space, other = c == SPACE, c == OTHER
        new = (space & ((a != SPACE) | (ahead >= LETTER))) | ((b[:-1] == 10) & ~space) | ((a == LETTER) & other) | ((a == OTHER) & (c == LETTER) & (b[:-1] != 39)) | (a == END) | (c == END)
        return np.r_[0, np.flatnonzero(new) + 1]

    def hashes(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.power) < len(b):
            grow = lambda p: np.cumprod(np.r_[np.uint64(1), np.full(2 * len(b), p, np.uint64)])
            self.power, self.back = grow(np.uint64(PRIME)), grow(np.uint64(INVERSE))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * self.power[: len(b)], out=total[1:])
        h = (total[ends] - total[starts]) * self.back[starts]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    # -- the table
    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        slot, out = self._slot(h), np.full(len(h), -1, np.int64)
        if not len(self.hash):
            return out
        todo = np.arange(len(h))
        while len(todo):
            at = self.slots[slot[todo]]
            held = at >= 0
            hit = held & (self.hash[at] == h[todo])
            out[todo[hit]] = at[hit]
            todo = todo[held & ~hit]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
        return out

    def _insert(self, h: np.ndarray, base: int) -> None:
        slot, todo = self._slot(h), np.arange(len(h))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = free + base  # of several, the last stays
            todo = todo[self.slots[slot[todo]] != todo + base]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)

    def learn(self, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> None:
        """Encode new pieces (distinct hashes) and keep them."""
        text = b[_ragged(starts, sizes)]
        ids, count = self._encode(text, sizes)
        keep = lambda old, new: np.concatenate([old, new])
        base = len(self.hash)
        self.at, self.first = keep(self.at, len(self.text) + np.cumsum(sizes) - sizes), keep(self.first, len(self.ids) + np.cumsum(count) - count)
        self.size, self.count, self.hash = keep(self.size, sizes), keep(self.count, count), keep(self.hash, h)
        self.text, self.ids = keep(self.text, text), keep(self.ids, ids)
        self._insert(h, base)

    def _encode(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that lie end to end in ``text``, and how many each has."""
        codec, ends = self.codec, np.cumsum(sizes)
        last = self.kind[text[ends - 1]]  # a piece ends with white space only if it is nothing else
        words = np.flatnonzero(last >= LETTER)
        line = np.full(int(sizes[words].sum()) + len(words), 10, np.uint8)
        to = np.cumsum(sizes[words] + 1) - sizes[words] - 1
        line[_ragged(to, sizes[words])] = text[_ragged((ends - sizes)[words], sizes[words])]
        found = codec.quick.encode_to_numpy(line.tobytes().decode(), disallowed_special=()).astype("<u4") if len(words) else np.zeros(0, "<u4")
        stops = np.flatnonzero(found == codec.newline)
        count = np.zeros(len(sizes), np.int64)
        if len(stops) != len(words):  # not to be expected of plain text
            parts = [np.frombuffer(codec._library(text[e - s : e].tobytes().decode()), "<u4") for e, s in zip(ends.tolist(), sizes.tolist())]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        count[words] = np.diff(np.r_[-1, stops]) - 1
        rest = {}
        for i in np.flatnonzero(last < LETTER).tolist():
            piece = text[ends[i] - sizes[i] : ends[i]].tobytes().decode()
            rest[i] = np.frombuffer(codec._library(piece), "<u4") if piece != "\0" else np.zeros(0, "<u4")
            count[i] = len(rest[i])
        first = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), "<u4")
        ids[_ragged(first[words], count[words])] = found[found != codec.newline]
        for i, x in rest.items():
            ids[first[i] : first[i] + len(x)] = x
        return ids, count

    # -- texts
    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all plain ``texts``, end to end, and how many each has."""
        b = np.frombuffer("".join(t + "\0" for t in texts).encode(), np.uint8)
        starts = self.cuts(b)
        ends = np.r_[starts[1:], len(b)]
        h, sizes = self.hashes(b, starts, ends), ends - starts
        at = self.find(h)
        if (at < 0).any():
            missing = np.flatnonzero(at < 0)
            new, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            if len(self.hash) + len(new) > self.most:  # begin anew with this batch
                self.clear()
                missing = np.arange(len(h))
                new, one, back = np.unique(h, return_index=True, return_inverse=True)
            pick = missing[one]
            at[missing] = len(self.hash) + back
            self.learn(b, starts[pick], sizes[pick], new)
        same = self.size[at] == sizes
        sure = np.flatnonzero(same)
        held = self.text[_ragged(self.at[at[sure]], sizes[sure])] == b[_ragged(starts[sure], sizes[sure])]
        if not (same.all() and held.all()):  # two pieces of one hash: by the slow way
            parts = [np.frombuffer(self.codec.ids(t), "<u4") for t in texts]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        count = self.count[at]
        ids = self.ids[_ragged(self.first[at], count)]
        total = np.r_[0, np.cumsum(count)]
        stops = total[np.flatnonzero(b[starts] == 0)]  # the end of a text has no ids
        return ids, np.diff(np.r_[0, stops])

    def _blocks(self, text: str) -> list[str]:
        """A long text in parts that are encoded alone, cut between two plain words."""
        out, at = [], 0
        while len(text) - at > BLOCK and (m := CUT.search(text, at + BLOCK)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The library's ids of each text (null: none)."""
        out: list = [None] * len(texts)
        plain, size = [], 0

        def flush() -> None:
            ids, counts = self._block([texts[i] for i in plain])
            for i, part in zip(plain, np.split(ids, np.cumsum(counts)[:-1])):
                out[i] = part

        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, "<u4")
            elif not self.plain(t):
                out[i] = np.frombuffer(self.codec.ids(t), "<u4")
            elif len(t) > BLOCK:
                out[i] = np.concatenate([self._block([x])[0] for x in self._blocks(t)])
            else:
                plain.append(i)
                size += len(t)
                if size > BLOCK:
                    flush()
                    plain, size = [], 0
        if plain:
            flush()
        return out


@functools.lru_cache(maxsize=2)
def table_for(path: str) -> WordTable:
    """One table a worker process."""
    return WordTable(path)
