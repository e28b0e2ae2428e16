"""LM scoring with a causal self-attention model, trained in numpy on subword ids.

Base score: tokens are words (ASCII white space apart, A-Z lowered) and one end; counts over all
training documents give an add-0.1 unigram.  The counts are keyed by the words' 64-bit XXH64.  The
``HEAD`` most frequent words (a fixed bound) travel with the tasks; all other words of a document
are looked up by a shuffled join on the word's hash, whose hottest key is below the head's bound.

Model score: every word gives its subword ids; a text's ids end with the end-of-text id.  Windows
of ``CONTEXT`` ids overlap by half; each window scores its last half, so every token is scored
once, with at least half a window of context, by masked attention over a batch of windows.  A
token's probability is its class's (the attention model's softmax) times its share of the class,
which comes from the subword counts of all training documents.

Training is data-parallel: the windows lie over the whole of every training text as in scoring, so
every token is a target once in a pass.  Texts are dealt into groups by a hash of id and text, in an
order that the hash gives, and cut into units of ``UNIT`` ids.  From common parameters Adam runs over
each unit, and the parameters are averaged by weight after each round.  Units follow from the rows
alone, so the model does not depend on how many tasks there are or which rows they read (but for the
last bits of sums).

Null texts count as empty: one token, the end.  No training document at all: every count is 0 and
the model keeps its initial parameters; an empty table gives an empty result.  Repeated rows count,
and are scored, each; rows with a null id like any other.  Very long texts are scored in blocks of
windows.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import id_text, materialise, release_memory, slices

CONTEXT, STRIDE, WIDTH = 32, 16, 16
#: Rows of the input table for the most frequent ids, then shared rows; classes likewise.
OWN_ROWS, SHARED_ROWS, OWN_CLASSES, SHARED_CLASSES = 960, 64, 192, 32
#: The same at any size: ROUNDS * EPOCHS passes over all training texts.
BATCH, ROUNDS, EPOCHS, RATE = 256, 2, 1, 0.02
#: Training windows that start in one row of ``training_windows``.
ROW_WINDOWS = 16_384
#: Ids of a unit of training, and units of a group at most GROUPS groups (then more).
UNIT, GROUP_UNITS, GROUPS = 1 << 20, 1, 4_096
#: Units, of some 4 MB each, that are written and read back together.
TOGETHER = {"parquet.block.row.count.limit": 4}
#: Bytes of text that are read at one time.
SLICE = 4 << 20  # a batch of ARROW_ROWS rows is about as large
HEAD, CACHE_WORDS = 300_000, 400_000
SMOOTH = 0.1
END_WORD = b""


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


@functools.lru_cache(maxsize=2)
def subwords(path: str):
    """tiktoken encoder of a rank file; its first free id is the end of text."""
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts, end to end, and how many each has: split at ASCII white space, A-Z lowered."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at either end gives an empty word
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return flat.filter(full), np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(texts)).astype(np.int64)


class Words:
    """Bounded table of the words a worker process has met: hash, subword ids, and more columns."""

    def __init__(self, ranks: str):
        self.encoder, self.end = subwords(ranks)
        self.newline = self.encoder.encode_ordinary("\n")
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.wid = np.zeros(1 << 16, np.int64)
        self.off, self.len = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of the words (a space before each), end to end, and how many each has."""
        line = b"\n ".join(words).decode("utf-8", "replace")
        if len(self.newline) == 1 and line.replace("\n", "").isprintable():
            ids = self.encoder.encode_to_numpy(" " + line, disallowed_special=())
            cuts = np.flatnonzero(ids == self.newline[0])
            if len(cuts) == len(words) - 1:  # a line end stands apart from the words on both sides
                return np.delete(ids, cuts).astype(np.int32), np.diff(np.r_[-1, cuts, len(ids)]) - 1
        each = [self.encoder.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        return np.array([x for e in each for x in e], np.int32), np.array([len(e) for e in each], np.int64)

    def look(self, words: list[bytes]) -> np.ndarray:
        """Positions of the words in the table, adding those not met before."""
        import xxhash

        if len(self.index) > CACHE_WORDS:
            self.clear()
        got = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(got < 0)
        if len(missing):
            lost = [words[i] for i in missing.tolist()]
            at = len(self.index)
            new = list(dict.fromkeys(lost))
            self.index.update(zip(new, range(at, at + len(new))))
            parts = [self.ids_of(new[i : i + 4000]) for i in range(0, len(new), 4000)]
            ids, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            while at + len(new) > len(self.wid):
                self.wid, self.off, self.len = (np.concatenate([a, np.zeros_like(a)]) for a in (self.wid, self.off, self.len))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.wid[at : at + len(new)] = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)).view(np.int64)
            self.len[at : at + len(new)] = sizes
            self.off[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            got[missing] = np.fromiter(map(self.index.__getitem__, lost), np.int64, len(lost))
        return got

    def find(self, words: pa.Array) -> np.ndarray:
        """Table positions of the words; Arrow folds equal ones, so that only distinct ones are looked up."""
        if not len(words):
            return np.zeros(0, np.int64)
        folded = words.dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(folded.dictionary)], folded.dictionary.cast(pa.binary()))
        return self.look(pc.binary_join(distinct, b"\n")[0].as_py().split(b"\n"))[folded.indices.to_numpy(zero_copy_only=False)]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Table positions of all words of the texts, and the number of words of each text."""
        words, sizes = split(texts)
        return self.find(words), sizes

    def expand(self, at: np.ndarray) -> np.ndarray:
        """Subword ids of a sequence of table positions, end to end."""
        size = self.len[at]
        shift = np.cumsum(size) - size
        return self.flat[np.repeat(self.off[at] - shift, size) + np.arange(int(size.sum()))]


@functools.lru_cache(maxsize=1)
def words_for(ranks: str) -> Words:
    """One table a worker process."""
    return Words(ranks)


class Layout:
    """From a subword id to its input row, its class, and its log10 share of the class."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        self.n_ids = int(counts.sum())
        order = np.lexsort((np.arange(n), -counts))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.row = np.where(place < OWN_ROWS, place, OWN_ROWS + place % SHARED_ROWS).astype(np.intp)
        self.rows = OWN_ROWS + SHARED_ROWS + 2
        self.pad, self.begin = self.rows - 2, self.rows - 1
        mass = counts[order].astype(np.float64) + SMOOTH
        rest = np.cumsum(mass[OWN_CLASSES:])
        band = np.minimum(SHARED_CLASSES - 1, (rest - mass[OWN_CLASSES:]) / max(rest[-1] if len(rest) else 1.0, 1e-300) * SHARED_CLASSES).astype(np.int64)
        group = np.concatenate([np.arange(min(OWN_CLASSES, n)), OWN_CLASSES + band])
        self.classes = OWN_CLASSES + SHARED_CLASSES
        self.group = np.empty(n, np.intp)
        self.group[order] = group
        total = np.bincount(group, weights=mass, minlength=self.classes)
        self.share = np.empty(n, np.float64)
        self.share[order] = np.log10(mass / total[group])
        self.prior = np.log(np.maximum(total, 1e-9) / total.sum()).astype(np.float32)


NAMES = ("E", "P", "Q", "K", "V", "C", "b")


def initial(layout: Layout, seed: int = 7) -> dict[str, np.ndarray]:
    rng, d = np.random.default_rng(seed), WIDTH
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(d)).astype(np.float32)
    return {"E": draw(layout.rows, d), "P": 0.3 * draw(CONTEXT, d), "Q": draw(d, d), "K": draw(d, d), "V": draw(d, d), "C": 0.01 * draw(d, layout.classes), "b": layout.prior.copy()}


#: Key j may be seen by target i (input position STRIDE + i) if j <= STRIDE + i.
MASK = np.where(np.arange(CONTEXT)[None, :] <= STRIDE + np.arange(STRIDE)[:, None], 0.0, -1e9).astype(np.float32)
SEE = np.exp(MASK)
#: Rows of logits, and windows, worked on at one time, so that they stay in the processor's cache.
LOGIT_ROWS, GRADIENT_WINDOWS = 256, 32


def _attend(p: dict, rows: np.ndarray, pad: int, kv_weights: np.ndarray):
    x = np.take(p["E"], rows, axis=0)
    x += p["P"]
    flat = lambda a, w: (a.reshape(-1, WIDTH) @ w).reshape(*a.shape[:2], -1)
    xt = np.ascontiguousarray(x[:, STRIDE:])
    q, kv = flat(xt, p["Q"] * np.float32(WIDTH**-0.5)), flat(x, kv_weights)
    k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
    s = q @ k.transpose(0, 2, 1)
    seen = (rows != pad).astype(np.float32)[:, None, :] if (rows[:, 0] == pad).any() else None
    sums = lambda a: (a.reshape(-1, CONTEXT) @ np.ones(CONTEXT, a.dtype)).reshape(a.shape[:2])
    with np.errstate(over="ignore", invalid="ignore"):
        a = np.exp(s)
        a *= SEE
        if seen is not None:
            a *= seen
        total = sums(a)
    if not (np.isfinite(total).all() and total.min() > 1e-20):  # scores beyond the range of exp, or nothing to see
        s += MASK
        if seen is not None:
            s += (1 - seen) * np.float32(-1e9)
        a = np.exp(s - s.max(axis=2, keepdims=True))
        total = sums(a)
    a /= total[:, :, None]
    h = a @ v
    h += xt
    return x, xt, q, k, v, a, h


def gradients(p: dict, rows: np.ndarray, target: np.ndarray, pad: int) -> tuple[float, dict]:
    """Mean cross-entropy over targets >= 0 and its gradients.

    A few windows at a time, so that what lies between stays in the processor's cache.
    """
    live = target >= 0
    n, kind, classes = max(1, int(live.sum())), p["E"].dtype, p["C"].shape[1]
    goal = np.maximum(target, 0)
    # The bias is a further row of the class weights, met by a column of ones; K and V stand side by side.
    weights, back = np.concatenate([p["C"], p["b"][None]]), np.ascontiguousarray(p["C"].T)
    kv_weights = np.concatenate([p["K"], p["V"]], axis=1)
    kv_back, q_back = np.ascontiguousarray(kv_weights.T), np.ascontiguousarray(p["Q"].T)
    out_w, out_q, out_kv = np.zeros((WIDTH + 1, classes), kind), np.zeros((WIDTH, WIDTH), kind), np.zeros((WIDTH, 2 * WIDTH), kind)
    room, ones, line = np.empty((LOGIT_ROWS, classes), kind), np.ones(classes, kind), np.arange(LOGIT_ROWS) * classes
    dx, chance = np.empty((*rows.shape, WIDTH), kind), np.ones(target.size, kind)
    for first in range(0, len(rows), GRADIENT_WINDOWS):
        some = slice(first, first + GRADIENT_WINDOWS)
        x, xt, q, k, v, a, h = _attend(p, rows[some], pad, kv_weights)
        h1 = np.ones((h.shape[0] * STRIDE, WIDTH + 1), kind)
        h1[:, :WIDTH] = h.reshape(-1, WIDTH)
        t, on, prob = goal[some].ravel(), live[some].ravel(), chance[first * STRIDE :]
        dh = np.empty((len(h1), WIDTH), kind)
        for i in range(0, len(h1), LOGIT_ROWS):
            hb, lb = h1[i : i + LOGIT_ROWS], on[i : i + LOGIT_ROWS]
            g, at = np.matmul(hb, weights, out=room[: len(hb)]), line[: len(hb)] + t[i : i + LOGIT_ROWS]
            with np.errstate(over="ignore"):
                np.exp(g, out=g)
            total = g @ ones
            if not (np.isfinite(total).all() and total.min() > 0):  # logits beyond the range of exp
                np.matmul(hb, weights, out=g)
                g -= g.max(axis=1, keepdims=True)
                np.exp(g, out=g)
                total = g @ ones
            mine, every = np.take(g, at), g.reshape(-1)
            prob[i : i + len(hb)] = mine / total
            # The gradient of a row of logits is (probability - 1 at the target) / n, or 0 without a target:
            # g is left unscaled, and the scale goes to the narrow side of each product.
            every[at] = mine - total
            scale = (lb / (total * n)).astype(kind)[:, None]
            out_w += (hb * scale).T @ g
            np.multiply(g @ back, scale, out=dh[i : i + LOGIT_ROWS])
        dh = dh.reshape(h.shape)
        ds = dh @ v.transpose(0, 2, 1)
        ds *= a
        ds -= a * (ds.reshape(-1, CONTEXT) @ np.ones(CONTEXT, kind)).reshape(ds.shape[:2])[:, :, None]
        dq, dkv = ds @ k, np.empty((*x.shape[:2], 2 * WIDTH), kind)
        dkv[:, :, :WIDTH], dkv[:, :, WIDTH:] = ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh  # q holds the scale already
        dq *= np.float32(WIDTH**-0.5)
        dq2, dkv2, xt2 = dq.reshape(-1, WIDTH), dkv.reshape(-1, 2 * WIDTH), xt.reshape(-1, WIDTH)
        out_q += xt2.T @ dq2
        out_kv += x.reshape(-1, WIDTH).T @ dkv2
        np.matmul(dkv2, kv_back, out=dx[some].reshape(-1, WIDTH))
        dh += (dq2 @ q_back).reshape(dh.shape)
        dx[some, STRIDE:] += dh
    out = {"C": out_w[:WIDTH], "b": out_w[WIDTH], "Q": out_q, "K": out_kv[:, :WIDTH], "V": out_kv[:, WIDTH:], "P": dx.sum(axis=0), "E": np.zeros_like(p["E"])}
    flat = rows.ravel().astype(np.uint16 if len(p["E"]) <= 1 << 16 else np.intp)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    out["E"][flat[starts]] = np.add.reduceat(dx.reshape(-1, WIDTH)[order], starts, axis=0)
    return -float(np.log(np.maximum(chance, 1e-12)) @ live.ravel()) / n, out


def fit(p: dict, windows: np.ndarray, layout: Layout, epochs: int, rate: float = RATE, seed: int = 0) -> dict:
    """Adam over windows of CONTEXT + 1 ids (-1: padding, -2: begin) from parameters ``p``."""
    p = {k: v.copy() for k, v in p.items()}
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    rng, step, n = np.random.default_rng(seed), 0, len(windows)
    last = max(1, epochs * -(-n // BATCH))
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            w = windows[order[i : i + BATCH]]
            rows = np.where(w[:, :CONTEXT] >= 0, layout.row[np.maximum(w[:, :CONTEXT], 0)], np.where(w[:, :CONTEXT] == -1, layout.pad, layout.begin))
            goal = w[:, STRIDE + 1 :]
            _, g = gradients(p, rows, np.where(goal >= 0, layout.group[np.maximum(goal, 0)], -1), layout.pad)
            step += 1
            lr = rate * (1 - 0.8 * step / last) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for k in NAMES:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.01 * (g[k] * g[k] - s[k])
                p[k] -= (lr * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)
    return p


class Scorer:
    """log10 probability of sequences of subword ids."""

    def __init__(self, p: dict, layout: Layout):
        self.layout = layout
        self.p = p
        # The projections of every input row and position, so that scoring gathers, not multiplies.
        scale = np.float32(WIDTH**-0.5)
        self.q, self.qp = p["E"] @ p["Q"] * scale, p["P"][STRIDE:] @ p["Q"] * scale
        self.k, self.kp, self.v, self.vp = p["E"] @ p["K"], p["P"] @ p["K"], p["E"] @ p["V"], p["P"] @ p["V"]
        self.e = p["E"]
        self.see, self.ones, self.many = SEE, np.ones(CONTEXT, np.float32), np.ones(layout.classes, np.float32)
        self.line = np.arange(1 << 16)
        self.weights = np.concatenate([p["C"], p["b"][None]]).astype(np.float32)

    def windows(self, rows: np.ndarray, group: np.ndarray, block: int = LOGIT_ROWS // STRIDE) -> np.ndarray:
        """Sum of the targets' class log10 probabilities, by window; targets < 0 count nothing."""
        with np.errstate(over="ignore", invalid="ignore"):
            out = np.concatenate([self._block(rows[i : i + block], group[i : i + block], False) for i in range(0, len(rows), block)])
        bad = np.flatnonzero(~np.isfinite(out))
        if len(bad):
            out[bad] = np.concatenate([self._block(rows[bad[i : i + block]], group[bad[i : i + block]], True) for i in range(0, len(bad), block)])
        return out / np.log(10)

    def _block(self, r: np.ndarray, t: np.ndarray, careful: bool) -> np.ndarray:
        x, n = r[:, STRIDE:], t.size
        k = np.take(self.k, r, axis=0)
        k += self.kp
        q = np.take(self.q, x, axis=0)
        q += self.qp
        s = q @ k.transpose(0, 2, 1)
        if careful:
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s *= self.see
        if (r[:, 0] == self.layout.pad).any():
            s *= (r != self.layout.pad).astype(np.float32)[:, None, :]
        v = np.take(self.v, r, axis=0)
        v += self.vp
        a = np.ones((n, WIDTH + 1), np.float32)
        np.divide((s @ v).reshape(n, WIDTH), (s.reshape(n, CONTEXT) @ self.ones)[:, None] + np.float32(1e-30), out=a[:, :WIDTH])
        a[:, :WIDTH] += (np.take(self.e, x, axis=0) + self.p["P"][STRIDE:]).reshape(n, WIDTH)
        logits = a @ self.weights
        if careful:
            logits -= logits.max(axis=1, keepdims=True)
        flat = t.ravel()
        mine = logits[self.line[:n], np.maximum(flat, 0)]
        np.exp(logits, out=logits)
        mine -= np.log(logits @ self.many)
        mine *= flat >= 0
        return mine.reshape(t.shape).sum(axis=1, dtype=np.float64)

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Score of each of the ragged sequences (each ends with the end of text)."""
        n_win = -(-sizes // STRIDE)
        room = n_win * STRIDE + STRIDE + 1
        base = np.cumsum(room) - room
        rows = np.full(int(room.sum()), self.layout.pad, np.intp)
        group = np.full(int(room.sum()), -1, np.intp)
        rows[base + STRIDE] = self.layout.begin
        at = np.repeat(base + STRIDE + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))
        rows[at], group[at] = self.layout.row[ids], self.layout.group[ids]
        first = np.cumsum(n_win) - n_win
        start = np.repeat(base - first * STRIDE, n_win) + np.arange(int(n_win.sum())) * STRIDE
        got = np.empty(len(start))
        inputs = np.lib.stride_tricks.sliding_window_view(rows, CONTEXT)
        targets = np.lib.stride_tricks.sliding_window_view(group, STRIDE)
        for i in range(0, len(start), 4096):
            w = start[i : i + 4096]
            got[i : i + 4096] = self.windows(inputs[w], targets[w + STRIDE + 1])
        share = np.add.reduceat(self.layout.share[ids], np.cumsum(sizes) - sizes)
        return np.add.reduceat(got, first) + share


def laid_out(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ragged sequences (each ends with the end of text) in one line, in which every window that has
    targets starts at a multiple of STRIDE (-1: padding, -2: begin)."""
    room = (-(-sizes // STRIDE) + 2) * STRIDE
    base = np.cumsum(room) - room
    line = np.full(int(room.sum()) + STRIDE + 1, -1, np.int32)
    line[base + STRIDE] = -2
    line[np.repeat(base + STRIDE + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
    return line


def windows_of(line: np.ndarray) -> np.ndarray:
    """The windows of CONTEXT + 1 ids in a line that have targets."""
    cut = np.lib.stride_tricks.sliding_window_view(line, CONTEXT + 1)[::STRIDE]
    return cut[(cut[:, STRIDE + 1 :] >= 0).any(axis=1)]


def with_ends(at: np.ndarray, sizes: np.ndarray, table: Words) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of texts of ``sizes`` words, the end of text behind each, and how many each has."""
    m = len(sizes)
    sub_size = np.bincount(np.repeat(np.arange(m), sizes), weights=table.len[at], minlength=m).astype(np.int64) + 1
    ids = np.full(int(sub_size.sum()), table.end, np.int32)
    body = np.ones(len(ids), bool)
    body[np.cumsum(sub_size) - 1] = False
    ids[body] = table.expand(at) if len(at) else ids[:0]
    return ids, sub_size


def corpus_counts(training: DataFrame, ranks: str) -> DataFrame:
    """(kind, key, n): kind 0 words and the end by hash, kind 1 subword ids; over all of ``training``."""
    import citeweave.llm.lm as own

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table = own.words_for(ranks)
        end = own._signed(xxhash.xxh64_intdigest(own.END_WORD))
        held = np.zeros(0, np.int64)

        def flush():
            at = np.flatnonzero(held)
            sub = np.bincount(table.expand(at), weights=np.repeat(held[at], table.len[at])).astype(np.int64) if len(at) else held[:0]
            i = np.flatnonzero(sub)
            return pa.RecordBatch.from_arrays([pa.array(np.r_[np.zeros(len(at), np.int32), np.ones(len(i), np.int32)]), pa.array(np.r_[table.wid[at], i]), pa.array(np.r_[held[at], sub[i]])], names=["kind", "key", "n"])

        docs = 0
        for batch in slices(batches, limit=own.SLICE):
            docs += batch.num_rows
            if len(table.index) > own.CACHE_WORDS and held.any():  # the table is about to be cleared
                yield flush()
                held = np.zeros(0, np.int64)
            at, _ = table.read(batch.column("text"))
            if len(at):
                seen = np.bincount(at)
                if len(seen) > len(held):
                    held = np.concatenate([held, np.zeros(len(seen) - len(held), np.int64)])
                held[: len(seen)] += seen
        if held.any():
            yield flush()
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([end, table.end], pa.int64()), pa.array([docs, docs], pa.int64())], names=["kind", "key", "n"])

    rows = training.mapInArrow(count, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def training_windows(training: DataFrame, ranks: str) -> DataFrame:
    """(h, seq, only, w binary): lines of 32-bit ids of one text each, in which ``windows_of`` finds every
    token of ``training`` as a target once; h hashes id and text, seq counts the lines of a very long
    text, only tells that there is but one."""
    import citeweave.llm.lm as own

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = own.words_for(ranks)
        for batch in slices(batches, limit=own.SLICE):
            ids, sizes = own.with_ends(*table.read(batch.column("text")), table)
            line = own.laid_out(ids, sizes)
            room = (-(-sizes // own.STRIDE) + 2) * own.STRIDE
            step, rows = own.ROW_WINDOWS * own.STRIDE, []
            for h, start, n in zip(batch.column("h").to_pylist(), (np.cumsum(room) - room).tolist(), room.tolist()):
                last = max(1, -(-(n - 2 * own.STRIDE) // step))
                for k in range(last):
                    end = n if k == last - 1 else (k + 1) * step + own.STRIDE + 1
                    rows.append((h, k, last == 1, line[start + k * step : start + end].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], names=["h", "seq", "only", "w"])

    keyed = training.select(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.coalesce("text", F.lit(""))).alias("h"), "text")
    return keyed.mapInArrow(cut, "h long, seq int, only boolean, w binary")


def training_units(windows: DataFrame, n_ids: int) -> DataFrame:
    """(lines array<binary>): the lines of each unit of training.  ``n_ids``: the ids in all, from which
    the number of groups follows.  Lines of whole texts are joined to one."""
    import citeweave.llm.lm as own

    groups = max(1, min(GROUPS, round(n_ids / (GROUP_UNITS * UNIT))))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, parts, size, group = [], [], 0, None
        unit = lambda: pa.RecordBatch.from_arrays([pa.array([[*([b"".join(whole)] if whole else []), *parts]], pa.list_(pa.binary()))], names=["lines"])
        for batch in batches:
            for g, only, w in zip(*(batch.column(c).to_pylist() for c in ("g", "only", "w"))):
                if size and (g != group or size >= 4 * own.UNIT):
                    yield unit()
                    whole, parts, size = [], [], 0
                (whole if only else parts).append(w)
                size, group = size + len(w), g
        if size:
            yield unit()

    dealt = windows.withColumn("g", F.pmod("h", F.lit(groups)).cast("int"))
    return dealt.repartition("g").sortWithinPartitions("g", "h", "seq", "w").select("g", "only", "w").mapInArrow(join, "lines array<binary>")


def train(windows: DataFrame, layout: Layout, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` of Adam over each unit of ``windows`` (see ``training_windows``), averaged by weight.

    A task sums what its rows give; its sums are added in a few groups on the executors, and the
    driver gets one row a group.
    """
    import citeweave.llm.lm as own

    p, units = initial(layout), materialise(training_units(windows, layout.n_ids), **TOGETHER)
    shapes = {k: v.shape for k, v in p.items()}
    pack = lambda x: np.concatenate([x[k].ravel() for k in NAMES])
    for r in range(rounds):
        now = p

        def local(batches: Iterator[pa.RecordBatch], now=now, r=r) -> Iterator[pa.RecordBatch]:
            own.words_for.cache_clear()  # of an earlier stage; training looks up no words
            release_memory()
            total, weight = 0.0, 0
            for batch in batches:
                for lines in batch.column("lines"):
                    w = np.concatenate([own.windows_of(np.frombuffer(x, np.int32)) for x in lines.as_py()])
                    if len(w):
                        got = own.fit(now, w, layout, own.EPOCHS, own.RATE / (1 + r), seed=r)
                        total, weight = total + len(w) * pack(got).astype(np.float64), weight + len(w)
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["weight", "p"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(b, np.float64) for b in pdf["p"]], axis=0)
            return pd.DataFrame({"weight": [int(pdf["weight"].sum())], "p": [total.tobytes()]})

        parts = units.mapInArrow(local, "weight long, p binary").withColumn("g", F.pmod(F.xxhash64("weight", "p"), F.lit(8)))
        sums = parts.groupBy("g").applyInPandas(add, "weight long, p binary").collect()
        if not sums:
            return p
        flat = np.sum([np.frombuffer(x["p"], np.float64) for x in sums], axis=0) / sum(x["weight"] for x in sums)
        p, at = {}, 0
        for k in NAMES:
            size = int(np.prod(shapes[k]))
            p[k] = flat[at : at + size].reshape(shapes[k]).astype(np.float32)
            at += size
    return p


def score_documents(documents: DataFrame, held_out, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``held_out`` is a boolean column of ``documents``; rows for which it is not true are learned from.
    """
    import citeweave.llm.lm as own

    ranks = ranks or default_ranks()
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = id_text(docs.where("NOT held_out"))
    counts = materialise(corpus_counts(training, ranks))
    known = counts.where("kind = 0").select(F.col("key").alias("wid"), "n")
    facts = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
    N, V = int(facts["N"]), int(facts["V"])
    # The head: the least count, on a scale of fixed steps, at which at most HEAD words are left.
    steps = known.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("b")).count().orderBy(F.desc("b")).collect()
    total, floor = 0, None
    for s in steps:
        total += s["count"]
        if total > HEAD:
            break
        floor = s["b"]
    head = known.where(F.floor(F.log2("n") * 8).cast("int") >= floor).toPandas() if floor is not None else pd.DataFrame({"wid": [], "n": []})
    order = np.argsort(head["wid"].to_numpy(np.int64))
    head_wid, head_n = head["wid"].to_numpy(np.int64)[order], head["n"].to_numpy(np.int64)[order]
    encoder_end = subwords(ranks)[1]
    sub = np.zeros(encoder_end + 1, np.int64)
    for row in counts.where("kind = 1").select("key", "n").collect():  # at most one row a vocabulary id
        sub[row["key"]] = row["n"]
    layout = Layout(sub)
    p = train(training_windows(training, ranks), layout)
    shared = spark.sparkContext.broadcast((p, layout, head_wid, head_n))
    norm = np.log10(N + SMOOTH * (V + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        p, layout, head_wid, head_n = shared.value
        table, scorer = own.words_for(ranks), own.Scorer(p, layout)
        end = own._signed(xxhash.xxh64_intdigest(own.END_WORD))
        uid = TaskContext.get().partitionId() << 36
        counted, of_table = np.zeros(0, np.int64), None

        def head_counts(wid):
            if not len(head_wid):
                return np.full(len(wid), -1, np.int64)
            i = np.minimum(np.searchsorted(head_wid, wid), len(head_wid) - 1)
            return np.where(head_wid[i] == wid, head_n[i], -1)

        n_end = head_counts(np.array([end]))[0]
        for batch in slices(batches, limit=own.SLICE):
            at, size = table.read(batch.column("text"))
            m = batch.num_rows
            if of_table is not table.index or len(counted) < len(table.index):
                keep = len(counted) if of_table is table.index else 0
                counted, of_table = np.concatenate([counted[:keep], head_counts(table.wid[keep : len(table.index)])]), table.index
            c = counted[at] if len(at) else at
            owner = np.repeat(np.arange(m), size)
            seen = c >= 0
            base = np.bincount(owner, weights=np.where(seen, np.log10(np.maximum(c, 0) + own.SMOOTH) - norm, 0.0), minlength=m)
            n_known = np.bincount(owner, weights=seen, minlength=m).astype(np.int64)
            got = scorer.score(*own.with_ends(at, size, table))
            # Rare words, once per document with their number; and one row with all the rest.
            rare = np.flatnonzero(~seen)
            pair, times = np.unique(owner[rare] * (len(table.index) + 1) + at[rare], return_counts=True)
            who, what = pair // (len(table.index) + 1), pair % (len(table.index) + 1)
            uids = uid + np.arange(m)
            uid += m
            if n_end >= 0:
                base += np.log10(n_end + own.SMOOTH) - norm
                n_known += 1
                ends = np.zeros(0, np.int64)
            else:
                ends = np.arange(m)
            k, none = len(what) + len(ends), lambda n: pa.nulls(n)
            rows = lambda own_part, kind: pa.concat_arrays([own_part.cast(kind), none(k).cast(kind)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[uids, uids[who], uids[ends]]),
                pa.array(np.r_[(uids * 0x9E3779B97F4A7C1) & ((1 << 62) - 1), table.wid[what], np.full(len(ends), end)].astype(np.int64)),
                pa.array(np.r_[np.zeros(m, np.int64), times, np.ones(len(ends), np.int64)]),
                rows(batch.column("doc_id"), pa.int64()), rows(batch.column("held_out"), pa.bool_()), rows(pa.array(size + 1), pa.int64()),
                rows(pa.array(n_known), pa.int64()), rows(pa.array(base), pa.float64()), rows(pa.array(got), pa.float64()),
            ], names=["uid", "wid", "times", "doc_id", "held_out", "n_tokens", "head_known", "head_score", "score"])

    parts = docs.mapInArrow(score, "uid long, wid long, times long, doc_id long, held_out boolean, n_tokens long, head_known long, head_score double, score double")
    met = parts.join(known, "wid", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    term = F.when(F.col("times") > 0, F.col("times") * (F.log10(c + SMOOTH) - float(norm))).otherwise(0.0)
    return (
        met.groupBy("uid")
        .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
             (F.max("head_known") + F.sum(F.when(c > 0, F.col("times")).otherwise(0))).alias("n_known"),
             (F.max("head_score") + F.sum(term)).alias("base_score"), F.max("score").alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), "base_score", "score")
    )
