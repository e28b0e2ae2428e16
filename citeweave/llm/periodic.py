"""Periodic run detection by heavy/light lag counting.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at
least ``max(LEAST, TIMES * q)`` words that no neighbouring word extends with that period.

For every lag up to n/TIMES the equal pairs at that lag are counted exactly.  Frequent (heavy) words
add the autocorrelation of their positions by FFT, the spectra of all of them summed before one
inverse transform and the result rounded to whole counts; rare (light) words add the differences of
their positions, pair by pair.  A word is heavy where its pairs cost more than a transform.  A run of
period q needs ``max(LEAST, TIMES * q) - q`` equal pairs in a row, so only lags with that many are
scanned for islands.

A scan of lag q first looks at some positions, PROBES or more of which, in a row, lie in every island
of need equal pairs.  Where enough of them in a row are equal, twice as many are looked at, and so on
down to every word.  Places where a known run of a period that divides q explains the pairs are left
out: there the island is that run again, for no neighbour extends it.  So long repeats of one word
cost no more than their lags' first probes.

Null texts and texts of fewer than LEAST words have no run.  Equal rows give equal results; an empty
table gives an empty result; other columns, whatever their names, play no part.  Texts are read
whole; the memory is a few arrays over one text's words.  Of runs with equal length the earliest,
then the one of least period, is given as the longest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import id_text, slices

#: Least words of a run, and least repeats of its period.
LEAST, TIMES = 6, 4
#: Positions of a long enough island that a scan looks at first.
PROBES = 8
#: Pairs of one step for light words: bounds the memory of their differences.
PAIRS = 1 << 20
#: Cost of a transform, in pairs, over size * log2(size).
FFT_COST = 0.2


def fft_size(n: int) -> int:
    """The least 2^a, 3 * 2^a or 5 * 2^a that is at least n."""
    return min(m << max(0, (-(-n // m) - 1).bit_length()) for m in (1, 3, 5))


def lag_counts(words: np.ndarray, most: int) -> np.ndarray:
    """counts[q] = places i with words[i] == words[i + q], for q up to ``most``; exact."""
    n = len(words)
    order = np.argsort(words, kind="stable")  # positions, word by word, in order
    sizes = np.bincount(words)
    ends = np.cumsum(sizes)
    size = fft_size(n + most + 1)
    heavy = sizes.astype(float) ** 2 / 2 > FFT_COST * size * np.log2(size)
    counts = np.zeros(most + 1, np.int64)
    if heavy.any():
        power = np.zeros(size // 2 + 1)
        for w in np.flatnonzero(heavy).tolist():
            there = np.zeros(size)
            there[order[ends[w] - sizes[w] : ends[w]]] = 1.0
            spectrum = np.fft.rfft(there)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    # Light words: the k-th next position of the same word, for k = 1, 2, ... while it is near enough.
    light = ~heavy & (sizes > 1)
    left = order[np.repeat(light, sizes)]
    limit = np.repeat(np.cumsum(sizes[light]), sizes[light])
    rows, k, waiting, held = np.arange(len(left)), 0, [], 0
    while len(rows):
        k += 1
        rows = rows[rows + k < limit[rows]]
        gap = left[rows + k] - left[rows]
        near = gap <= most
        rows, gap = rows[near], gap[near]
        waiting.append(gap)
        held += len(gap)
        if held > PAIRS:
            counts += np.bincount(np.concatenate(waiting), minlength=most + 1)
            waiting, held = [], 0
    if waiting:
        counts += np.bincount(np.concatenate(waiting), minlength=most + 1)
    counts[0] = n
    return counts


def _islands(words: np.ndarray, q: int, least: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, length) of every stretch of at least ``least`` places i with words[i] == words[i + q], but
    for those that ``known`` lists as (start, past)."""
    n = len(words) - q
    step = 1 << max(0, (least // PROBES).bit_length() - 1)
    at = np.arange(0, n, step)
    hit = words[at] == words[at + q]
    for s, past in known:
        hit[-(-s // step) : -(-past // step)] = False
    while True:
        # A long enough island holds least // step probes in a row.  At step 1 such rows are the islands.
        at = at[hit]
        if not len(at):
            return []
        breaks = np.flatnonzero(np.diff(at) != step)
        first, last = at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]]
        enough = (last - first) // step + 1 >= least // step
        first, last = first[enough], last[enough]
        if step == 1 or not len(first):
            return list(zip(first.tolist(), (last - first + 1).tolist()))
        # Twice as many probes where rows were long enough, out to the probes that missed.
        low, high = np.maximum(first - step + 1, 0), np.minimum(last + step, n)
        step //= 2
        begin, end = -(-low // step), -(-high // step)
        begin[1:] = np.maximum(begin[1:], end[:-1])
        size = end - begin
        past = np.cumsum(size)
        at = (np.repeat(begin - (past - size), size) + np.arange(past[-1])) * step
        hit = words[at] == words[at + q]


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in an array of word numbers, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    most = max(n // TIMES, 1)
    lags = np.arange(most + 1)
    need = np.maximum(LEAST, TIMES * lags) - lags
    wanted = np.flatnonzero((lag_counts(words, most) >= need) & (need + lags <= n) & (lags > 0))
    found: dict[tuple[int, int], int] = {}
    live = np.zeros((0, 3), np.int64)  # runs that can still explain pairs: start, length, period
    for q in wanted.tolist():
        least = int(need[q])
        live = live[live[:, 1] >= least + q]
        known = live[q % live[:, 2] == 0]
        # An island of a known run that shows again is that run: the least period stays.
        new = [(s, length + q, q) for s, length in _islands(words, q, least, [(s, s + length - q) for s, length, _ in known.tolist()]) if (s, length + q) not in found]
        if new:
            found.update(((s, length), period) for s, length, period in new)
            live = np.concatenate([live, np.array(new, np.int64)])
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run is collapsed to its first period."""
    change = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        change[s + q] += 1
        change[s + length] -= 1
    return np.cumsum(change[:-1]) == 0


def number(words: list) -> np.ndarray:
    """Words as numbers in the order of their first places."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def with_loop(words: list, doc_id: int | None) -> list:
    """The words of a document with a planted loop: one document in ten, by a checksum of its id, repeats
    some words to its end."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * (-(-(n - a) // p)))[: n - a]


_RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", loops: bool = False, with_text: bool = False) -> DataFrame:
    """One row per row of ``documents``, map-only: doc_id, n_runs; start, length, period and
    exponent_milli of the longest run (null without one); runs_sha256 and collapsed_sha256, digests of
    all runs and of the kept words.  ``loops`` plants loops first (``with_loop``); ``with_text`` adds
    ``runs`` and ``collapsed`` themselves."""
    import citeweave.llm.periodic as own

    def one(text: str | None, doc_id: int | None) -> tuple:
        words = (text or "").encode().split()  # bytes are split at the six ASCII spaces alone
        words = own.with_loop(words, doc_id) if loops else words
        runs = own.find_runs(own.number(words))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        if runs:
            kept = own.kept_words(len(words), runs)
            words = [w for w, k in zip(words, kept.tolist()) if k]
        collapsed = b" ".join(words)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        milli = 1000 * best[1] // best[2] if runs else None
        out = (len(runs), *best, milli, digest(listed.encode()), digest(collapsed))
        return (*out, [dict(zip(("start", "length", "period"), r)) for r in runs], collapsed.decode()) if with_text else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        if with_text:
            names += ["runs", "collapsed"]
            kinds += [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
        for batch in slices(batches):
            got = [one(t, i) for t, i in zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]], names=["doc_id", *names])

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return id_text(documents, id_col, text_col).mapInArrow(run, schema + (f", runs {_RUNS}, collapsed string" if with_text else ""))
