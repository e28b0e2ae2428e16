"""Secret scans: sliding-window Shannon entropy per character class.

``scan_text`` gives the spans of one text.  Three keyed patterns (assignments, access keys,
hexadecimal keys) are always reported.  Besides these, candidate strings (runs of key-like
characters) are read by a window of ``WINDOW`` characters.  The window's entropy and its character
class are kept by incremental counts: one character enters, one leaves, and only two terms of the
sum and two class counts change.  A window counts if its entropy reaches the bound of its own class;
neighbouring windows merge into one span.  What is on the allow-list (identifiers, dates,
placeholders between word bounds) is cut out of a candidate and the rest is read; a rest that is a
path, a word or a number is suppressed, and so are spans inside a keyed one.

Nulls and empty texts have no spans; an empty table gives an empty result.  Repeated rows each keep
their own result, null ids too.  The offsets are code points, end exclusive.  Texts are read whole,
however long; the memory is one text and its spans, the time grows with n log n.  Other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from citeweave.llm.common import id_text, slices

# The keyed patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
WORDS = ("passw", "secret", "token", "api")

#: Candidate strings, the window, and the entropy (bits a character) that each class must reach.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
BOUND = {"hex": 3.0, "alnum": 3.6, "base64": 3.8, "word": 4.1, "number": math.inf}
#: Harmless parts of a candidate that look random.
ALLOW_PART = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUID
    r"|(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"  # dates
    r"|(?<![A-Za-z0-9])(?i:example|placeholder|sample|dummy|changeme|x{4,})(?![A-Za-z0-9])"
)
#: Harmless wholes.
ALLOW = (
    re.compile(r"(?:[A-Za-z]*[-_/=+])+[A-Za-z]*"),  # paths and names without digits
    re.compile(r"[A-Za-z]+"),  # words
    re.compile(r"[0-9_/=+-]+"),  # numbers and rules
)
_TERM = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]  # before one leaves, a window holds one more
#: Bits of a character: digit, letter of a hexadecimal digit, other letter, other.
_KIND = {chr(c): 0 if chr(c).isdigit() else 1 if chr(c) in "abcdefABCDEF" else 2 if chr(c).isalpha() else 3 for c in range(128)}


def window_class(digits: int, hex_letters: int, letters: int, others: int) -> str:
    """Character class of a window, by the number of its characters of each kind."""
    if not digits:
        return "word"
    if not hex_letters and not letters:
        return "number"
    if not letters and not others:
        return "hex"
    return "base64" if others else "alnum"


def entropy_windows(s: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows of ``s`` whose entropy reaches the bound of their class."""
    counts: dict[str, int] = {}
    kinds, total, top, out = [0, 0, 0, 0], 0.0, math.log2(window), []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        kinds[_KIND[c]] += 1
        if i >= window:
            gone = s[i - window]
            n = counts[gone]
            total += _TERM[n - 1] - _TERM[n]
            counts[gone] = n - 1
            kinds[_KIND[gone]] -= 1
        if i >= window - 1 and top - total / window >= BOUND[window_class(*kinds)] - 1e-9:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def readable(s: str) -> list[tuple[int, int]]:
    """[start, end) of the parts of a candidate that no entry of the allow-list covers."""
    out, at = [], 0
    for a, b in [*(m.span() for m in ALLOW_PART.finditer(s)), (len(s), len(s))]:
        if a - at >= WINDOW and not any(x.fullmatch(s, at, a) for x in ALLOW):
            out.append((at, a))
        at = b
    return out


def scan_text(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind as in KINDS."""
    if not text:
        return []
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    keyed = sorted((a, b) for _, a, b in spans)
    starts, reach = [a for a, _ in keyed], list(itertools.accumulate((b for _, b in keyed), max))
    for m in CANDIDATE.finditer(text):
        s, at = m[0], m.start()
        for x, y in readable(s):
            for a, b in entropy_windows(s[x:y]):
                a, b = at + x + a, at + x + b
                i = bisect.bisect_right(starts, a) - 1  # of the keyed spans that start by here, does one reach b?
                if i < 0 or reach[i] < b:
                    spans.append(("entropy", a, b))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every span (overlapping ones merged) replaced by ``mark``."""
    spans = scan_text(text)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: counts by kind, a digest of the keyed spans, all spans.

    Map-only: no shuffle, one Arrow slice in memory.
    """
    import citeweave.llm.secrets as own

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [own.scan_text(t) for t in batch.column("text").to_pylist()]
            base = [own.joined([s for s in x if s[0] != "entropy"]) for x in found]
            count = lambda kind: pa.array([sum(s[0] == kind for s in x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), count("assign"), count("access"), count("hex"),
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                 pa.array([own.joined(x) for x in found], pa.string()), count("entropy")],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
            )

    return id_text(documents, id_col, text_col).mapInArrow(scan, _SCHEMA)


def redact_documents(documents: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``documents`` with secrets replaced in the text; ``length_col``, where there is one, follows."""
    import citeweave.llm.secrets as own
    from pyspark.sql import functions as F

    names = documents.columns
    at = names.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            new = pa.array([own.redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(len(names))], names=names)

    out = documents.withColumn(text_col, F.col(text_col).cast("string"))
    out = out.mapInArrow(clean, out.schema)
    if length_col in names:
        out = out.withColumn(length_col, F.char_length(text_col).cast(documents.schema[length_col].dataType))
    return out
