import hashlib
import math
import random
import re
import time

import pytest

from citeweave.llm import secrets
from tests.llm.conftest import rows_of


def test_base_patterns_against_plain_regex():
    texts = ["token=abcdef", "PASSWORD : 'abc'", "api_key=ABCDEF123 apikey:zzzzzz", "ſecret=abcdefg", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "a", "0" * 23, "xx" + "0a" * 12 + "g", "secret==abcdefgh", "token=abc token=abcdef", "é token='aé'"]
    assign = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
    for t in texts:
        want = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        got = [s for s in secrets.scan_text(t) if s[0] != "entropy"]
        assert sorted(got) == sorted(want), t


def direct(s, bound):
    """Positions of ``s`` covered by windows that reach the bound of their class, each counted afresh."""
    n, out = secrets.WINDOW, set()
    for i in range(len(s) - n + 1):
        w = s[i : i + n]
        h = -sum(w.count(c) / n * math.log2(w.count(c) / n) for c in set(w))
        has = lambda p: bool(re.search(p, w))
        if not has("[0-9]"):
            kind = "word"
        elif not has("[A-Za-z]"):
            kind = "number"
        else:
            kind = "hex" if re.fullmatch("[0-9a-fA-F]+", w) else "alnum" if w.isalnum() else "base64"
        if h >= bound[kind] - 1e-9:
            out |= set(range(i, i + n))
    return out


@pytest.mark.parametrize("bound", [None, 2.0, 3.6, 4.2])
def test_incremental_entropy_equals_direct(monkeypatch, bound):
    if bound:
        monkeypatch.setattr(secrets, "BOUND", dict.fromkeys(secrets.BOUND, bound))
    rng = random.Random(2)
    texts = ["aZ3kQ9xL0pW7eR2tY5uI8oP1sD4fG6hJaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "12345678901234567890-09876543210987654321", "ab" * 8 + "0123456789abcdef0123456789abcdefABC+/aZ3kQ9xL0pW7eR2tY5uI8o"]
    texts += ["".join(rng.choice(alphabet) for _ in range(60)) for alphabet in ("0123456789abcdef", "abcdefXYZ", "aZ3kQ9xL0pW7eR2+/_", "01-") for _ in range(5)]
    for s in texts:
        got = {i for a, b in secrets.entropy_windows(s) for i in range(a, b)}
        assert got == direct(s, secrets.BOUND), s


def test_allow_list_and_candidates():
    assert secrets.scan_text("id 123e4567-e89b-12d3-a456-426614174000 and /usr/local/share/doc/package/README and internationalization_of_words") == []
    assert [k for k, *_ in secrets.scan_text("x aZ3kQ9xL0pW7eR2tY5uI8oP1sD4fG6hJ y")] == ["entropy"]


@pytest.mark.parametrize("before", ["2024-01-01-", "123e4567-e89b-12d3-a456-426614174000/", "example-", "mysample", "a/b/c/"])
def test_what_is_allowed_is_cut_out_and_the_rest_is_read(before):
    key = "aZ3kQ9xL0pW7eR2tY5uI8oP1sD4fG6hJ"
    spans = secrets.scan_text(f"see {before}{key} there")
    assert spans and max(b for _, _, b in spans) == len(f"see {before}{key}")
    assert secrets.scan_text(f"see {before}plain_words_of_no_weight there") == []


def test_many_spans_take_no_square_of_time():
    text = " ".join(["0123456789abcdef01234567 aZ3kQ9xL0pW7eR2tY5uI8oP1sD4fG6hJ"] * 30_000)
    began = time.process_time()
    assert len(secrets.scan_text(text)) == 60_000 and time.process_time() - began < 20


def test_entropy_spans_inside_keyed_ones_are_dropped():
    text = "token=aZ3kQ9xL0pW7eR2tY5uI8oP1sD4fG6hJ 0123456789abcdef01234567"
    assert [k for k, *_ in secrets.scan_text(text)] == ["assign", "hex"]


def test_spans_are_code_points():
    t = "日本 token=abcdef"
    (kind, a, b), = secrets.scan_text(t)
    assert (kind, t[a:b]) == ("assign", "token=abcdef")


def test_table(docs, no_docs):
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    r = got[7]
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 1)
    assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.find_secrets(docs).count() == docs.count() and secrets.find_secrets(no_docs).count() == 0


def test_redaction_keeps_rows_and_columns(docs):
    out = secrets.redact_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = [r["text"] for r in out.collect() if r["doc_id"] == 7][0]
    assert secrets.scan_text(text) == [] and text.count("[SECRET]") == 3
    before = {k for k in rows_of(docs.where("doc_id <> 7"), "doc_id", "text")}
    assert before == {k for k in rows_of(out.where("doc_id <> 7"), "doc_id", "text")}
