import hashlib
import re

from citeweave.llm import infill


def by_list(text, doc_id, seed=7, rate=100, spm=50):
    """The same from a list of units."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return (n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ROWS = [(i, t) for i, t in enumerate([
    "one\ntwo\nthree\nfour\n", "no line end", "\n\n\n", "a\n\nb", "", None, "holds <S> a mark\n", "<P\n>S>\n<\nM>\n<", "é日本\n😀 x\r\ny\n", "<\n" * 50, "last without end\nof line", "x" * 10_000 + "\n" + "y\n" * 5_000,
])]
ROWS += [(1000 + i, "".join(f"line {j} <\n" for j in range(i % 9))) for i in range(200)] + [(None, "no id\nat all"), (0, "one\ntwo\nthree\nfour\n")]
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")


def test_equals_lists_and_restores(spark):
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in ROWS], "doc_id long, text string, output string, n int")
    for plan in (infill.Plan(), infill.Plan(seed=3, rate=60, spm_rate=20)):
        out = infill.fill_in_middle(df, plan)
        got = out.withColumn("back", infill.restore(out.output, out.form)).collect()
        want = sorted(((i, *by_list(t, i, plan.seed, plan.rate, plan.spm_rate), t or "") for i, t in ROWS), key=repr)
        assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS), r["back"]) for r in got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_digests(docs, no_docs):
    rows = infill.digests(docs).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in docs.collect():
        n, form, p, m, out = by_list(r["text"], r["doc_id"])
        want.append((r["doc_id"], n, form, p, m, digest(out), digest(r["text"] or "")))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert infill.digests(no_docs).count() == 0


def test_other_units(spark):
    df = spark.createDataFrame([(i, "some words stand here in a row") for i in range(40)], "doc_id long, text string")
    out = infill.fill_in_middle(df, infill.Plan(unit=r"\S+\s*"))
    rows = out.withColumn("back", infill.restore(out.output, out.form)).collect()
    assert all(r["n"] == 7 and r["back"] == "some words stand here in a row" for r in rows)
    assert len({(r["prefix_chars"], r["middle_chars"]) for r in rows}) > 10


def test_no_list_of_units():
    """Matches are taken one by one: a text of a million units holds none of them."""
    import tracemalloc

    text = "a\n" * 500_000
    tracemalloc.start()
    infill.transform(text, 12, infill.Plan(), re.compile(infill.LINES))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(text)
