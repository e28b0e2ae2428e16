"""Fill-in-middle transformation by a streaming matcher.

A text is matched into units (lines by default) twice.  The first pass counts the units; two ranks
are then drawn from a digest of the document's id.  The second pass advances one lazy iterator of
matches to the smaller rank and on to the larger, and takes the two cuts as positions in the text.
No array of units is ever made: beside the text and the output a document needs constant memory.

Forms: ``psm`` writes prefix, suffix, middle behind their marks, ``spm`` suffix, prefix, middle;
``plain`` is the text itself: where it is empty, holds a mark, or the rate leaves it out.  A mark
that no part holds cannot arise where two parts meet, so ``restore`` finds the parts again.

Null texts count as empty: plain, no units.  A null id is drawn for as the empty string.  Equal rows
give equal results; an empty table gives an empty result; other columns, whatever their names, play
no part.  Texts are matched whole, however long.  Equal ranks give an empty middle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import id_text, slices

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Plan:
    """What the transformation is told: unit pattern, seed, rates in percent."""

    unit: str = LINES
    seed: int = 7
    rate: int = 100
    spm_rate: int = 50


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def advance(matches: Iterator[re.Match], units: int, at: int) -> int:
    """Where the text stands after ``units`` more matches."""
    return at if not units else next(islice(matches, units - 1, None)).end()


def transform(text: str | None, doc_id: int | None, plan: Plan, unit: re.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and middle, output)."""
    text = text or ""
    n = sum(1 for _ in unit.finditer(text))
    h1, h2, h3, h4 = draws(doc_id, plan.seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    matches = unit.finditer(text)
    a = advance(matches, low, 0)
    b = advance(matches, high - low, a)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < plan.spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(documents: DataFrame, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row.  Map-only."""
    import citeweave.llm.infill as own

    plan = plan or Plan()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = re.compile(plan.unit)
        for batch in slices(batches):
            got = [own.transform(t, i, plan, unit) for t, i in zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist())]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return id_text(documents, id_col, text_col).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from."""
    tail = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(2))
    # Each mark stands once, so a part is what lies between two of them.
    between = lambda a, b: F.split_part(tail(output, a), F.lit(b), F.lit(1)) if b else tail(output, a)
    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, ""), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, ""), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(documents: DataFrame, plan: Plan | None = None) -> DataFrame:
    """fill_in_middle with digests of the output and of the text restored from output and form."""
    rows = fill_in_middle(documents, plan)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: DuckDB SQL for digests() with the plan's defaults.
ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT doc_id, x, regexp_extract_all(x, '[^\\n]*\\n|[^\\n]+') AS l,
  CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
r AS (SELECT *, CAST(len(l) AS BIGINT) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(l[1 : a], ''), '') AS pre, coalesce(array_to_string(l[a + 1 : b], ''), '') AS mid, coalesce(array_to_string(l[b + 1 : n], ''), '') AS suf FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN x ELSE pre || mid || suf END) AS restored_sha256
FROM p"""
