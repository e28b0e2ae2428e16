"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no topic.
STOPWORDS = (
    "the a an and or but if then else of to in on for with as by at from is are was were be been being this that these "
    "those it its i you he she they we my your their our what which who whom how when where why do does did not no can "
    "will would should could about into over than so such up out down more most some any all there here also very just best"
).split()
SIMILARITY_CHARS = 8000
#: Line ends, those of Python's splitlines included.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]"
HEADING = r"^\s*#{1,6}\s+(.*?)\s*$"


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers without stopwords, repeats kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_END)


def headings(markdown: Column) -> Column:
    """Markdown headings in order, without their marks."""
    heads = F.filter(lines(markdown), lambda x: x.rlike(HEADING))
    texts = F.transform(heads, lambda x: F.regexp_extract(x, HEADING, 1))
    return F.filter(texts, lambda x: x != "")


def word_count(text: Column) -> Column:
    """Runs of letters, digits and underscores in any script."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def words(text: Column) -> Column:
    """Runs of characters that are no white space."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def used_text(text: Column) -> Column:
    return F.substring(text, 1, SIMILARITY_CHARS)


def prompt_key(text: Column) -> Column:
    """A prompt for matching: case, white space and outer punctuation aside."""
    flat = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), SPACE + "+", " ")
    return F.regexp_replace(flat, r"""^[ ?.!"']+|[ ?.!"']+$""", "")


def split_list(text: Column, marks: str) -> Column:
    """Non-empty trimmed items of a cell."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), marks), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def split_expected(text: Column) -> Column:
    return split_list(text, r"[;,|]")


def split_terms(text: Column) -> Column:
    """Brand terms of a cell; a term that repeats in other case is dropped."""
    items = split_list(text, r"[;|\n]")
    lowered = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def truthy(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin("true", "1", "yes", "y")


def truthy_or_null(c: Column) -> Column:
    return F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) == "", F.lit(None)).otherwise(truthy(c))


def parse_date(text: Column) -> Column:
    """Timestamp of a free-form date, or null."""
    t = F.trim(text)
    iso = F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.regexp_replace(t, "Z", "+00:00")))
    patterns = ("yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(p)) for p in patterns])


def freshness_days(ts: Column, as_of: Column) -> Column:
    """Whole days from ``ts`` to ``as_of``, zero at least."""
    days = F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / F.lit(86400.0))
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0))).cast("double")


def folded(text: str) -> str:
    """Compatibility-normalised, case-folded: the form in which words are looked for in folded text."""
    return unicodedata.normalize("NFKC", text).casefold()


#: Texts of an Arrow batch that are Python strings at a time.
FOLD_ROWS = 256


@F.arrow_udf(T.StringType())
def _folded(s: pa.Array) -> pa.Array:
    # No iterator of batches: calls on several columns then share a worker.
    part = lambda at: pa.array([None if x is None else folded(x) for x in s.slice(at, FOLD_ROWS).to_pylist()], pa.string())
    return pa.concat_arrays([part(at) for at in range(0, max(1, len(s)), FOLD_ROWS)])


def fold(text: Column, ascii_only: bool = False) -> Column:
    """Compatibility-normalised, case-folded text.  ``ascii_only``: the caller knows there is nothing else."""
    t = F.coalesce(text, F.lit(""))
    if ascii_only:
        return F.lower(t)
    # Python is called for all rows of a table, so it gets only the texts that need it.
    plain = t.rlike(r"^\p{ASCII}*$")
    return F.when(plain, F.lower(t)).otherwise(_folded(F.when(~plain, t)))


def _quoted(term: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in term)


def detect_terms(text: Column, terms: list[str], ascii_only: bool = False) -> Column:
    """The terms found in the text, in their order: as substrings if they look like addresses or are
    not ASCII, else between characters that are no ASCII letter or digit."""
    x = fold(text, ascii_only)
    hits = []
    for term in terms:
        t = folded(term or "")
        if not t:
            continue
        sub = "." in t or "/" in t or not t.isascii()
        found = F.contains(x, F.lit(t)) if sub else x.rlike(f"(?<![a-z0-9]){_quoted(t)}(?![a-z0-9])")
        hits.append(F.when(found, F.lit(term)))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def percent_text(c: Column) -> Column:
    """A share as whole percent, ties to even; a dash for null."""
    return F.coalesce(F.concat(F.bround(c * 100.0, 0).cast("long").cast("string"), F.lit("%")), F.lit("—"))


def number_text(c: Column, whole: bool = False) -> Column:
    """A number for display: two decimals below a thousand, grouped digits from there on; ``whole``: an integer."""
    grouped = F.format_number(c, 0)
    shown = grouped if whole else F.when(F.abs(c) < 1000, F.format_string("%.2f", c.cast("double"))).otherwise(grouped)
    return F.when(c.isNull(), F.lit("—")).otherwise(shown)
