"""Language ID by compression: per-language zstandard raw-content dictionaries.

``fit_dictionaries`` takes, for every language, a bounded sample of labelled texts (``SAMPLE_DOCS``
texts with the smallest hash of id and text, their first ``SAMPLE_CHARS`` characters, joined up to
``DICT_BYTES``) as a raw-content dictionary; rows equal in both count once, and the row with a
language's least hash is always among them, so no language goes unlearned.
``classify`` compresses each whole text, block by block, with every dictionary; the language whose
dictionary gives the fewest bytes wins; a narrow result is settled by a stronger level.  The relative margin to the runner-up is the score, and a
margin below ``MIN_MARGIN`` rejects the text (``rejected``), as does a text without a letter.

A letter is a character of a Unicode letter category.  Null texts and texts without a letter:
``und``, score 0, rejected.  Ties: the first language by name.  No labelled text at all: every text
is ``und``.  One language only: score 1.  Labelled rows with a null language teach nothing; rows
with a null id are labelled rows like others.  Repeated rows each keep their own result, an empty
table gives an empty result, and other columns, whatever their names, play no part.  The sample is
the only bounded thing here; every text is read whole, however long, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import id_text, slices

#: The bound of the labelled sample: texts a language, their largest size, bytes a dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 96, 8_000, 96 << 10
BLOCK_BYTES = 2048
#: Levels tried in turn: a margin under SURE asks the next, stronger one.
LEVELS = (3, 9, 19)
SURE = (0.08, 0.0)
MIN_MARGIN = 0.0005
LETTER = regex.compile(r"\p{L}")
_REST = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> bytes:
    """The words of a text in lower case, one space between them: what is compressed."""
    return _REST.sub(" ", text.lower()).encode()


def fit_dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary bytes by language.  The driver gets at most SAMPLE_DOCS texts a language.

    Counts by language come first; a hash threshold then leaves about three times the sample, so
    that the per-language ranking never sees a hot language's rows.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.char_length("text") > 0))
    share = F.pmod(F.xxhash64(F.col("id").cast("string"), "text", "lang"), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.select("lang", "text", (F.char_length("text") > SAMPLE_CHARS).alias("long_text"), share.alias("h"))
    counts = rows.groupBy("lang", "long_text").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    if not counts:
        return {}
    by_lang: dict[str, dict[bool, tuple[int, float]]] = {}
    for r in counts:
        by_lang.setdefault(r["lang"], {})[r["long_text"]] = (r["n"], r["least"])
    keep = F.lit(False)
    for lang, found in by_lang.items():
        # Short texts give varied dictionaries; a language that has none falls back on its long ones.
        long_text = False not in found
        n, least = found[long_text]
        # The row with the least hash always passes, so no language goes unlearned.
        bound = max(least, min(1.0, 3.0 * SAMPLE_DOCS / n + 30.0 / n))
        keep = keep | ((F.col("lang") == lang) & (F.col("long_text") == long_text) & (F.col("h") <= bound))
    from pyspark.sql import Window

    # Rows equal in id, text and language count once.
    sample = rows.where(keep).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    out: dict[str, list[bytes]] = {}
    for r in sample.withColumn("k", rank).where(F.col("k") <= SAMPLE_DOCS).select("lang", "k", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect():
        out.setdefault(r["lang"], []).append((r["k"], letters(r["text"])))
    return {lang: b" ".join(t for _, t in sorted(texts))[:DICT_BYTES] for lang, texts in sorted(out.items())}


def compressors(dictionaries: dict[str, bytes], levels: tuple[int, ...] = LEVELS) -> list[list]:
    """For every level, (language, compressor) by language."""
    import zstandard as z

    out = []
    for level in levels:
        coders = []
        for lang, data in sorted(dictionaries.items()):
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append((lang, z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)))
        out.append(coders)
    return out


def classify(text: str | None, coders: list[list], block: int = BLOCK_BYTES) -> tuple[str, float]:
    """(language, relative margin) of one whole text."""
    if not text or not coders or not coders[0] or not LETTER.search(text):
        return "und", 0.0
    data = letters(text)
    blocks = [data[i : i + block] for i in range(0, len(data), block)]
    for level, sure in zip(coders, (*SURE, -1.0)):
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in level)
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        margin = 1.0 - sizes[0][0] / sizes[1][0]
        if margin > sure:
            break
    return sizes[0][1], margin


def identify(documents: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row.  Map-only.

    The dictionaries travel with the task (languages x DICT_BYTES, a fixed size).
    """
    import citeweave.llm.langid as own

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = own.compressors(dictionaries)
        for batch in slices(batches):
            got = [own.classify(t, coders) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[0] == "und" or g[1] < min_margin for g in got], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return id_text(documents, id_col, text_col).mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(documents: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, unchanged, whose text is not rejected."""
    import citeweave.llm.langid as own

    at = documents.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = own.compressors(dictionaries)
        for batch in slices(batches, text_col):
            got = [own.classify(t, coders) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([g[0] != "und" and g[1] >= min_margin for g in got], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
