"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

An item is contained in a document if at least ``THRESHOLD`` of the item's distinct word
``SHINGLE``-grams stand in the document.  A document can be thousands of times longer than an item,
so the usual banding over document signatures would need as many hash functions; instead the items
carry the sketches.  Items are partitioned by size (powers of two of their number of shingles),
and every partition gets its own sketch length: the items' bottom-k MinHash values under one hash
function, with k = n - ceil(THRESHOLD * n) + 1 for the partition's largest item n.  An item with
fewer than k of its shingles missing cannot hide its whole sketch, so every contained item shares a
sketch value with the document: recall is certain, not probable.  The largest sketch value of a
partition is its cut: a document's shingle is looked up in those partitions alone whose cut it does
not pass, so one short item, whose few values lie anywhere, opens its own partition only.

Documents are read twice: once for the lookup, once (candidates only) for the exact shingle
containment, which compares the shingles' text.  Very long documents are cut into segments of
``SEGMENT`` shingles, so no array of hashes grows with a document.

Words are runs of characters other than ASCII white space and punctuation, letters lowered.
Items of fewer than SHINGLE words have one shingle, all their words; documents likewise.  Items and
documents without words (null or empty) match nothing; an empty table gives an empty result.
Repeated rows: the pair is given once per distinct (doc_id, item_id), with the shingles of all rows
of that id together.  Rows with a null id match nothing, since nothing can refer to them.  Other
columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import BROADCAST_ROWS, free_name, materialise, salted_join, small_side

SHINGLE, THRESHOLD = 5, 0.8
#: Shingles of one document that a row holds; longer documents are cut into segments.
SEGMENT = 4096
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _starts(k: int) -> Column:
    """Starts of the shingles in ``words``: 1 .. n - k + 1, or 1 alone for a short text; none without words."""
    n = F.size("words")
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))


def hashes_of(k: int = SHINGLE) -> Column:
    """Hashes of the word shingles in ``words``, chained over the words without building strings."""
    return F.transform(_starts(k), lambda i: F.xxhash64(*[F.get("words", i + (j - 1)) for j in range(k)]))


def shingles_of(k: int = SHINGLE) -> Column:
    return F.array_distinct(F.transform(_starts(k), lambda i: F.array_join(F.slice("words", i, k), " ")))


def item_sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, part, n, h): each item's bottom-k values, k by the size partition.  ``items``: id, words,
    the rows of one id together."""
    hashes = items.select("item_id", F.explode(hashes_of()).alias("h")).groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    sized = hashes.where(F.size("hs") > 0)
    sized = sized.withColumn("n", F.size("hs")).withColumn("part", F.floor(F.log2("n")))
    largest = F.pow(F.lit(2.0), F.col("part") + 1) - 1
    k = (largest - F.ceil(F.lit(threshold) * largest - 1e-9) + 1).cast("int")
    return sized.select("item_id", "part", "n", F.explode(F.slice("hs", 1, F.greatest(k, F.lit(1)))).alias("h"))


def segments(words: str = "words", k: int = SHINGLE, size: int = SEGMENT) -> Column:
    """``words`` in segments that together have the same shingles: neighbours share k - 1 words."""
    last = F.floor((F.size(words) - k) / F.lit(size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * size + 1, F.lit(size + k - 1)))
    return F.when(F.size(words) > size + k - 1, cut).otherwise(F.array(words))


def lookup(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(doc_id, item_id) that share a sketch value; ``rows``: doc_id, words.  ``sketches`` is materialised."""
    cuts = sketches.groupBy("part").agg(F.max("h").alias("cut")).orderBy("part").collect()  # a row for each power of two
    if not cuts:
        return sketches.sparkSession.createDataFrame([], "doc_id long, item_id long")
    top = max(c["cut"] for c in cuts)
    hashes = rows.select("doc_id", F.explode(segments()).alias("words")).select("doc_id", F.explode(hashes_of()).alias("h")).where(F.col("h") <= F.lit(top))
    open_to = F.array_compact(F.array(*[F.when(F.col("h") <= F.lit(c["cut"]), F.lit(c["part"])) for c in cuts]))
    hashes = hashes.select("doc_id", "h", F.explode(open_to).alias("part"))
    keys, values = ["part", "h"], sketches.select("part", "h", "item_id")
    met = hashes.join(F.broadcast(values), keys) if sketches.count() <= BROADCAST_ROWS else salted_join(hashes, values, keys, F.col("doc_id"))
    return met.select("doc_id", "item_id").distinct()


def find_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every pair at or above ``threshold``."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    docs = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id IS NOT NULL")
    items = materialise(items.select("item_id", words_of(F.col("text")).alias("words")))
    shingles = materialise(items.select("item_id", F.explode(shingles_of()).alias("s")).distinct())
    pairs = materialise(lookup(docs, materialise(item_sketches(items, threshold).select("item_id", "part", "h").distinct())))
    suspects = materialise(pairs.select("doc_id").distinct())
    texts = docs.join(small_side(suspects), "doc_id", "left_semi").select("doc_id", F.explode(segments()).alias("words")).select("doc_id", F.explode(shingles_of()).alias("s"))
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("n_item"))
    # Only shingles of items go on; then only pairs that share a sketch value.
    met = texts.join(F.broadcast(shingles), "s") if shingles.count() <= BROADCAST_ROWS else salted_join(texts, shingles, ["s"], F.col("doc_id"))
    shared = met.select("doc_id", "item_id", "s").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    out = shared.join(pairs, ["doc_id", "item_id"], "left_semi").join(sizes, "item_id")
    out = out.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9))
    return out.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def keep_clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` without those that hold a benchmark item; rows with a null id stay."""
    found = find_contaminated(documents, benchmark, id_col, text_col)
    at = free_name(documents, "id")
    gone = materialise(found.select(F.col("doc_id").alias(at)).distinct())
    return documents.join(small_side(gone), F.col(f"`{id_col}`").cast("long") == F.col(at), "left_anti")


#: DuckDB SQL for find_contaminated over documents and benchmark.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT ds.doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY ds.doc_id, item_id, n_item HAVING count(*) >= ceil(0.8 * n_item - 1e-9)"""
