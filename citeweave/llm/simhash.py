"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint's bit is set if it is set in over half of the text's shingle hashes.  Two
fingerprints link at ``RADIUS`` or fewer differing bits.  Candidates come from a covering family
of bit masks (Pagh, 2016): every bit position gets a vector of RADIUS + 1 bits, and each nonzero
vector of that length is one table, whose key keeps the positions with an odd inner product.
Whatever RADIUS positions differ, some table's mask is zero on all of them, so each close pair
collides in at least one table: no recall is left to chance.

Within colliding buckets pairs are never enumerated.  Every colliding fingerprint names itself and
its one-bit neighbours as midpoints; the fingerprints at a midpoint (65 at most) are pairwise
within two bits, and two fingerprints within two bits share a midpoint.  Linking a midpoint's
members to their least one therefore gives exactly the components of the link relation.

Null texts count as empty; texts without words have fingerprint zero, linked like any other.
Repeated rows and equal texts share a fingerprint, and all of them get the component's least id;
an id on rows of different texts can be in several components.  Rows with a null id get the
component of their fingerprint but never name one (null if alone).  Texts are read whole, however
long, in blocks of hashes.  An empty table gives an empty result; other columns, whatever their
names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import free_name, id_text, materialise, salted_join, slices, small_side
from citeweave.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks; any ``radius`` positions are all zero in at least one of them."""
    n = 1 << (radius + 1)
    vectors = [1 + i % (n - 1) for i in range(bits)]  # nonzero vectors, dealt evenly over positions
    return [sum(1 << i for i, a in enumerate(vectors) if bin(a & v).count("1") % 2) for v in range(1, n)]


def shingle_hashes(text: str | None, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word k-shingles of the text, in order, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    return np.array([h(line[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, block: int = 1 << 14) -> int:
    """Majority bits of 64-bit hashes, as a signed 64-bit integer."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), block):
        part = np.ascontiguousarray(hashes[i : i + block]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row.  Map-only."""
    import citeweave.llm.simhash as own

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = [own.fingerprint(own.shingle_hashes(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return id_text(documents, id_col, text_col).mapInArrow(scan, "doc_id long, fp long")


def close_edges(prints: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of "at most RADIUS bits apart", from distinct ``fp``."""
    masks = covering_masks()
    tables = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for t, m in enumerate(masks)])).alias("e")).select("fp", "e.t", "e.key")
    shared = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    met = salted_join(tables, shared, ["t", "key"], F.col("fp")).select("fp").distinct()
    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(-(1 << 63) if i == 63 else 1 << i)) for i in range(BITS)]]
    mids = met.select("fp", F.explode(F.array(*flips)).alias("mid"))
    groups = mids.groupBy("mid").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
    return groups.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b").distinct()


def _classes(docs: DataFrame) -> DataFrame:
    """(fp, component_id, first_fp) of fingerprints that stand on several rows or are linked: the least id of
    the component, and the least of its fingerprints that has this id."""
    prints = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = materialise(components(close_edges(prints)).select(F.col("node").alias("fp"), "root"))
    linked = salted_join(roots, prints, ["fp"], F.col("root"), salts=1)
    first = F.min(F.when(F.col("least").isNotNull(), F.struct("least", "fp")))
    least = linked.groupBy("root").agg(first.alias("first")).select("root", F.col("first.least").alias("component_id"), F.col("first.fp").alias("first_fp"))
    linked = salted_join(linked.select("fp", "root"), least, ["root"], F.col("fp")).select("fp", "component_id", "first_fp")
    # Fingerprints of one document, linked to none, need no join: the document is its own class.
    alone = prints.where("n > 1").join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component_id"), F.col("fp").alias("first_fp"))
    return materialise(linked.unionByName(alone))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``documents``.

    The texts are read once and never shuffled; all later stages move 64-bit numbers, one row for
    each distinct fingerprint.
    """
    docs = materialise(fingerprints(documents, id_col, text_col))
    out = salted_join(docs, _classes(docs).drop("first_fp"), ["fp"], F.coalesce("doc_id", F.lit(0)), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _printed(documents: DataFrame, text_col: str, name: str) -> DataFrame:
    """``documents`` with the fingerprint of each row's text as the column ``name``."""
    import citeweave.llm.simhash as own

    names = documents.columns
    at = names.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            fp = [own.fingerprint(own.shingle_hashes(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.int64())], names=[*names, name])

    return documents.mapInArrow(scan, documents.withColumn(name, F.lit(0).cast("long")).schema)


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with one row of each class: the one with the least id, then the least fingerprint.

    Rows with a null id stay, for nothing can refer to them.  Only ids and fingerprints are shuffled: the
    ids that go are joined against the documents, broadcast if a count shows them to be few.  Where an
    id stands on several rows, its rows are told apart by their fingerprints, so an id can keep one row
    for each class that it comes first in; of rows equal in both, any one stays.  Columns of
    ``documents`` may have any names.
    """
    docs = materialise(fingerprints(documents, id_col, text_col))
    classes = _classes(docs)
    docs = docs.where("doc_id IS NOT NULL")
    wins = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("first_fp"))
    later = salted_join(docs, classes, ["fp"], F.col("doc_id")).where(~wins).select("doc_id", F.lit(False).alias("repeated"))
    several = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("repeated"))
    ids = materialise(later.unionByName(several).groupBy("doc_id").agg(F.max("repeated").alias("repeated")))
    at, mark = free_name(documents, "id"), free_name(documents, "print")
    named = lambda df, *more: small_side(materialise(df.select(F.col("doc_id").alias(at), *more)))
    key = F.col(f"`{id_col}`").cast("long") == F.col(at)
    once = documents.join(named(ids), key, "left_anti")
    # Of the rows of a repeated id, those stay whose fingerprint comes first in its class under that id.
    again = ids.where("repeated")
    if again.isEmpty():
        return once
    own = docs.join(again, "doc_id", "left_semi").distinct().join(classes, "fp", "left").where(F.col("first_fp").isNull() | wins)
    mine = named(own, F.col("fp").alias(f"{mark}_kept"))
    seen = _printed(documents.join(named(again), key, "left_semi"), text_col, mark)
    kept = seen.join(mine, key & (F.col(mark) == F.col(f"{mark}_kept")), "left_semi")
    return once.unionByName(kept.dropDuplicates([id_col, mark]).drop(mark))
