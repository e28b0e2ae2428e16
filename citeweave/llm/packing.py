"""Packing by power-of-two decomposition.

Each document's ids, an end id behind them, are split into pieces whose lengths are powers of two:
as many of the greatest length as fit, then the binary digits of the rest, longest first.  Every
piece is a sequence of its own at offset 0, so no sequence crosses documents and none is padded.
Pieces of equal length form a bucket; sequence ids run bucket by bucket, longest first, without a
gap, and within a bucket in the order of a hash, so neighbours come from unrelated documents.
``batch_id`` joins sequences of one bucket to batches of at most ``batch_tokens`` tokens.

Buckets are numbered without a global sort: the pieces of a bucket are dealt over parts by hash, the
parts are counted, and a part's first number follows from the counts before it, so no task holds a
bucket.  What is shuffled are piece rows (ids only where asked for), never texts.

Null and empty texts hold the end id alone.  Repeated rows and rows with a null id are packed each by
itself; an empty table gives an empty result; other columns, whatever their names, play no part.
Very long texts are encoded in blocks; the memory is one text and its ids.  Ties of the hash go by
id, start and checksum; rows equal in all of these are equal pieces, whatever their numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.bpe import default_vocabulary
from citeweave.llm.common import id_text, materialise, slices, small_side

#: Greatest length of a sequence, and the id that ends a document.
LONGEST, END_ID = 1024, 0
#: Tokens of a batch of sequences of one bucket.
BATCH_TOKENS = 1 << 16
#: Pieces of one bucket that one task puts in order, and the least number of parts.
PART_ROWS, LEAST_PARTS = 1_000_000, 32


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n ids; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in reversed(range(longest.bit_length() - 1)) if rest >> k & 1]


def cut_documents(documents: DataFrame, vocabulary: str | None = None, longest: int = LONGEST, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (``with_ids``: ids too) of every piece.  Map-only."""
    import citeweave.llm.packing as own
    from citeweave.llm import wordtable

    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wordtable.table_for(vocabulary or own.default_vocabulary())
        for batch in slices(batches):
            row, start, length, crc, total, parts = [], [], [], [], [], []
            for i, ids in enumerate(table.encode(batch.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                sizes, data, at = own.lengths(len(ids), longest), memoryview(ids.tobytes()), 0
                for size in sizes:
                    start.append(at)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    at += size
                row += [i] * len(sizes)
                length += sizes
                total += [len(ids)] * len(sizes)
                if with_ids:
                    parts.append(ids.astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]).astype(np.int32)), pa.array(np.concatenate(parts))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return id_text(documents, id_col, text_col).mapInArrow(cut, schema)


def number_buckets(pieces: DataFrame, batch_tokens: int = BATCH_TOKENS, part_rows: int = PART_ROWS) -> DataFrame:
    """``pieces`` (materialised) with sequence_id, offset and batch_id."""
    parts = max(LEAST_PARTS, -(-pieces.count() // part_rows))
    mix = F.xxhash64("doc_id", "start", "ids_crc32", "length")
    dealt = pieces.withColumn("mix", mix).withColumn("part", F.pmod(F.shiftright("mix", 20), F.lit(parts)))
    counts = materialise(dealt.groupBy("length", "part").agg(F.count("*").alias("n")))
    order = [F.desc("length"), "part"]
    # One row a bucket and part: some ten rows a million pieces.
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("length", "part", before("n", Window.orderBy(*order)).alias("first"), before("n", Window.partitionBy("length").orderBy("part")).alias("within"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))
    batches = counts.groupBy("length").agg(F.ceil(F.sum("n") / fits).alias("batches"))
    batches = batches.select("length", before("batches", Window.orderBy(F.desc("length"))).alias("first_batch"))
    places = materialise(places.join(F.broadcast(batches), "length"))  # batches: one row a power of two
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("mix", "doc_id", "start", "ids_crc32", "doc_tokens")).cast("long") - 1
    rows = dealt.withColumn("rank", rank).join(small_side(places), ["length", "part"])
    own: list[Column] = [F.col(c) for c in pieces.columns]
    return rows.select(*own, (F.col("first") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), (F.col("first_batch") + F.floor((F.col("within") + F.col("rank")) / fits)).cast("long").alias("batch_id"))


def pack_documents(documents: DataFrame, vocabulary: str | None = None, longest: int = LONGEST, end_id: int = END_ID, batch_tokens: int = BATCH_TOKENS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, start, length, ids_crc32, doc_tokens (and
    ids), sequence_id, offset, batch_id."""
    return number_buckets(materialise(cut_documents(documents, vocabulary, longest, end_id, id_col, text_col, with_ids)), batch_tokens)
