"""Corpus pipeline: five stages over documents, each by one operator of the subpackage ``llm``.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and
read again as the next stage's docs.  All but the last keep the columns of documents.

1. language ID: texts whose language is not to be told apart (no letter, no margin) go;
2. SimHash near-dedup: one document of each group stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. secret scans: secrets inside the texts are replaced by a mark, n_chars follows;
5. BPE encoding and decoding: ids are counted and digested, and the round trip is checked.

Null or empty texts go in stage 1; rows with a null id pass stages 2 and 3.  Where an id stands on
several rows, stage 2 looks at each row's text: a group keeps one row whatever its ids, and of rows
equal in id and text one; stage 3 removes all rows of an id that holds an item.  Very long texts are
read whole by every stage.  Columns of documents may have any names and keep their place.  An empty
table gives an empty result.  A stage's rule is applied to every row of what the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import bpe, decontaminate, langid, secrets, simhash
from citeweave.llm.common import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return langid.keep_identified(docs, langid.fit_dictionaries(docs.where(~held_out)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_redaction),
    ("bpe_codec", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs


#: Compression, SimHash and BPE cannot be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
