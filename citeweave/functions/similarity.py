"""Similarity of text pairs: sublinear term-frequency cosine, or cosine of vectors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.functions.text import STOPWORDS, tokens

_TERM, _STOP = re.compile("[a-z0-9]+"), frozenset(STOPWORDS)


def tf_vectors(texts: DataFrame, id_cols: list[str], text: Column) -> DataFrame:
    """(id.., term, weight) with weight 1 + ln(count)."""
    terms = texts.select(*id_cols, F.explode(tokens(text)).alias("term"))
    return terms.groupBy(*id_cols, "term").agg((F.lit(1.0) + F.ln(F.count("*").cast("double"))).alias("weight"))


@lru_cache(maxsize=64)
def _weights(text: str) -> tuple[dict[str, float], float]:
    """Weight of each term of a lower-case text, and their squares' sum."""
    counts = Counter(_TERM.findall(text))
    found = {t: 1.0 + math.log(n) for t, n in counts.items() if t not in _STOP}
    return found, sum(w * w for w in found.values())


def _cosine(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    (short, aa), (long, bb) = sorted((_weights(a), _weights(b)), key=lambda x: len(x[0]))
    dot = sum(w * long[t] for t, w in short.items() if t in long)
    return dot / (math.sqrt(aa) * math.sqrt(bb)) if dot else 0.0


#: Rows of an Arrow batch that are Python strings at a time.
ROWS = 256


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _cosines(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Cosine of the term vectors of each two neighbouring columns of lower-case texts; null if one is null."""
    for columns in batches:
        out = []
        for at in range(0, len(columns[0]), ROWS):
            texts = zip(*[c.slice(at, ROWS).to_pylist() for c in columns])
            out += [[_cosine(a, b) for a, b in zip(row[::2], row[1::2])] for row in texts]
        yield pa.array(out, pa.list_(pa.float64()))


def lexical_cosines(pairs: list[tuple[Column, Column]]) -> Column:
    """Array of the cosines of the term vectors of pairs of texts, to four decimals; 0 for empty ones, null if one
    is null.  Row by row, so the terms of a text are never shuffled, and a text of several pairs is read once."""
    found = _cosines(*[F.lower(c.cast("string")) for pair in pairs for c in pair])
    return F.transform(found, lambda x: F.round(x, 4))


def lexical(pairs: DataFrame, id_cols: list[str], a: Column, b: Column, name: str = "sim") -> DataFrame:
    """(id.., name): cosine of the term vectors of ``a`` and ``b`` for every row of ``pairs``; empty texts give 0."""
    filled = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return pairs.select(*id_cols, lexical_cosines([(filled(a), filled(b))])[0].alias(name))


#: All pairs of a row at once, for operators that need no rows apart.
lexical.columns = lexical_cosines


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))


#: Queries and rows that meet in one block of ``nearest``.
QUERY_BLOCK, ROW_BLOCK = 2048, 8192


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, sim, rank): for each of ``queries`` (query_id, q) the k most similar of ``rows``
    (vec_id, embedding) but itself; cosine to four decimals, ties by vec_id.

    Exact, in blocks: a block of queries meets a block of rows in one task, which keeps the best k of
    each query, so what is shuffled after that is k rows a query and block.  Vectors without length, or
    of another length than the query, have similarity 0.
    """
    n_q = max(1, -(-queries.count() // QUERY_BLOCK))
    n_r = max(1, -(-rows.count() // ROW_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), block("query_id", n_q).alias("qb"), every(n_r).alias("rb"))
    right = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), block("vec_id", n_r).alias("rb"), every(n_q).alias("qb"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        size = lambda s: s.map(lambda x: -1 if x is None else len(x)).to_numpy()
        na, nb = size(a["q"]), size(b["embedding"])
        ids = b["vec_id"].to_numpy()

        def unit(s: pd.Series) -> np.ndarray:
            m = np.nan_to_num(np.array(s.tolist(), float))
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

        for n in np.unique(na):
            mine, theirs = a[na == n], nb == n
            sims = np.zeros((len(mine), len(b)))
            if n > 0 and theirs.any():
                sims[:, theirs] = np.round(unit(mine["q"]) @ unit(b["embedding"][theirs]).T, 4)
            for qid, s in zip(mine["query_id"], sims):
                s = np.where(ids == qid, -np.inf, s)
                last = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                at = np.flatnonzero((s >= last) & (s > -np.inf))
                at = at[np.lexsort((ids[at], -s[at]))][:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[at], "sim": s[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "sim": []})

    parts = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(best, "query_id long, vec_id long, sim double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def embed(texts: DataFrame, text_col: str, fn: Callable[[Sequence[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """``texts`` with the vectors that an injected function gives, a batch at a time; [] where it fails."""
    names = texts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                vectors = list(fn(list(b[text_col])))
            except Exception:  # noqa: BLE001  an outside service: fall back to one text at a time
                vectors = []
                for t in b[text_col]:
                    try:
                        vectors.append(fn([t])[0])
                    except Exception:  # noqa: BLE001
                        vectors.append([])
            yield b.assign(**{out: vectors})

    schema = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes)
    return texts.select(*names).mapInPandas(run, f"{schema}, {out} array<double>")


def embed_new(texts: DataFrame, known: DataFrame, text_col: str, fn: Callable, out: str = "embedding") -> DataFrame:
    """Vectors for the distinct texts; those in ``known`` (text, vector) are not embedded again."""
    distinct = texts.select(text_col).distinct()
    new = embed(distinct.join(known, text_col, "left_anti"), text_col, fn, out)
    return known.join(distinct, text_col, "left_semi").select(text_col, out).unionByName(new)


def scorer(method: str = "lexical", fn: Callable[[Sequence[str]], list[list[float]]] | None = None) -> Callable:
    """A pair operator with the arguments of ``lexical``: that one, or the cosine of vectors that ``fn``
    gives if the method names embeddings; without ``fn`` it falls back to ``lexical``."""
    if "embed" not in (method or "") or fn is None:
        return lexical

    def dense(pairs: DataFrame, id_cols: list[str], a: Column, b: Column, name: str = "sim") -> DataFrame:
        p = pairs.select(*id_cols, F.coalesce(a, F.lit("")).alias("__a"), F.coalesce(b, F.lit("")).alias("__b"))
        texts = p.select(F.col("__a").alias("t")).unionByName(p.select(F.col("__b").alias("t"))).where("t <> ''").distinct()
        v = embed(texts, "t", fn)
        met = p.join(v.select(F.col("t").alias("__a"), F.col("embedding").alias("va")), "__a", "left").join(v.select(F.col("t").alias("__b"), F.col("embedding").alias("vb")), "__b", "left")
        value = F.when((F.size("va") > 0) & (F.size("va") == F.size("vb")), F.round(dense_cosine(F.col("va"), F.col("vb")), 4))
        return met.select(*id_cols, F.coalesce(value, F.lit(0.0)).alias(name))

    return dense


def top_mean(scores: Column, k: int = 3) -> Column:
    """max, mean and mean of the top k of an array of scores; zeros if empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    top = F.slice(F.sort_array(scores, asc=False), 1, k)
    value = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    return F.struct(value(F.array_max(scores)).alias("max"), value(F.try_divide(total(scores), F.size(scores))).alias("mean"), value(F.try_divide(total(top), F.size(top))).alias("mean_top"))
