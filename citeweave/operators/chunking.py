"""Heading-aware windows of words, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.text import HEADING, lines, word_count, words

TARGET, OVERLAP, MOST, LEAST_WORDS = 120, 25, 60, 8


def windows(ws: Column, target: int = TARGET, step: int = TARGET - OVERLAP) -> Column:
    """Windows of ``target`` words that start at every ``step``-th word; one window if they all fit."""

    def of(w: Column) -> Column:
        n = F.size(w)
        starts = F.when(n <= target, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
        return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, target), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(ws), of))  # the words are bound, so they are split once


def segments(markdown: Column) -> Column:
    """array<struct<heading, body>>: lines up to the next heading; a text of headings only is one segment."""
    state = "struct<head:string, body:array<string>, done:array<struct<heading:string, body:string>>>"
    start = F.struct(F.lit("").alias("head"), F.array().cast("array<string>").alias("body"), F.array().cast("array<struct<heading:string, body:string>>").alias("done")).cast(state)

    def closed(s: Column) -> Column:
        one = F.array(F.struct(s["head"].alias("heading"), F.trim(F.array_join(s["body"], "\n")).alias("body")))
        return F.when(F.size(s["body"]) > 0, F.concat(s["done"], one)).otherwise(s["done"])

    def step(s: Column, line: Column) -> Column:
        t = F.trim(line)
        head = F.struct(F.trim(F.regexp_extract(t, HEADING, 1)).alias("head"), F.array().cast("array<string>").alias("body"), closed(s).alias("done"))
        more = F.struct(s["head"].alias("head"), F.concat(s["body"], F.array(line)).alias("body"), s["done"].alias("done"))
        return F.when(t.rlike(HEADING), head.cast(state)).otherwise(more.cast(state))

    found = F.aggregate(lines(markdown), start, step, closed)
    whole = F.array(F.struct(F.lit("").alias("heading"), F.trim(markdown).alias("body")))
    return F.flatten(F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, f).otherwise(whole)))  # bound, so lines are gathered once


def chunk_rows(texts: DataFrame, id_col: str, text_col: str, target: int = TARGET, overlap: int = OVERLAP, most: int | None = MOST, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, also.., idx, heading, text, n_words): pieces of fewer than 8 words go, then at most ``most`` stay, all if it is None."""
    rows = texts.select(id_col, *also, segments(F.col(text_col)).alias("segs"))
    piece = lambda s: F.transform(windows(words(s["body"]), target, max(1, target - overlap)), lambda w: F.struct(s["heading"].alias("heading"), w.alias("text"), word_count(w).alias("n_words")))
    pieces = F.filter(F.flatten(F.transform("segs", piece)), lambda p: p["n_words"] >= LEAST_WORDS)
    kept = pieces if most is None else F.slice(pieces, 1, most)
    return rows.select(id_col, *also, F.posexplode(kept).alias("idx", "p")).select(id_col, *also, "idx", "p.*")
