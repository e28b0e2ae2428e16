"""License scans with a positional rare-token index, in DataFrame functions only.

A template is a licence's header or grant paragraph as words with positions, a label, and mandatory
key phrases.  The document frequency of each template word is counted over all documents, and the
template's postings are its ``ANCHORS`` highest-IDF words with their positions.  A file looks up
those words among its own: each hit minus the posting's position is a place where the template could
start, and the postings are intersected by that relative position.  One posting in ``MISSING`` may be
absent, so a changed word here and there hides no licence.  At every place left the mandatory
phrases must stand word by word where the template has them.  The base phrases are templates of two
or three words, all of which are postings and none may be absent.

The texts are split into words once; the hits of all template words are written, and frequencies,
intersection and verification read those alone.  Starts are put in order and counted where they
repeat, and the phrases' words are met the same way, so a text with very many hits costs a sort.

Null and empty texts: no words, no places, null first and last word, empty labels, score 0.
Ties of IDF: the earlier word of the template; of a word that a template repeats, its first place.
Repeated rows and rows with a null id keep their own result; an empty table gives an empty result;
other columns, whatever their names, play no part.  Texts are read whole, however long.  The score
is the greatest share of a template's postings met at a verified place, 0 without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import id_text, materialise

# Label and phrase of the base.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
# Label, words of the licence's own text, mandatory phrases.
TEXTS = (
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    (
        "apache-text",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
        " you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("licensed under the apache license",),
    ),
    ("apache-line", "licensed under the apache license version 2 0", ("apache license version",)),
    (
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version 2 of the license or at your option any later version",
        ("redistribute it and or modify it", "gnu general public license"),
    ),
    (
        "lgpl-text",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"
        " as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("redistribute it and or modify it", "gnu lesser general public license"),
    ),
    (
        "agpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"
        " as published by the free software foundation either version 3 of the license or at your option any later version",
        ("redistribute it and or modify it", "gnu affero general public license"),
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee",),
    ),
    (
        "mpl-text",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("mozilla public license",),
    ),
    ("cc-line", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    (
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        ("free and unencumbered software", "public domain"),
    ),
    ("spdx", "spdx license identifier", ()),
)
TEMPLATES = (*((label, phrase, ()) for label, phrase in BASE), *TEXTS)
#: Postings of a template; one in MISSING may be absent from a file.
ANCHORS, MISSING = 8, 4
#: One word of a text, either case; the Kelvin sign is kept apart from the letter its lower case is.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text; only words are lowered, which for A-Z equals lowering the text."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def word_hits(documents: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, hits): where the template words stand; ``documents``: doc_id, text."""
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    rows = documents.select("doc_id", words_of(F.col("text")).alias("words"))
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("i")))))
    return rows.select("doc_id", F.size("words").alias("n_words"), hits.alias("hits"))


def document_frequencies(hits: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Documents that hold each template word, over all rows; at most one row a template word."""
    held = hits.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("word"))
    return {w: 0 for _, text, _ in templates for w in text.split()} | {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}


def build_index(df: dict[str, int], templates=TEMPLATES, anchors: int = ANCHORS) -> list[list[tuple[str, int]]]:
    """Postings by template: its rarest words (distinct) with their positions."""
    out = []
    for _, text, _ in templates:
        first: dict[str, int] = {}
        for i, w in enumerate(text.split()):
            first.setdefault(w, i)
        out.append(sorted(first.items(), key=lambda x: (df.get(x[0], 0), x[1]))[:anchors])
    return out


def needed(postings: list) -> int:
    """Postings that must agree on a place."""
    return len(postings) - len(postings) // MISSING


def demands(text: str, phrases: tuple[str, ...]) -> list[tuple[int, list[str]]]:
    """Mandatory phrases of a template and where they begin in it."""
    words, out = text.split(), []
    for p in phrases:
        p = p.split()
        out.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), p))
    return out


def _starts(hits: str, postings: list[tuple[str, int]]) -> Column:
    """Where a template could start, once for each posting that is met there, in order."""
    at = lambda word, i: F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["i"] - i)
    return F.sort_array(F.flatten(F.array(*[at(w, i) for w, i in postings])))


def _agreed(starts: Column, need: int) -> Column:
    """The starts that stand at least ``need`` times among the ordered ``starts``."""
    # In order, a start that stands there need times is equal to the one need - 1 behind it.
    pairs = F.arrays_zip(starts.alias("a"), F.slice(starts, need, F.greatest(F.size(starts), F.lit(1))).alias("b"))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: p["a"] == p["b"]), lambda p: p["a"]))


def _verified(met: str, text: str, phrases: tuple[str, ...]) -> Column:
    """Of the starts ``met``, those at which every word of the mandatory phrases stands in its place.  The
    phrases' words are postings, all of which must agree: one pass over the hits for each of them."""
    words = [(word, at + j) for at, phrase in demands(text, phrases) for j, word in enumerate(phrase)]
    if not words:
        return F.col(met)
    return F.when(F.size(met) > 0, F.array_intersect(F.col(met), _agreed(_starts("hits", words), len(words)))).otherwise(F.col(met))


def find_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per row of ``documents``: words, base places, labels and score."""
    docs = materialise(word_hits(id_text(documents, id_col, text_col), templates))
    index = build_index(document_frequencies(docs, templates), templates)
    rare = sorted({w for postings in index for w, _ in postings})
    docs = docs.withColumn("rare", F.filter("hits", lambda h: h["w"].isin(rare)))
    docs = docs.select("doc_id", "n_words", "hits", *[_starts("rare", p).alias(f"s{i}") for i, p in enumerate(index)])
    docs = docs.select("*", *[_agreed(F.col(f"s{i}"), needed(p)).alias(f"m{i}") for i, p in enumerate(index)])
    places = [_verified(f"m{i}", text, phrases).alias(f"p{i}") for i, (_, text, phrases) in enumerate(templates)]
    docs = docs.select("doc_id", "n_words", *[f"s{i}" for i in range(len(index))], *places)
    n_base = len(BASE)
    base = F.flatten(F.array(*[F.col(f"p{i}") for i in range(n_base)]))

    def labels(k: int) -> Column:
        named = [F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (label, _, _) in enumerate(templates[:k])]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*named)))), ",")

    def share(i: int, postings: list) -> Column:
        of, least = len(postings), needed(postings)
        most = F.coalesce(*[F.when(F.arrays_overlap(_agreed(F.col(f"s{i}"), k), F.col(f"p{i}")), k / float(of)) for k in range(of, least, -1)], F.lit(least / float(of)))
        return F.when(F.size(f"p{i}") > 0, most if least < of else F.lit(1.0)).otherwise(0.0)

    return docs.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        labels(n_base).alias("base_labels"), labels(len(templates)).alias("labels"), F.greatest(*[share(i, p) for i, p in enumerate(index)]).alias("score"),
    )


def oracle_sql(templates=TEMPLATES, anchors: int = ANCHORS) -> str:
    """DuckDB SQL for find_licenses over documents: hits, frequencies and postings as relations."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    words, stand = [], []
    for t, (_, text, phrases) in enumerate(templates):
        ws = text.split()
        words += [f"({t}, '{w}', {ws.index(w)})" for w in dict.fromkeys(ws)]
        tests = " AND ".join(f"words[s + {at + 1} : s + {at + len(p)}] = {quoted(p)}" for at, p in demands(text, phrases))
        stand.append(f"WHEN {t} THEN {tests or 'true'}")
    names = ", ".join(f"({t}, '{label}')" for t, (label, _, _) in enumerate(templates))
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
v AS (SELECT * FROM (VALUES {", ".join(words)}) AS v(t, word, pos)),
h AS (SELECT r, i, words[i + 1] AS word FROM (SELECT r, words, unnest(range(len(words))) AS i FROM w) WHERE words[i + 1] IN (SELECT word FROM v)),
f AS (SELECT word, count(DISTINCT r) AS df FROM h GROUP BY word),
k AS (SELECT t, word, pos FROM v LEFT JOIN f USING (word) QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), pos) <= {anchors}),
n AS (SELECT t, count(*) AS n FROM k GROUP BY t),
c AS (SELECT r, t, i - pos AS s, count(*) AS met FROM h JOIN k USING (word) GROUP BY r, t, s),
p AS (SELECT r, t, s, met / n AS share FROM c JOIN n USING (t) JOIN w USING (r)
  WHERE met >= n - n // {MISSING} AND CASE t {" ".join(stand)} END),
g AS (
  SELECT r, count(*) FILTER (WHERE t < {len(BASE)}) AS n_base, min(s) FILTER (WHERE t < {len(BASE)}) AS first_word, max(s) FILTER (WHERE t < {len(BASE)}) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE t < {len(BASE)}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM p JOIN (VALUES {names}) AS l(t, label) USING (t) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN g USING (r)"""
