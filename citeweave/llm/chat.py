"""Chat formatting: multi-party perspective rotation, in DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered once with that speaker as the
assistant and all others as named users; the mask holds the character spans that are to be learned
(the assistant's text and its end mark).  ``system`` turns are no participant: they are rendered as
context in every perspective and never learned.

A dialogue may be very long, so a rendering is given in parts of ``PART`` turn numbers: one row for
(conv_id, perspective, part, sub), whose texts joined by part and sub give the whole rendering.  Turns
are dealt by (conversation, part), never by conversation alone, and the participants are joined on
salted keys.  Where turn numbers are missing or repeat, so that more than ``CROWD`` rows share a part,
each turn number is dealt on into subs of about PART rows by a hash of role and text, and equal rows
are counted, not gathered; otherwise sub is 0.

Null conv_id: its rows form a dialogue of their own.  Null turn: part -1, before all others.  Null
role: speaker ``unknown``.  Null text: empty.  Ties of turn: by sub, then role, then text; repeated
rows each stand.  Control marks inside a text or a role are escaped, and so are line ends in a role:
a rendering has only its own marks.  A dialogue of system turns only has no participant and gives no
row, and neither does an empty table.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import materialise, salted_join

#: Turn numbers of one part, and what a rendering is made of.
PART = 256
CROWD = 4 * PART
OPEN, CLOSE, END, ESCAPED = "<|", "|>", "<|end|>\n", "<\\|"
CONTEXT = "system"


def _header(role: Column, perspective: Column) -> Column:
    user = F.concat(F.lit(f"{OPEN}user name="), role, F.lit(f"{CLOSE}\n"))
    return F.when(role == CONTEXT, F.lit(f"{OPEN}{CONTEXT}{CLOSE}\n")).when(role == perspective, F.lit(f"{OPEN}assistant{CLOSE}\n")).otherwise(user)


def _escape(c: Column) -> Column:
    return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit(OPEN), F.lit(ESCAPED))


def _escape_role(c: Column) -> Column:
    """Of a role also the closing mark and line ends, for it stands inside a header."""
    for mark, other in ((CLOSE, "|\\>"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(mark), F.lit(other))
    return c


def _dealt(turns: DataFrame) -> DataFrame:
    """``turns`` with sub and times; equal rows of a crowded part are folded."""
    turns = turns.withColumn("turn_key", F.coalesce(F.col("turn").cast("string"), F.lit("null")))
    sizes = turns.groupBy("key", "part", "turn_key").agg(F.count("*").alias("n"))
    full = materialise(sizes.groupBy("key", "part").agg(F.sum("n").alias("total")).where(F.col("total") > CROWD).drop("total"))
    single = lambda rows: rows.withColumn("sub", F.lit(0).cast("long")).withColumn("times", F.lit(1))
    if full.isEmpty():
        return single(turns)
    crowded = sizes.join(full, ["key", "part"])
    met = salted_join(turns, crowded, ["key", "part", "turn_key"], F.xxhash64("role", "body"), "left")
    folded = met.where("n IS NOT NULL").groupBy("conv_id", "key", "part", "turn", "turn_key", "role", "body", "n").agg(F.count("*").alias("m"))
    folded = folded.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {PART}"))).alias("copy"))
    mark = F.conv(F.substring(F.md5(F.concat_ws("\n", "role", "body", F.col("copy").cast("string"))), 1, 7), 16, 10).cast("long")
    place = F.coalesce(F.col("turn") - F.col("part") * PART + 1, F.lit(0).cast("long"))
    sub = place * (1 << 32) + F.floor(mark * F.ceil(F.col("n") / PART) / float(1 << 28))
    folded = folded.withColumn("sub", sub.cast("long")).withColumn("times", F.least(F.lit(PART), F.col("m") - F.col("copy") * PART).cast("int"))
    return single(met.where("n IS NULL").drop("n")).unionByName(folded.drop("n", "m", "copy"))


def render(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """conv_id, perspective, part, sub, n_turns, n_target_turns, n_chars, n_target_chars, mask, text."""
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        _escape_role(_escape(F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")))).alias("role"), _escape(F.col(text_col)).alias("body"),
    ).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    turns = turns.withColumn("part", F.coalesce(F.floor(F.col("turn") / F.lit(part)).cast("long"), F.lit(-1).cast("long")))
    people = turns.where(F.col("role") != CONTEXT).select("key", F.col("role").alias("perspective")).distinct()
    seen = salted_join(_dealt(turns), people, ["key"], F.xxhash64("turn", "part", "role", "body"))
    # What is learned of a turn and what is not, before turns are put in order.
    head = _header(F.col("role"), F.col("perspective"))
    item = F.struct("turn", "role", "body", head.alias("head"), "times")
    whole = seen.groupBy("conv_id", "key", "perspective", "part", "sub").agg(F.sort_array(F.collect_list(item)).alias("turns"))
    whole = whole.withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["times"]))))
    pieces = whole.withColumn("turns", F.transform("turns", lambda t: F.struct(
        F.concat(t["head"], t["body"], F.lit(END)).alias("text"), F.char_length(t["head"]).alias("head"),
        (F.char_length(t["body"]) + len(END)).alias("body"), (t["role"] == F.col("perspective")).alias("learned"))))
    size = lambda t: t["head"] + t["body"]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("mask"), F.lit(0).alias("chars"))

    def step(acc: Column, t: Column) -> Column:
        a, b = acc["at"] + t["head"], acc["at"] + size(t)
        span = F.array(F.concat_ws(":", a.cast("string"), b.cast("string")))
        return F.struct(b.alias("at"), F.when(t["learned"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"),
                        (acc["chars"] + F.when(t["learned"], t["body"]).otherwise(0)).alias("chars"))

    done = pieces.withColumn("fold", F.aggregate("turns", start, step))
    return done.select(
        "conv_id", "perspective", "part", "sub", F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["learned"])).cast("long").alias("n_target_turns"),
        F.col("fold.at").cast("long").alias("n_chars"), F.col("fold.chars").cast("long").alias("n_target_chars"),
        F.array_join("fold.mask", ",").alias("mask"), F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"),
    )


#: DuckDB SQL for render over conversations.
ORACLE_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(floor(turn / {PART}.0)::BIGINT, -1) AS part,
    replace(replace(replace(replace(coalesce(role, 'unknown'), '<|', '<\\|'), '|>', '|\\>'), chr(10), '\\n'), chr(13), '\\r') AS role,
    replace(coalesce(text, ''), '<|', '<\\|') AS body FROM conversations),
c AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id, part) AS total, count(*) OVER (PARTITION BY conv_id, part, turn) AS n,
    (row_number() OVER (PARTITION BY conv_id, turn, role, body) - 1) // {PART} AS copy FROM r),
t AS (
  SELECT *, CASE WHEN total <= {CROWD} THEN 0 ELSE coalesce(turn - part * {PART} + 1, 0) * {1 << 32}
    + ('0x' || substr(md5(concat_ws(chr(10), role, body, copy::VARCHAR)), 1, 7))::BIGINT * ceil(n / {PART}.0)::BIGINT // {1 << 28} END AS sub
  FROM c),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (
  SELECT t.conv_id, perspective, part, sub, turn, role, body, role = perspective AS learned,
    CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, row_number() OVER w AS rn, sum(length(head) + length(body) + 8) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective, part, sub ORDER BY turn NULLS FIRST, role, body))
SELECT conv_id, perspective, part, sub, count(*) AS n_turns, CAST(count_if(learned) AS BIGINT) AS n_target_turns,
  CAST(max(upto) AS BIGINT) AS n_chars, CAST(coalesce(sum(length(body) + 8) FILTER (WHERE learned), 0) AS BIGINT) AS n_target_chars,
  coalesce(string_agg((upto - length(body) - 8)::BIGINT || ':' || upto::BIGINT, ',' ORDER BY rn) FILTER (WHERE learned), '') AS mask,
  string_agg(head || body || '<|end|>' || chr(10), '' ORDER BY rn) AS text
FROM o GROUP BY conv_id, perspective, part, sub"""
