"""Elements of large JSON arrays, read by many tasks a file.

A file is read as text that ends at closing braces, so it splits like any text.  What a split does to
the bracket depth follows from its characters but for one thing: whether it begins inside a string.
A first pass gives both answers for every split; the splits of a file, few as they are, are then put
in order and each learns how deep it begins and whether in a string.  A second pass cuts the elements
of the array (or of the arrays in an envelope) where a comma or the closing bracket stands at the
array's own depth.  Elements that lie over several splits are put together by the element's number.

Quotes, escapes and brackets are found in numpy arrays over a batch of text.  A file whose brackets do
not close, or that has anything but one comma between elements, is no JSON and gives no element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.stages import scratch_keep

#: Keys of an envelope whose array holds the records, in order of preference.
ENVELOPES = ("data", "records", "results")
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z')
#: Bytes before an opening bracket in which its key is looked for.
BEFORE = 4096


def structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, inside): every quote that no backslash escapes, bracket, brace and comma, and whether an
    odd number of quotes stands before it."""
    marks = np.zeros(256, bool)
    marks[[ord(c) for c in '"[]{},']] = True
    at = np.flatnonzero(marks[data])
    slashes = np.flatnonzero(data == 92)
    if len(slashes):
        # The last of an odd run of backslashes escapes what follows.
        ends = np.flatnonzero(np.r_[np.diff(slashes) > 1, True])
        run = np.diff(np.r_[-1, ends])
        escaped = slashes[ends[run % 2 == 1]] + 1
        at = at[~((data[at] == 34) & np.isin(at, escaped))]
    quotes = data[at] == 34
    return at, (np.cumsum(quotes) - quotes) % 2 == 1


def steps(kind: np.ndarray) -> np.ndarray:
    """+1 for what opens, -1 for what closes."""
    return np.isin(kind, (91, 123)).astype(np.int64) - np.isin(kind, (93, 125))


class Cutter:
    """Cuts one split of a file, batch by batch, from a known beginning."""

    def __init__(self, top: str, inside: bool, depth: int):
        self.level = 1 if top == "[" else 2
        self.inside, self.depth, self.first = inside, depth, True
        # The array that is open: its key, None if it was opened in an earlier split, False if there is none.
        self.open: object = None if depth >= self.level else False
        self.began, self.buffer, self.rows, self.last = False, [], [], None
        self.tail = b""

    def _put(self, key: object, ends: bool) -> None:
        self.rows.append((key, self.began, ends, b"".join(self.buffer).decode("utf-8", "replace")))
        self.buffer = []

    def feed(self, text: bytes) -> None:
        data = np.frombuffer(text, np.uint8)
        at, inside = structure(data)
        quotes = int((data[at] == 34).sum())
        plain = ~(inside ^ self.inside) & (data[at] != 34)
        at = at[plain]
        kind = data[at]
        after = self.depth + np.cumsum(steps(kind))
        before = after - steps(kind)
        level = self.level
        event = ((before == level - 1) & (after == level)) | ((before == level) & (after == level - 1)) | ((kind == 44) & (after == level))
        place = 0
        for i, c in zip(at[event].tolist(), kind[event].tolist()):
            if c == 44:
                if self.open is not False:
                    self.buffer.append(text[place:i])
                    self._put(self.open, True)
                    self.began, place = True, i + 1
            elif c in (91, 123):
                self.open = self.last = False
                if c == 91:
                    key = KEY.search((self.tail + text[:i])[-BEFORE:]) if level == 2 else None
                    self.open = self.last = "" if level == 1 else key and key[1].decode("utf-8", "replace") or False
                self.buffer, self.began, place = [], True, i + 1
            else:
                if self.open is not False:
                    self.buffer.append(text[place:i])
                    self._put(self.open, True)
                self.open = self.last = False
                self.buffer = []
        if self.open is not False:
            self.buffer.append(text[place:])
        self.depth = int(after[-1]) if len(after) else self.depth
        self.inside ^= bool(quotes % 2)
        self.tail = (self.tail + text)[-BEFORE:]

    def close(self) -> list[tuple]:
        """(key, begins, ends, text) of every piece; the last is open if an element goes on."""
        if self.open is not False:
            self._put(self.open, False)
        return self.rows


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, lineSep="}")
    return raw.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.col("_metadata.file_size").alias("size"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """((file, split, more..), text) of neighbouring rows of one split, each with its closing brace again."""
    for batch in batches:
        rows = batch.to_pydict()
        value = rows.pop("value")
        heads = list(zip(*rows.values()))
        i = 0
        while i < len(heads):
            j = i
            while j < len(heads) and heads[j] == heads[i]:
                j += 1
            yield heads[i], "".join(v + "}" for v in value[i:j]).encode()
            i = j


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: its first character, bytes, and (ends in a string, depth gained) by how it begins."""
    found: dict[tuple, list] = {}
    for head, text in _runs(batches):
        x = found.setdefault(head, ["", [False, True], [0, 0], 0])
        x[0] = x[0] or text.lstrip()[:1].decode("utf-8", "replace")
        x[3] += len(text)
        data = np.frombuffer(text, np.uint8)
        at, inside = structure(data)
        kind = data[at]
        gain = [int(steps(kind[~inside]).sum()), int(steps(kind[inside]).sum())]  # begins outside, inside a string
        for s in (0, 1):
            x[2][s] += gain[x[1][s]]
            x[1][s] ^= bool((kind == 34).sum() % 2)
    rows = [(*k, v[0], *map(bool, v[1]), *v[2], v[3]) for k, v in found.items()]
    names, kinds = ["f", "b", "size", "top", "in0", "in1", "d0", "d1", "n"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), *[pa.int64()] * 3]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of every split, and one row (seq -1) with what it leaves open: a key, or ``-`` for nothing."""
    cut: Cutter | None = None
    now = None

    def done() -> Iterator[pa.RecordBatch]:
        rows = [(*now[:2], i, key if key is not None else None, begins, ends, text) for i, (key, begins, ends, text) in enumerate(cut.close())]
        last = None if cut.last is None else "-" if cut.last is False else cut.last
        rows.append((*now[:2], -1, last, False, False, None))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["f", "b", "seq", "key", "begins", "ends", "text"])

    for head, text in _runs(batches):
        if head != now:
            if cut:
                yield from done()
            now, cut = head, Cutter(head[2], head[3], head[4])
        cut.feed(text)
    if cut:
        yield from done()


def whole_texts(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(f, value): the whole text of those of the files that ``files`` (f) names, each a document of its own."""
    raw = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("f"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("o")).alias("at"), F.col("_metadata.file_size").alias("size"), "value")
    found = raw.join(files.select("f"), "f", "left_semi").groupBy("f").agg(F.max("size").alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "}").alias("value"))
    return found.select("f", F.when(F.octet_length("value") < F.col("size"), F.concat("value", F.lit("}"))).otherwise(F.col("value")).alias("value"))


def read_arrays(spark: SparkSession, path: str, tops: str = "[{") -> tuple[DataFrame, DataFrame]:
    """((f, ordinal, item), (f, top, sound)): the elements of the files' arrays as JSON texts, in order, and
    for every file its first character and whether it was cut without a fault.  A file that is an object
    is taken for an envelope: of its arrays named in ENVELOPES the first that is not empty counts.
    ``tops``: first characters of the files that are looked into."""
    keep = scratch_keep(spark)
    parts = _fragments(spark, path)
    splits = keep("splits", parts.mapInArrow(_summaries, "f string, b long, size long, top string, in0 boolean, in1 boolean, d0 long, d1 long, n long"))
    # A row a split and task: a split lies in one task.  Some ten splits a GB and file.
    each = splits.groupBy("f").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("b", "top", "in0", "in1", "d0", "d1"))).alias("s"))
    begin = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"), F.array().cast("array<struct<b: long, inside: boolean, depth: long>>").alias("out"))

    def step(acc, x):
        gain = F.when(acc["inside"], x["d1"]).otherwise(x["d0"])
        out = F.concat(acc["out"], F.array(F.struct(x["b"].alias("b"), acc["inside"].alias("inside"), acc["depth"].alias("depth"))))
        return F.struct(F.when(acc["inside"], x["in1"]).otherwise(x["in0"]).alias("inside"), (acc["depth"] + gain).alias("depth"), out.alias("out"))

    files = keep("files", each.select("f", (F.col("n") - F.col("size")).alias("added"), F.col("s")[0]["top"].alias("top"), F.aggregate("s", begin, step).alias("r")))
    starts = files.where(F.col("top").isin(*tops)).select("f", "top", F.explode("r.out").alias("x")).select("f", "top", "x.*")
    told = parts.join(F.broadcast(starts), ["f", "b"]).select("f", "b", "top", "inside", "depth", "value")  # a row a split
    pieces = keep("pieces", told.mapInArrow(_pieces, "f string, b long, seq long, key string, begins boolean, ends boolean, text string"))
    # What an earlier split has left open, and the last element that has begun before.
    order = W.partitionBy("f").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    ends = pieces.groupBy("f", "b").agg(F.max(F.when(F.col("seq") < 0, F.col("key"))).alias("left"), F.max(F.when(F.col("begins"), F.struct("b", "seq"))).alias("begun"))
    carried = ends.select("f", "b", F.last("left", True).over(order).alias("carried"), F.last("begun", True).over(order).alias("from"))
    mine = pieces.where("seq >= 0").join(F.broadcast(carried), ["f", "b"])  # a row a split
    mine = mine.withColumn("key", F.coalesce("key", "carried")).withColumn("id", F.when(F.col("begins"), F.struct("b", "seq")).otherwise(F.col("from")))
    whole = mine.where("begins AND ends").select("f", "key", "id", "text")
    joined = mine.where("NOT (begins AND ends)").groupBy("f", "id").agg(
        F.min_by("key", "b").alias("key"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "text"))), lambda x: x["text"]), "").alias("text"))
    wanted = F.array_position(F.array(F.lit(""), *map(F.lit, ENVELOPES)), F.col("key"))
    rows = whole.unionByName(joined.select("f", "key", "id", "text")).withColumn("rank", wanted).where("rank > 0")
    rows = keep("elements", rows.select("f", "rank", "id", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("item")))
    blank = rows.groupBy("f", "rank").agg(F.count("*").alias("n"), F.count_if(F.col("item") == "").alias("blank"), F.count_if((F.col("item") != "") & F.expr("try_parse_json(concat('[', item, ']')) IS NULL")).alias("bad"))
    # An empty array has one blank element.
    blank = blank.withColumn("empty", (F.col("n") == 1) & (F.col("blank") == 1))
    chosen = blank.where("NOT empty").groupBy("f").agg(F.min("rank").alias("rank"))
    faults = blank.groupBy("f").agg(F.max((F.col("bad") > 0) | ((F.col("blank") > 0) & ~F.col("empty"))).alias("fault"))
    # Where a file does not end with a brace, one was added behind it.
    shut = (F.col("r.depth") + F.col("added") == 0) & ~F.col("r.inside")
    sound = keep("sound", files.join(faults, "f", "left").select("f", "top", (shut & ~F.coalesce("fault", F.lit(False))).alias("sound")))
    good = rows.join(chosen, ["f", "rank"]).join(sound.where("sound").select("f"), "f", "left_semi")
    # Places within a split, and before it: no window holds a whole file.
    place = good.withColumn("b", F.col("id.b")).withColumn("i", F.row_number().over(W.partitionBy("f", F.col("id.b")).orderBy("id.seq")))
    place = keep("places", place)
    per = place.groupBy("f", "b").agg(F.count("*").alias("n"))
    per = per.select("f", "b", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return place.join(per, ["f", "b"]).select("f", (F.col("before") + F.col("i") - 1).cast("int").alias("ordinal"), "item"), sound
