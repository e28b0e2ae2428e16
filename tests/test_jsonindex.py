"""Large JSON arrays cut by many tasks: the same elements as by reading the whole document."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.sources import export, jsonindex

MARKS = ["a", '"', "\\", "}", "{", "[", "]", ",", "é", "\n", " ", "日", "😀"]


def value(rng, depth=0):
    k = rng.random()
    if k < 0.35:
        return "".join(rng.choice(MARKS) for _ in range(rng.randrange(12)))
    if k < 0.6:
        return rng.choice([None, True, 1.5, rng.randrange(1000)])
    if k < 0.8 and depth < 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}" + rng.choice(["", '"', "}", ","]): value(rng, depth + 1) for i in range(rng.randrange(4))} if depth < 3 else False


def test_structure_equals_a_loop_over_characters():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice('"\\[]{},ax') for _ in range(rng.randrange(40))).encode()
        at, inside = jsonindex.structure(np.frombuffer(text, np.uint8))
        want, quoted, i = [], False, 0
        run = 0
        for i, c in enumerate(text):
            if c == 34 and run % 2 == 0:
                want.append((i, quoted))
                quoted = not quoted
            elif chr(c) in "[]{},":
                want.append((i, quoted))
            run = run + 1 if c == 92 else 0
        assert list(zip(at.tolist(), inside.tolist())) == want


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_elements_equal_whole_documents(spark, tmp_path, small_splits):
    rng, want = random.Random(1), {}
    for i in range(14):
        items = [value(rng) if rng.random() < 0.3 else {"prompt": value(rng), "n": i, "x": value(rng)} for _ in range(rng.randrange(40))]
        doc = items if i % 3 else {"meta": {"a": 1, "b": [1, 2, {"data": [5]}]}, rng.choice(jsonindex.ENVELOPES): items, "z": value(rng)}
        text = json.dumps(doc, ensure_ascii=bool(i % 2), indent=rng.choice([None, 1]))
        text = {5: text[:-1], 7: text.replace(",", " ", 1), 8: text + "]", 10: text[: len(text) // 2], 11: "[1, 2,, 3]"}.get(i, text)
        (tmp_path / f"{i:02d}.json").write_text(text)
        try:
            x = json.loads(text)
            want[i] = x if isinstance(x, list) else next((x[k] for k in jsonindex.ENVELOPES if x.get(k)), [])
        except ValueError:
            want[i] = None
    items, files = jsonindex.read_arrays(spark, str(tmp_path))
    got: dict = {}
    for r in items.collect():
        got.setdefault(int(r.f[-7:-5]), {})[r.ordinal] = json.loads(r["item"])
    assert {int(r.f[-7:-5]): r.sound for r in files.collect()} == {i: x is not None for i, x in want.items()}
    for i, x in want.items():
        assert [got.get(i, {}).get(k) for k in range(len(got.get(i, {})))] == (x or []), i


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    records = [{"prompt": f"prompt {i} \"}}{{\\", "answer_text": "x" * (i % 90), "citations": [{"url": f"https://a{i}.test/"}]} for i in range(200)]
    (tmp_path / "big.json").write_text(json.dumps(records))
    parts = jsonindex._fragments(spark, str(tmp_path / "big.json"))
    assert parts.select(F.spark_partition_id()).distinct().count() > 10
    got = export.parse_records(export.read_json(spark, str(tmp_path / "big.json"))).orderBy("ord").collect()
    assert [(r.ord, r.prompt) for r in got] == [(i, x["prompt"]) for i, x in enumerate(records)]
    assert json.loads(got[7].citations) == records[7]["citations"]


def test_files_without_an_array(spark, tmp_path):
    for name, text in (("one", '{"prompt": "p {1}", "data": []}'), ("two", ' {"prompt": "q", "meta": {"data": [1]}}\n'), ("flat", '"text"'), ("empty", "[]"), ("mixed", '[{"prompt": "r"}, 5, {"prompt": "s"}]'), ("bad", '{"prompt": ')):
        (tmp_path / f"{name}.json").write_text(text)
    rows = export.read_json(spark, str(tmp_path)).collect()
    assert sorted((r.ordinal, r.prompt) for r in rows) == [(0, "p {1}"), (0, "q"), (0, "r"), (2, "s")]
    warned = sorted((r.file.rsplit("/", 1)[1], r.warning) for r in export.file_warnings(spark, str(tmp_path)).collect())
    assert warned == [("bad.json", "JSON parse failed"), ("flat.json", "top-level JSON is no array of records"), ("mixed.json", "record 2 is no object, skipped")]
