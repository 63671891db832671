"""One JSON array read by many tasks, against a reader that takes it whole."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.sources import files, json_arrays

SCHEMA = "id bigint, s string, a array<string>, o struct<x:string,y:array<bigint>>"


def odd_text(rng):
    return "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "x", "é", "😀", "\n", " ", ":", "null", "\\\\", '\\"']) for _ in range(rng.randrange(0, 40)))


def rows(n, seed=1):
    rng = random.Random(seed)
    return [{"id": i, "s": odd_text(rng), "a": [odd_text(rng) for _ in range(rng.randrange(3))], "o": {"x": odd_text(rng), "y": [1] * rng.randrange(4)}}
            if rng.random() > 0.03 else {"id": i} for i in range(n)]


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def key(r):
    return json.dumps(r.asDict(True), sort_keys=True)


@pytest.mark.parametrize("split", [40, 1000, 50_000])
@pytest.mark.parametrize("indent,ascii_", [(None, True), (2, False)])
def test_equal_to_the_whole_reader(spark, tmp_path, split, indent, ascii_):
    put(tmp_path / "in", "a.json", json.dumps(rows(400 if split < 100 else 1500), indent=indent, ensure_ascii=ascii_))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    want = Counter(key(r) for r in spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path / "in")).collect())
    spark.conf.set(name, str(split if split > 100 else 400))
    try:
        got = json_arrays.scan_large_arrays(spark, str(tmp_path / "in"), SCHEMA)
        tasks = spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions()
        assert Counter(key(r) for r in got.collect()) == want and tasks >= 4
    finally:
        spark.conf.set(name, before)


def test_odd_files(spark, tmp_path):
    texts = {"empty.json": "", "none.json": " [ ]\n", "one.json": '[{"id": 1}]', "object.json": ' {"id": 2, "a": ["x", "y"],\n "s": "1,2"} ',
             "blanks.json": '\n\t[ {"id" : 3 } ,\n\n {"id":4}\t]\n\n', "nested.json": '[{"id":5,"o":{"x":"[,]","y":[1,2]}},{"id":6,"s":"\\\\"}]',
             "long.json": '[{"id":7,"s":"' + "a,b" * 5000 + '"},{"id":8,"s":"' + "no commas " * 4000 + '"},{"id":9}]'}
    for name, text in texts.items():
        put(tmp_path / "in", name, text)
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "700")
    try:
        got = json_arrays.scan_large_arrays(spark, str(tmp_path / "in"), SCHEMA).collect()
    finally:
        spark.conf.set(conf, before)
    assert sorted(r.id for r in got) == list(range(1, 10))
    by = {r.id: r for r in got}
    assert by[2].a == ["x", "y"] and by[2].s == "1,2" and by[6].s == "\\" and by[5].o.x == "[,]"
    assert len(by[7].s) == 15_000 and len(by[8].s) == 40_000


def test_small_and_large_files_together(spark, tmp_path):
    for i in range(3):
        put(tmp_path / "in", f"{i}.json", json.dumps(rows(300 * (1 + 5 * (i == 1)), i)))
    size = (tmp_path / "in" / "0.json").stat().st_size * 2
    want = Counter(key(r) for r in files.scan_json_array(spark, str(tmp_path / "in"), SCHEMA).collect())
    assert Counter(key(r) for r in files.scan_json_array(spark, str(tmp_path / "in"), SCHEMA, whole=size).collect()) == want
    assert Counter(key(r) for r in files.scan_json_array(spark, str(tmp_path / "in"), SCHEMA, whole=0).collect()) == want


def test_strings_and_depth_byte_by_byte():
    rng = random.Random(3)
    for _ in range(300):
        text = json.dumps([odd_text(rng) for _ in range(3)]).encode()
        inside, depth, escaped, outside_at, levels = False, 0, False, [], []
        for b in text:
            c = chr(b)
            if inside:
                outside_at.append(False)
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    inside = False
            else:
                outside_at.append(c != '"')
                inside = c == '"'
                depth += (c in "[{") - (c in "]}")
            levels.append(depth)
        outside, steps, open_ = json_arrays.strings_and_steps(np.frombuffer(text, np.uint8), False)
        assert outside.tolist() == outside_at and not open_ and np.cumsum(np.where(outside, steps, 0)).tolist() == levels
