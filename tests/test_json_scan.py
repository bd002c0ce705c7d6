import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradarium.sources import json_scan, readers, sinks


def entries_of(text, size, tmp_path):
    """What the ranges of one file give, without Spark: both passes by hand."""
    path = tmp_path / "x.json"
    path.write_bytes(text.encode())
    import pyarrow as pa

    n = len(text.encode())
    starts = list(range(0, n, size))
    batch = pa.record_batch([pa.array([str(path)] * len(starts)), pa.array(starts), pa.array([min(s + size, n) for s in starts])], ["path", "start", "end"])
    rows = [r for b in json_scan._summaries(iter([batch])) for r in b.to_pylist()]
    inside, depth, told = False, 0, []
    for r in rows:
        told.append((r["path"], r["start"], r["end"], inside, depth))
        depth += r["into"] if inside else r["out"]
        inside = (inside + r["quotes"]) % 2 == 1
    assert not inside and depth == 0
    batch = pa.record_batch([pa.array(list(c)) for c in zip(*told, strict=True)], ["path", "start", "end", "inside", "depth"])
    return [r["entry"] for b in json_scan._entries(iter([batch])) for r in b.to_pylist()]


ODD = [
    "{}", " {\n} ", '{"a":1}', '{"a": {"b": [1, {"c": "}]{[,"}]}, "d,\\"": "x\\\\", "\\\\\\"": ["\\\\\\\\", ","], "e": {}}\n',
    '{"k": "' + "\\\\" * 40 + '", "l": "' + '\\"' * 30 + '", "é€😀": ["ü,}"], "m": [[], [[1, 2]], {"n": {"o": "\\u0022,{"}}]}', '{ "a" : 1 , "a" : 2 ,"b":null}',
]


@pytest.mark.parametrize("text", ODD)
def test_every_split_place(text, tmp_path):
    want = [json.dumps(dict([p]), sort_keys=True) for p in json.loads(text, object_pairs_hook=list)]
    for size in range(1, len(text.encode()) + 2):
        got = [json.dumps(dict(json.loads(e, object_pairs_hook=list)), sort_keys=True) for e in entries_of(text, size, tmp_path)]
        assert got == want, size


def test_random_objects(tmp_path):
    r = random.Random(1)

    def value(d):
        k = r.random()
        if d == 0 or k < 0.4:
            return r.choice([1, None, True, -2.5, "".join(r.choice('a"\\{}[],: é') for _ in range(r.randint(0, 9)))])
        return [value(d - 1) for _ in range(r.randint(0, 3))] if k < 0.7 else {str(i) + r.choice('"\\,}'): value(d - 1) for i in range(r.randint(0, 3))}

    for _ in range(60):
        held = {str(i) + r.choice('"\\{,'): value(3) for i in range(r.randint(0, 6))}
        text = json.dumps(held, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        for size in (1, 2, 3, 7, 20, 1000):
            assert [json.loads(e) for e in entries_of(text, size, tmp_path)] == [{k: v} for k, v in held.items()]


def test_annotations_in_ranges_equal_whole_files(spark, tmp_path):
    r = np.random.default_rng(2)
    for part in range(3):
        held = {f"img-{part}-{i}": {"bboxes": r.random((int(r.integers(0, 4)), 4)).round(3).tolist(), "labels": None, "note": 'a "quoted}, {" \\ note'} for i in range(200)}
        for v in held.values():
            v["labels"] = [str(r.choice(["palm", "none"])) for _ in v["bboxes"]]
        (tmp_path / f"{part}.json").write_text(json.dumps(held, indent=part or None))
    want = readers.boxes_of_json(spark.read.text(f"{tmp_path}/*.json", wholetext=True), "value").collect()
    entries = json_scan.json_entries(spark, f"{tmp_path}/*.json", 1000)
    assert sorted(readers.boxes_of_json(entries, "entry").collect()) == sorted(want) == sorted(readers.box_annotations(spark, f"{tmp_path}/*.json").collect())
    assert entries.count() == 600 and entries.where(F.col("path").contains("0.json")).count() == 200
    assert entries.select(F.spark_partition_id()).distinct().count() > 1


def test_objects_are_written_and_read_back(spark, tmp_path):
    rows = [(i, json.dumps({"a": [i, 'x"}{,' * (i % 3)]})) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(4)
    sinks.save_json_objects(df.unionByName(df.limit(0)), "k", "v", f"{tmp_path}/out")
    for size in (50, 5000):
        got = json_scan.json_entries(spark, f"{tmp_path}/out/part-*", size).collect()
        assert sorted((int(k), json.dumps(v)) for r in got for k, v in json.loads(r.entry).items()) == sorted(rows)
