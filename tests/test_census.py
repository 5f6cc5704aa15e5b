"""Censuses of files that a test writes: torn ends, damage inside, run folders and shards."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import census


@pytest.fixture
def folder(tmp_path):
    return tmp_path / "run"


def put(folder, name, text):
    file = folder / name
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(text if isinstance(text, bytes) else text.encode())
    return file


def counted(spark, folder):
    rows = census.census(spark, str(folder)).collect()
    return {r.file.rsplit("/", 1)[-1]: (r.rows, r.incomplete_final_line, r.malformed_complete_lines) for r in rows}


def test_torn_ends_and_damage_inside(spark, folder):
    put(folder, "torn.jsonl", '{"response":"A"}\n{"response":')
    put(folder, "whole.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    put(folder, "open.jsonl", '{"a": 1}\n{"a": 2}')
    put(folder, "inside.jsonl", '{"a": 1}\n{"a":\n{"a": 3}\n')
    put(folder, "last.jsonl", '{"a": 1}\nnot json\n')
    put(folder, "both.jsonl", '{"a":\r\n{"a": "é"}\r\n{"a')
    put(folder, "empty.jsonl", "")  # not listed
    put(folder, "blank.jsonl", "\n \n")
    assert counted(spark, folder) == {
        "torn.jsonl": (1, True, 0), "whole.jsonl": (2, False, 0), "open.jsonl": (2, False, 0), "inside.jsonl": (2, False, 1), "last.jsonl": (1, False, 1), "both.jsonl": (1, True, 1), "blank.jsonl": (0, False, 0),
    }
    one = census.census(spark, str(folder / "torn.jsonl"), F.timestamp_seconds(F.lit(4_000_000_000))).first()
    assert one.size == 29 and one.age_s > 1e9


def test_a_file_of_many_splits(spark, folder):
    lines = "".join(json.dumps({"i": i, "x": "y" * 50}) + "\n" for i in range(40_000))
    put(folder, "large.jsonl", lines + '{"i": 4')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        assert counted(spark, folder) == {"large.jsonl": (40_000, True, 0)}
        assert census.rows_so_far(spark, str(folder), "i long").agg(F.count("*"), F.sum("i")).first()[:] == (40_000, sum(range(40_000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_damage_inside_raises_and_a_torn_end_does_not(spark, folder):
    put(folder, "a.jsonl", '{"i": 1}\n{"i": 2}\n{"i"')
    assert sorted(r.i for r in census.rows_so_far(spark, str(folder), "i long").collect()) == [1, 2]
    put(folder, "b.jsonl", '{"i": 1}\n{"i"\n{"i": 3}\n')
    with pytest.raises(census.Damaged, match="b.jsonl: 1"):
        census.rows_so_far(spark, str(folder), "i long")


def test_units_and_issues(spark, folder):
    put(folder, "u1/results.jsonl", '{"a": 1}\n{"a":')
    put(folder, "u2/results.jsonl", '{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    put(folder, "u3/results.jsonl", '{"a"\n{"a": 2}\n')
    put(folder, "x/results.jsonl", '{"a": 2}\n')
    rows = census.census(spark, str(folder), F.timestamp_seconds(F.lit(4_000_000_000))).withColumn("unit", F.element_at(F.split("file", "/"), -2))
    expected = spark.createDataFrame([("u1", 4, "running"), ("u2", 2, "running"), ("u3", 4, "complete"), ("u4", 4, "running"), ("u5", 4, "failed")], "unit string, expected long, status string")
    got = census.units(rows, expected)
    assert {r.unit: (r.files, r.rows, r.incomplete, r.malformed, r.phase) for r in got.collect()} == {
        "u1": (1, 1, 1, 0, "running"), "u2": (1, 3, 0, 0, "running"), "u3": (1, 1, 0, 1, "complete"), "u4": (0, 0, 0, 0, "loading"), "u5": (0, 0, 0, 0, "failed"), "x": (1, 1, 0, 0, "unexpected"),
    }
    assert sorted((r.id, r.severity) for r in census.issues(got, 1800).collect()) == [
        ("excess rows:u2", "error"), ("failed:u5", "error"), ("malformed lines:u3", "error"), ("no recent activity:u1", "warning"), ("no recent activity:u2", "warning"), ("short:u3", "error"), ("unexpected:x", "warning"),
    ]
    assert census.issues(got.filter("unit IN ('u1', 'u4')"), 1e12).count() == 0  # a torn end and a start are no issue


def test_run_folders_and_shards(spark, folder):
    for shard, keys in enumerate(("ab", "cd", "da")):
        put(folder, f"exp1/shard_{shard}/results.jsonl", "".join(json.dumps({"k": k, "prompt": "p", "seed": 1 + (shard == 2)}) + "\n" for k in keys))
    put(folder, "exp1/shard_0/other.jsonl", '{"k": "z"}\n')
    rows = census.run_folders(spark, str(folder), "results.jsonl", "k string, prompt string, seed long", ["run", "shard"])
    assert sorted((r.run, r.shard, r.k) for r in rows.collect()) == [("exp1", f"shard_{s}", k) for s, keys in enumerate(("ab", "cd", "ad")) for k in keys]
    assert {r.fault: r.n for r in census.shard_faults(rows, "shard", ["k"], ["prompt", "seed"], 4).collect()} == {"keys in several shards": 2, "missing shards": 1, "values of seed": 1}
    assert census.shard_faults(rows.filter("shard = 'shard_0'"), "shard", ["k"], ["prompt", "seed"], 1).count() == 0
