from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.streaming import resumable

ITEMS = "id long, text string"


def _write(spark, path, rows):
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(path)


def test_stop_and_start_again(spark, tmp_path):
    items, out = f"file://{tmp_path}/items", f"file://{tmp_path}/out"
    for n in range(4):
        _write(spark, items, [(n * 10 + i, f"t{n}") for i in range(5)])
    given = []

    def failing(d):
        if d.count() and len(given) == 1:
            raise RuntimeError("stopped in the second batch")
        return work(d)

    def work(d):
        given.extend(n for n in [d.count()] if n)
        return d.withColumn("n", F.length("text"))

    with pytest.raises(Exception, match="stopped in the second batch"):
        resumable.run(spark, items, ITEMS, failing, out, ["id"], 1)
    assert resumable.results(spark, out, spark.createDataFrame([], ITEMS + ", n int")).count() == 5
    got = resumable.run(spark, items, ITEMS, work, out, ["id"], 1)
    assert sorted(r["id"] for r in got.collect()) == [n * 10 + i for n in range(4) for i in range(5)]
    assert given == [5, 5, 5, 5]  # no item was worked on twice
    resumable.run(spark, items, ITEMS, work, out, ["id"], 1)
    assert given == [5, 5, 5, 5]


def test_known_keys_repeats_nulls_and_no_files(spark, tmp_path):
    items, out = f"file://{tmp_path}/items", f"file://{tmp_path}/out"
    (tmp_path / "items").mkdir()
    assert resumable.run(spark, items, ITEMS, lambda d: d, out, ["id"]).columns == ["id", "text"]
    _write(spark, items, [(1, "a"), (1, "a"), (None, "x"), (None, "x")])
    assert resumable.run(spark, items, ITEMS, lambda d: d, out, ["id"]).count() == 2
    _write(spark, items, [(1, "again"), (None, "again"), (2, "b")])
    got = resumable.run(spark, items, ITEMS, lambda d: d, out, ["id"])
    assert sorted((r["id"] or 0, r["text"]) for r in got.collect()) == [(0, "x"), (1, "a"), (2, "b")]


def test_half_written_batch_is_left_out_and_replaced(spark, tmp_path):
    items, out = f"file://{tmp_path}/items", f"file://{tmp_path}/out"
    _write(spark, items, [(1, "a")])
    spark.createDataFrame([(9, "left behind")], ITEMS).write.parquet(f"{out}/results/_batch=0")
    (tmp_path / "out/results/_batch=0/_SUCCESS").unlink()
    assert resumable.results(spark, out, spark.createDataFrame([], ITEMS)).count() == 0
    assert [r["id"] for r in resumable.run(spark, items, ITEMS, lambda d: d, out, ["id"]).collect()] == [1]
