"""Cells of contacts that arrive in batches."""

import random

import pytest
from pyspark.sql import functions as F

from contactspark.operators import matrix
from contactspark.plans import catalog
from contactspark.streaming import cells as stream

SIZE = 1000


def arriving(spark, seed, n=400):
    r = random.Random(seed)
    return spark.createDataFrame([(1, r.randrange(50_000), 1, 50_000, r.choice([1.0, -0.5])) for _ in range(n)], "chr1 int, pos1 int, chr2 int, pos2 int, score float")


def held(df):
    return sorted((r.bin1, r["count"], r.pos_count) for r in df.collect())


@pytest.mark.parametrize("share", [0.0, 0.25, 10.0])
def test_batches_add_up_and_repeats_change_nothing(spark, tmp_path, share):
    folder, every = f"{tmp_path}/stream", None
    for n in range(6):
        batch = arriving(spark, n, 400 if n else 4000)
        every = batch if every is None else every.unionByName(batch)
        for _ in range(2 if n in (0, 3) else 1):  # as after a failure
            stream.add(batch, n, folder, lambda df: df, SIZE, share)
        assert held(stream.current(spark, folder)) == held(matrix.cells(every, SIZE))
    stream.add(arriving(spark, 5), 5, folder, lambda df: df, SIZE, share)
    stream.merge(spark, folder)
    now = stream.current(spark, folder)
    assert held(now) == held(matrix.cells(every, SIZE))
    assert now.groupBy(*matrix.CELL).count().where(F.col("count") > 1).isEmpty() and len(now.inputFiles()) > 0
    assert "Exchange" not in now._jdf.queryExecution().executedPlan().toString()  # a row for each cell, no sum
    assert len(stream._numbered(spark, f"{folder}/cells", "version")) <= 2


def test_a_merge_that_broke_off_is_done_again(spark, tmp_path):
    folder = f"{tmp_path}/stream"
    for n in range(2):
        stream.add(arriving(spark, n), n, folder, lambda df: df, SIZE, 10.0)
    want = held(stream.current(spark, folder))
    (tmp_path / "stream" / "cells" / "version=1").mkdir(parents=True, exist_ok=True)  # begun, and not ended
    success = tmp_path / "stream" / "cells" / "version=1" / "_SUCCESS"
    success.unlink(missing_ok=True)
    assert held(stream.current(spark, folder)) == want
    stream.merge(spark, folder)
    assert success.exists() and held(stream.current(spark, folder)) == want


def test_files_are_followed(spark, tmp_path):
    arriving(spark, 1).repartition(5).write.parquet(f"{tmp_path}/in")
    out = stream.run_once(spark, f"{tmp_path}/in", "*.parquet", f"{tmp_path}/stream", lambda df: df, SIZE, files_together=2)
    assert held(out) == held(matrix.cells(arriving(spark, 1), SIZE))
    arriving(spark, 2).write.mode("append").parquet(f"{tmp_path}/in")
    out = stream.run_once(spark, f"{tmp_path}/in", "*.parquet", f"{tmp_path}/stream", lambda df: df, SIZE, files_together=2)
    assert held(out) == held(matrix.cells(arriving(spark, 1).unionByName(arriving(spark, 2)), SIZE))


def test_files_of_a_larger_table_are_more_and_arrive_in_three_batches(spark, monkeypatch):
    seen, run_once = [], stream.run_once

    def watched(spark_, path, *args, files_together):
        rows = [r["count"] for r in spark_.read.parquet(path).groupBy("_metadata.file_path").count().collect()]
        seen.append((max(rows), -(-len(rows) // files_together)))
        return run_once(spark_, path, *args, files_together=files_together)

    want = catalog.streaming_cells(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(stream, "run_once", watched)
    monkeypatch.setattr(catalog, "FILE_ROWS", 200, raising=False)  # of some 6000
    got = catalog.streaming_batches(spark, "/root/testdata/sf0.001").collect()
    assert seen[0][0] < 600 and seen[0][1] == 3
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
