"""Scans that go on after a failure."""

import pytest
from pyspark.sql import functions as F

from bulletin.sources.scans import finished_ranges, resumable_scan


def test_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(3, 60)] + [(None, "x")], "id long, text string")
    path, seen = str(tmp_path / "scan"), []

    def step(part, fail_at=None):
        first = part.agg(F.min("id")).first()[0]
        if first is not None:
            seen.append(first)
        if fail_at is not None and first == fail_at:
            raise RuntimeError("lost")
        return part.select("id", F.upper("text").alias("text"))

    with pytest.raises(RuntimeError):
        resumable_scan(rows, path, lambda p: step(p, 30), width=10)
    assert sorted(map(tuple, finished_ranges(spark, path).collect())) == [(0, 9), (10, 19), (20, 29)]
    got = sorted(map(tuple, resumable_scan(rows, path, step, width=10).collect()))
    assert got == [(i, f"T{i}") for i in range(3, 60)]
    again = len(seen)
    assert resumable_scan(rows, path, step, width=10).count() == 57 and not [x for x in seen[again:] if x > 3] and seen.count(10) == 1 and seen.count(40) == 1
    with pytest.raises(ValueError):
        resumable_scan(rows, path, step, width=7)


def test_skips_and_empty_tables(spark, tmp_path):
    rows = spark.range(40).select("id")
    got = sorted(r.id for r in resumable_scan(rows, str(tmp_path / "a"), lambda p: p, width=8, skip_to=19).collect())
    assert got == [*range(19, 40)]
    assert resumable_scan(rows.limit(0), str(tmp_path / "b"), lambda p: p).count() == 0
