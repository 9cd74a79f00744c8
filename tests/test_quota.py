"""Quota admission in batch and stream against an ordered fold."""

import datetime as dt
import random

import pytest

from bulletin.operators import quota
from bulletin.streaming import views

LIMITS = {"FREE": 3, "PRO": None, "NONE": 0}


def fold(events, tiers):
    used, out = {}, []
    for u, ts, i in sorted((e for e in events if e[0] is not None and e[1] is not None), key=lambda e: (e[1], e[2])):
        limit = LIMITS[tiers.get(u, "FREE")]
        n = used.get((u, ts.strftime("%Y-%m")), 0)
        yes = limit is None or n < limit
        used[u, ts.strftime("%Y-%m")] = n + yes
        out.append((i, limit, None if limit is None else n, yes))
    return sorted(out)


@pytest.fixture(scope="module")
def events():
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), dt.datetime(2024, rng.choice([1, 2, 12]), rng.randrange(1, 28), rng.randrange(3)), i) for i in range(200)]
    return [*rows, (1, None, 900), *[(9, dt.datetime(2024, 5, 1), 1000 + i) for i in range(6)]], {1: "PRO", 2: "NONE", 3: "FREE", 4: "FREE"}


def test_batch(spark, events):
    rows, tiers = events
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")
    plans = spark.createDataFrame(list(tiers.items()), "user_id long, tier string")
    got = sorted((r.event_id, r.limit, r.used, r.admitted) for r in quota.admitted(df, plans, LIMITS).collect())
    assert got == fold(rows, tiers)
    assert quota.admitted(df.limit(0), plans, LIMITS).count() == 0 and quota.admitted(df, plans.limit(0), {"FREE": None}).where("admitted").count() == len(got)


def test_stream_judges_each_event_as_it_comes(spark, events, tmp_path):
    rows, tiers = events
    known = sorted((e for e in rows if e[0] is not None and e[1] is not None), key=lambda e: (e[1], e[2]))
    for k in range(0, len(known), 50):  # four micro-batches in order of time
        part = [(u, ts, i, LIMITS[tiers.get(u, "FREE")]) for u, ts, i in known[k : k + 50]]
        spark.createDataFrame(part, "user_id long, ts timestamp, event_id long, limit long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = quota.admitted_stream(views.read(spark, str(tmp_path / "in"), files_per_batch=1))
    got = sorted((r.event_id, r.admitted) for r in views.appended(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect())
    assert got == [(i, yes) for i, _, _, yes in fold(rows, tiers)]
