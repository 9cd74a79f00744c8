"""Rate limits against brute force, and of a busy client."""

import datetime as dt
import random

from pyspark.sql import functions as F

from bulletin.operators import accounts


def test_rate_limits_equal_brute_force(spark):
    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    events = [(i, rng.choice([1, 2, 2, None]), start + dt.timedelta(seconds=rng.randrange(900)) if i % 40 else None) for i in range(500)]
    df = spark.createDataFrame(events, "event_id int, client int, ts timestamp_ntz")
    for seconds, most, cooldown in ((100, 12, 1), (30, 3, 5), (10, 4, 40)):
        want = {}
        for i, c, t in events:
            if t is None:
                want[i] = sum(x == c and u is None for _, x, u in events) >= most
                continue
            before = [(t - u).total_seconds() for _, x, u in events if x == c and u is not None and u < t]
            want[i] = sum(b <= seconds for b in before) >= most or any(b < cooldown for b in before)
        got = accounts.rate_limited(df, seconds, most, cooldown)
        assert got.columns == ["event_id", "client", "ts", "limited"]
        assert {r.event_id: r.limited for r in got.collect()} == want and len(set(want.values())) == 2


def test_rate_limits_of_a_busy_client(spark):
    """400,000 events of one client in one window: a count over each frame anew would be 80 billion steps."""
    rows = spark.range(400_000).select(F.col("id").alias("event_id"), F.lit(1).alias("client"), F.timestamp_seconds(F.col("id") / 8 + 1_700_000_000).cast("timestamp_ntz").alias("ts"))
    start = dt.datetime.now()
    assert accounts.rate_limited(rows, 86_400, 8, 0).where("NOT limited").count() == 8
    assert (dt.datetime.now() - start).total_seconds() < 60
