"""Quotas: which of a user's events a monthly limit admits, in batch and in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["user_id", "month"]


def _month(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM")


def admitted(events: DataFrame, plans: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """``events`` (``user_id``, ``ts``, ``event_id``) with ``used``, ``limit`` and ``admitted``.

    An event is admitted while fewer than the limit were admitted before it in its user's calendar
    month (UTC), in order of time and id; only admitted events count, and ``used`` is their number
    before this one.  ``plans`` gives each user's ``tier``, without which the limit of ``FREE`` holds;
    a null limit is none (``used`` is null then).  Ids are unique; events without a user or time
    are left out.

    Of a month only the first ``limit`` events matter: they are found by a bounded top-k, of which
    tasks keep k a user before anything moves, and all events then meet their month's last one.
    """
    limit = F.lit(None).cast("long")
    for tier, n in limits.items():
        limit = F.when(F.coalesce("tier", F.lit("FREE")) == tier, F.lit(n).cast("long")).otherwise(limit)
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").join(plans.select("user_id", "tier"), "user_id", "left").withColumn("limit", limit).drop("tier").withColumn("month", _month())
    most = max([n for n in limits.values() if n is not None], default=0)
    at = F.struct("ts", "event_id")
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("ts", "event_id"))
    first = rows.where("limit IS NOT NULL").select(*KEYS, "ts", "event_id", "limit").withColumn("place", place).where(F.col("place") <= most).where("place <= limit")
    known = first.select(*KEYS, "event_id", (F.col("place") - 1).cast("long").alias("place"))
    full = first.groupBy(*KEYS).agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(full, KEYS, "left").join(known, [*KEYS, "event_id"], "left")
    inside = F.col("limit").isNull() | F.coalesce(at <= F.col("last"), F.lit(False))
    used = F.when(F.col("limit").isNotNull(), F.coalesce("place", "n", F.lit(0).cast("long")))
    return rows.withColumns({"admitted": inside, "used": used}).select(*events.columns, "limit", "used", "admitted")


def admitted_stream(events: DataFrame) -> DataFrame:
    """The same over a stream (``user_id``, ``ts``, ``event_id``, ``limit``): each event is judged once, as it comes.

    A user's state is the month of the newest event and how many were admitted in it.  Events of
    a micro-batch are taken in order of time and id; an event of a month gone by is denied.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        month, used = state.get if state.exists else ("", 0)
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        said = []
        for event, at, limit in zip(rows["event_id"], rows["ts"], rows["limit"]):
            now = at.strftime("%Y-%m")
            if now > month:
                month, used = now, 0
            yes = now == month and (pd.isna(limit) or used < limit)
            said.append((key[0], event, bool(yes)))
            used += bool(yes)
        state.update((month, used))
        yield pd.DataFrame(said, columns=["user_id", "event_id", "admitted"])

    out = "user_id long, event_id long, admitted boolean"
    return events.groupBy("user_id").applyInPandasWithState(judge, out, "month string, used long", "append", GroupStateTimeout.NoTimeout)
