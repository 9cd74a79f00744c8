"""Settings, rate limits, allowances, progress and ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped

# Bands of progress in percent by stage, and the share of a band shown while nothing can be measured.
STAGES = {"queued": (0, 2), "extracting": (2, 45), "chunking": (45, 48), "embedding": (48, 90), "indexing": (90, 100), "done": (100, 100)}
UNMEASURED = 0.15


def settings(definitions: DataFrame, stored: DataFrame) -> DataFrame:
    """Declared settings (``key``, ``kind``, ``default`` and, where given, ``options``, ``least``, ``most``, ``step``) with stored values (``key``, ``value``) over them.

    Stored keys that are not declared are left out; a stored value of the wrong kind is an error
    and the default stays.
    """
    limits = {"options": "array<string>", "least": "double", "most": "double", "step": "double"}
    definitions = definitions.withColumns({c: F.lit(None).cast(kind) for c, kind in limits.items() if c not in definitions.columns})
    rows = definitions.join(stored, "key", "left")
    fits = valid(F.col("kind"), F.col("value"), *map(F.col, limits))
    return rows.select(
        "key", F.when(F.col("value").isNotNull() & fits, F.col("value")).otherwise(F.col("default")).alias("value"),
        (F.col("value").isNotNull() & ~fits).alias("error"),
    )


def valid(kind: Column, value: Column, options: Column, least: Column, most: Column, step: Column) -> Column:
    """Whether a value has its declared kind.

    boolean: true or false; number: finite, within its bounds and a whole number of steps (over 1)
    from the least; cron: five fields; select: one of the options; text and textarea: not blank;
    secret: ten characters; order: some of the options, each once; any other kind takes all.
    """
    number = F.when(stripped(value) == "", 0.0).otherwise(value.try_cast("double"))
    base = F.coalesce(least, F.lit(0.0))
    steps = (number - base) / step
    whole = ~F.coalesce(step > 1, F.lit(False)) | (F.abs(steps - F.floor(steps + 0.5)) <= 1e-6)
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    parts = F.filter(F.transform(F.split(value, ","), stripped), lambda p: p != "")
    known = F.coalesce(options, F.array().cast("array<string>"))
    test = (
        F.when(kind == "boolean", value.isin("true", "false"))
        .when(kind == "number", finite & ~F.coalesce(number < least, F.lit(False)) & ~F.coalesce(number > most, F.lit(False)) & whole)
        .when(kind == "cron", F.size(F.split(F.trim(value), r"\s+")) == 5)
        .when(kind == "select", F.array_contains(known, value))
        .when(kind.isin("text", "textarea"), stripped(value) != "")
        .when(kind == "secret", F.length(stripped(value)) >= 10)
        .when(kind == "order", (F.size(parts) > 0) & (F.size(F.array_except(parts, known)) == 0) & (F.size(F.array_distinct(parts)) == F.size(parts)))
        .otherwise(True)
    )
    return F.coalesce(test, F.lit(False))


def rate_limited(events: DataFrame, seconds: int, most: int, cooldown: int) -> DataFrame:
    """Events of a client that exceed ``most`` in the window before, or follow the last within the cooldown.

    An event enters the window in its own second and leaves it ``seconds`` later, so one running sum in time
    order gives what is inside.  A client's time is cut into spans as long as the look-back, each led by one row
    for the span before it, which bounds what one task sorts.  Events without a time count one another.
    """
    span = max(seconds, cooldown)
    rows = events.withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    at, none = F.col("at"), F.lit(None).cast("long")
    own, left = F.floor(at / span), F.floor((at + seconds) / span)
    event = F.struct(*events.columns)
    mark = lambda event, span, t, change, seen: F.struct(event.alias("event"), span.alias("span"), t.alias("t"), F.lit(change).alias("change"), seen.alias("seen"))
    marks = rows.select("client", F.explode(F.array(mark(event, own, at, 1, at), mark(F.lit(None), left, at + seconds, -1, none))).alias("m"))
    marks = marks.select("client", "m.*").where("event IS NOT NULL OR t IS NOT NULL")
    before = rows.where("at IS NOT NULL").groupBy("client", (own + 1).alias("span")).agg(F.count_if(left > own).cast("int").alias("change"), F.max("at").alias("seen"))
    marks = marks.unionByName(before.withColumn("t", F.col("span") * span - 1), allowMissingColumns=True)
    w = Window.partitionBy("client", "span").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    told = marks.select("event", "t", F.sum("change").over(w).alias("within"), F.max("seen").over(w).alias("last")).where("event IS NOT NULL")
    limited = F.coalesce(F.col("within") >= most, F.lit(most <= 0)) | F.coalesce(F.col("t") - F.col("last") < cooldown, F.lit(False))
    return told.select("event.*", limited.alias("limited"))


def daily_allowance(events: DataFrame, limit: int) -> DataFrame:
    """Used, limit and remaining per client and day; only events that were answered are charged."""
    used = events.where("charged").groupBy("client", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("used"))
    return used.withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0))).withColumn("blocked", F.col("used") >= limit)


def progress(stages: DataFrame) -> DataFrame:
    """Whole percent of each step (``job``, ``seq``, ``stage``, ``share``), in its stage's band and never falling.

    A step without a share lies ``UNMEASURED`` into its band; a late step of an earlier stage, and one of an
    unknown stage or ``failed``, keeps the percentage there was (null if there was none).
    """
    low = F.coalesce(*(F.when(F.col("stage") == s, F.lit(float(a))) for s, (a, _) in STAGES.items()))
    high = F.coalesce(*(F.when(F.col("stage") == s, F.lit(float(b))) for s, (_, b) in STAGES.items()))
    own = low + (high - low) * F.least(F.greatest(F.coalesce("share", F.lit(UNMEASURED)), F.lit(0.0)), F.lit(1.0))
    w = Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return stages.withColumn("percent", F.max(F.bround(own)).over(w).cast("int"))


def evicted(entries: DataFrame, as_of: str, ttl_s: int, most: int) -> DataFrame:
    """Entries that stay: no older than the time to live, and the newest ``most`` of each owner."""
    fresh = entries.where(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {ttl_s} SECONDS"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("ts"), F.desc("id")))
    return fresh.withColumn("n", place).where(F.col("n") <= most).drop("n")


def retained(rows: DataFrame, ts: str, as_of: str, days: int = 120) -> DataFrame:
    return rows.where(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def without_user(owned: DataFrame, gone: DataFrame, owner: str) -> DataFrame:
    """Rows with the owner set to null where the owner has gone."""
    marked = owned.join(gone.select(F.col(owner), F.lit(True).alias("__gone")), owner, "left")
    return marked.withColumn(owner, F.when(F.col("__gone").isNull(), F.col(owner))).drop("__gone")


def unique_keys(rows: DataFrame, by: str, kind: str, order: str) -> DataFrame:
    """Keys KIND, KIND_1, KIND_2 ... for repeated kinds of an owner."""
    n = F.row_number().over(Window.partitionBy(by, kind).orderBy(order)) - 1
    return rows.withColumn("key", F.when(n == 0, F.col(kind)).otherwise(F.concat_ws("_", F.col(kind), n.cast("string"))))


def permutation_faults(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids that a wanted order lacks or adds."""
    missing = known.join(wanted, "id", "left_anti").select("id", F.lit("missing").alias("fault"))
    return missing.unionByName(wanted.join(known, "id", "left_anti").select("id", F.lit("unknown").alias("fault")))


def linked_identity(logins: DataFrame, users: DataFrame) -> DataFrame:
    """Each login's user: by its external id, else by e-mail."""
    by_id = users.select(F.col("user_id").alias("u1"), "external_id")
    by_mail = users.select(F.col("user_id").alias("u2"), F.lower("email").alias("mail"))
    rows = logins.join(by_id, "external_id", "left").join(by_mail, F.lower("email") == F.col("mail"), "left")
    return rows.select("login_id", F.coalesce("u1", "u2").alias("user_id"), F.when(F.col("u1").isNotNull(), "id").when(F.col("u2").isNotNull(), "email").otherwise("none").alias("how"))
