"""Queries of settings, limits, progress and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import accounts as ops
from ..sources.tables import day_text, table
from .registry import query


def events(spark, path):
    return table(spark, path, "events")


KINDS = ["boolean", "number", "select", "text", "secret", "order", "textarea"]
#: Values by kind, the good ones first; the last three numbers break the step, the bounds and the form.
GIVEN = {
    "boolean": ["true", "false", "yes", ""], "number": ["10", "25", "12", "105", "many"], "select": ["a", "c", "d", "a,b"], "text": ["x", " y ", "  ", ""],
    "secret": ["0123456789", " 01234567890 ", " 123456789 ", ""], "order": ["b", " c , a,", "a,b,a", "a,d", " , "], "textarea": ["line", "l m", " ", ""],
}
GOOD = {"boolean": 2, "number": 2, "select": 2, "text": 2, "secret": 2, "order": 2, "textarea": 2}
_given = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}[p // 7 % {len(v)} + 1]" for k, v in GIVEN.items()) + " END"
_good = "CASE kind " + " ".join(f"WHEN '{k}' THEN p // 7 % {len(v)} < {GOOD[k]}" for k, v in GIVEN.items()) + " END"


@query(
    "settings_effective",
    f"""WITH d AS (SELECT p_partkey AS p, 'k' || p_partkey AS key, {KINDS}[p_partkey % 7 + 1] AS kind, p_partkey % 11 > 0 AS stored FROM part)
    SELECT key, CASE WHEN stored AND {_good} THEN {_given} ELSE 'default' END AS value, stored AND NOT {_good} AS error FROM d""",
)
def settings_effective(spark, path):
    """Each part is a declared setting of one of seven kinds; most have a stored value, good or not."""
    p = F.col("p_partkey")
    place = F.floor(p / 7)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (p % 7 + 1).cast("int"))
    value = F.lit(None).cast("string")
    for k, v in GIVEN.items():
        value = F.when(kind == k, F.element_at(F.array(*map(F.lit, v)), (place % len(v) + 1).cast("int"))).otherwise(value)
    rows = table(spark, path, "part").select(F.concat(F.lit("k"), p.cast("string")).alias("key"), kind.alias("kind"), value.alias("value"), (p % 11 > 0).alias("stored"))
    number = lambda x: F.when(F.col("kind") == "number", F.lit(float(x)))
    definitions = rows.select(
        "key", "kind", F.lit("default").alias("default"), F.array(*map(F.lit, "abc")).alias("options"), number(10).alias("least"), number(100).alias("most"), number(15).alias("step")
    )
    return ops.settings(definitions, rows.where("stored").select("key", "value"))


@query(
    "rate_limits",
    """WITH e AS (SELECT event_id, user_id % 40 AS client, epoch(ts)::BIGINT AS sec FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)),
    c AS (SELECT event_id, count(*) OVER (PARTITION BY client ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS n,
      sec - max(sec) OVER (PARTITION BY client ORDER BY sec RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM e)
    SELECT event_id, n >= 8 OR coalesce(since < 600, false) AS limited FROM c""",
)
def rate_limits(spark, path):
    rows = events(spark, path).select("event_id", (F.col("user_id") % 40).alias("client"), "ts")
    return ops.rate_limited(rows, 86400, 8, 600).select("event_id", "limited")


@query(
    "daily_allowance",
    """SELECT user_id AS client, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used, greatest(3 - count(*), 0) AS remaining, count(*) >= 3 AS blocked FROM events WHERE event_type = 'view' GROUP BY 1, 2""",
)
def daily_allowance(spark, path):
    rows = events(spark, path).select(F.col("user_id").alias("client"), "ts", (F.col("event_type") == "view").alias("charged"))
    return ops.daily_allowance(rows, 3)


@query(
    "progress_percent",
    """WITH s AS (SELECT event_id, user_id AS job, event_type, CASE WHEN event_id % 10 = 0 THEN 0.15::DOUBLE ELSE least(greatest(value / 100, 0), 1) END AS s FROM events),
    b AS (SELECT event_id, job, round_even(CASE event_type WHEN 'signup' THEN 2 * s WHEN 'click' THEN 2 + 43 * s WHEN 'view' THEN 45 + 3 * s WHEN 'error' THEN 48 + 42 * s
      WHEN 'purchase' THEN 90 + 10 * s END, 0) AS own FROM s)
    SELECT event_id, max(own) OVER (PARTITION BY job ORDER BY event_id ROWS UNBOUNDED PRECEDING)::INT AS percent FROM b""",
)
def progress_percent(spark, path):
    kind, stage = F.col("event_type"), None
    for event, name in (("signup", "queued"), ("click", "extracting"), ("view", "chunking"), ("error", "embedding"), ("purchase", "indexing")):
        stage = F.when(kind == event, name) if stage is None else stage.when(kind == event, name)
    share = F.when(F.col("event_id") % 10 != 0, F.col("value") / 100)
    rows = events(spark, path).select("event_id", F.col("user_id").alias("job"), F.col("event_id").alias("seq"), stage.alias("stage"), share.alias("share"))
    return ops.progress(rows).select("event_id", "percent")


@query(
    "registry_eviction",
    """SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 864000 SECONDS QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5""",
)
def registry_eviction(spark, path):
    rows = events(spark, path).select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), "ts")
    return ops.evicted(rows, "2024-01-30 00:00:00", 864000, 5).select("id")


@query("retention", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= TIMESTAMP '2024-05-20' - INTERVAL 120 DAY")
def retention(spark, path):
    return ops.retained(events(spark, path), "ts", "2024-05-20 00:00:00").select("event_id", day_text("ts").alias("day"))


@query("recent_events_of_user", "SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 500")
def recent_events_of_user(spark, path):
    return events(spark, path).where("user_id = 7").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type")


@query("owner_removed", "SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS o_custkey FROM orders")
def owner_removed(spark, path):
    gone = table(spark, path, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return ops.without_user(table(spark, path, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query(
    "listing_keys",
    """SELECT o_orderkey, o_orderstatus || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS key FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1 AS n FROM orders)""",
)
def listing_keys(spark, path):
    return ops.unique_keys(table(spark, path, "orders"), "o_custkey", "o_orderstatus", "o_orderkey").select("o_orderkey", "key")


@query(
    "order_permutation",
    """SELECT n_nationkey AS id, 'missing' AS fault FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT r_regionkey + 100, 'unknown' FROM region""",
)
def order_permutation(spark, path):
    known = table(spark, path, "nation").select(F.col("n_nationkey").alias("id"))
    wanted = known.where("id % 6 <> 0").union(table(spark, path, "region").select((F.col("r_regionkey") + 100).alias("id")))
    return ops.permutation_faults(known, wanted)


@query(
    "identity_links",
    """SELECT c_custkey AS login_id, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 OR c_custkey % 2 = 0 THEN c_custkey WHEN c_custkey % 3 <> 0 THEN c_custkey END AS user_id,
      CASE WHEN c_custkey % 3 <> 0 THEN 'id' WHEN c_custkey % 2 = 0 THEN 'email' ELSE 'none' END AS how FROM customer""",
)
def identity_links(spark, path):
    k = F.col("c_custkey")
    users = table(spark, path, "customer").select(
        k.alias("user_id"), F.concat(F.lit("x"), k.cast("string")).alias("external_id"), F.when(k % 2 == 0, F.concat(F.lit("M"), k.cast("string"))).alias("email")
    )
    logins = table(spark, path, "customer").select(
        k.alias("login_id"), F.when(k % 3 != 0, F.concat(F.lit("x"), k.cast("string"))).alias("external_id"), F.concat(F.lit("m"), k.cast("string")).alias("email")
    )
    return ops.linked_identity(logins, users)


@query(
    "messages_rendered",
    """SELECT n_nationkey AS id, 'Dear ' || replace(n_name, '&', '&amp;') || CASE WHEN n_nationkey % 2 = 0 THEN ', region ' || n_regionkey ELSE '' END || '.' AS body FROM nation""",
)
def messages_rendered(spark, path):
    k = F.col("n_nationkey")
    region = F.when(k % 2 == 0, F.col("n_regionkey").cast("string"))
    body = text.template("Dear {{name}}{{#region}}, region {{region}}{{/region}}.", name=text.html_escaped("n_name"), region=region)
    return table(spark, path, "nation").select(k.alias("id"), body.alias("body"))


@query(
    "spam_and_bots",
    f"""WITH a AS (SELECT page_id, html, CASE WHEN page_id % 4 <> 3 THEN ['Mozilla/5.0 (', 'python-requests/2.', 'WhatsApp/2.'][page_id % 4 + 1] || regexp_extract(url, '//([^/?#]*)', 1) END AS agent FROM pages)
    SELECT page_id, (length(lower(html)) - length(replace(replace(lower(html), 'https://', 'https:/'), 'http://', 'http:/'))) > 5 AS many,
      agent IS NULL OR len(list_filter([{", ".join(repr(b) for b in text.BOTS)}], lambda b: contains(lower(agent), b))) > 0 AS bot FROM a""",
)
def spam_and_bots(spark, path):
    """Agents are made of fixed beginnings and the page's host; a fourth has none."""
    i = F.col("page_id")
    first = F.get(F.array(F.lit("Mozilla/5.0 ("), F.lit("python-requests/2."), F.lit("WhatsApp/2.")), (i % 4).cast("int"))
    agent = F.concat(first, F.regexp_extract("url", "//([^/?#]*)", 1))
    return table(spark, path, "pages").select("page_id", text.many_links("html").alias("many"), text.bot_agent(agent).alias("bot"))


@query("secrets_masked", "SELECT c_custkey, '••••' || right(c_name, 4) AS masked FROM customer")
def secrets_masked(spark, path):
    return table(spark, path, "customer").select("c_custkey", text.masked("c_name").alias("masked"))


@query(
    "users_page",
    """SELECT c_custkey, c_name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE contains(lower(c_name), '1') GROUP BY 1, 2
    ORDER BY orders DESC, c_custkey LIMIT 25""",
)
def users_page(spark, path):
    counts = table(spark, path, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    rows = table(spark, path, "customer").where(F.contains(F.lower("c_name"), F.lit("1"))).join(counts, "c_custkey", "left")
    return rows.select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders")).orderBy(F.desc("orders"), "c_custkey").limit(25)
