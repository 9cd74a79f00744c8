"""WARC archives: distributed writing, and reading by boundary-chain verification.

A reader that cuts a file at the version line also cuts at copies of it inside payloads.  So the
tasks only emit candidates, each with the offset of its successor by its own Content-Length;
pointer jumping from the file's first byte keeps the candidates that the chain reaches, and the
fragments between them are joined back to the payload that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def header(name: str, value: Column) -> Column:
    """One header line; none where the value is null.  Line breaks in values become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\\r\\n]", " "), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int, date: str) -> DataFrame:
    """One WARC record per row, as text without its closing line breaks."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).select("*", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("digest"))
    shared = (
        rows.where(F.col("n") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("digest", "first_id")
    )
    rows = rows.join(shared, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    block = F.concat(
        F.lit(HTTP), F.col("n").cast("string"), F.lit(BREAK), F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    )
    return rows.select("*", revisit.alias("revisit"), block.alias("block")).select(
        F.concat(
            F.lit(MAGIC),
            header("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
            header("WARC-Record-ID", urn(F.col("page_id"))),
            header("WARC-Date", F.lit(date)),
            header("WARC-Target-URI", F.col("url")),
            header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            header("WARC-Refers-To", F.when(F.col("revisit"), urn(F.col("first_id")))),
            header("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
            F.octet_length("block").cast("string"),
            F.lit(BREAK),
            F.col("block"),
        ).alias("value")
    )


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = 100,
    date: str = "2024-01-01T00:00:00Z",
    compression: str = "gzip",
) -> None:
    """Write a record per row; equal payloads of ``least`` bytes or more are stored once.

    Of equal payloads the row with the smallest id is the response, the others revisit it;
    smaller payloads are all responses.  Null payloads are empty; a null URL has no header; a
    null id has no record id, and such a row never stands for others unless all ids of its group
    are null, which are then responses.  Rows that repeat the smallest id are responses too.
    Other columns are ignored; an empty table gives archives without records.
    """
    records(pages, id_col, url_col, payload_col, least, date).write.option("lineSep", BREAK).option(
        "compression", compression
    ).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece of the archives that follows a version line, with its offsets.

    Spark's text reader cuts at the version line.  Offsets are sums of the lengths before, within
    a split and over the splits of a file; ``next_off`` is the successor by Content-Length.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    declared = F.regexp_extract("head", r"(?im)^content-length:[ \t]*(\d+)[ \t\r]*$", 1)
    return (
        lines.withColumn("head", F.when(F.contains("value", F.lit(BREAK)), F.substring_index("value", BREAK, 1)))
        .withColumn("body_at", F.octet_length("head") + len(BREAK))
        .withColumn("content_length", declared.try_cast("int"))
        .withColumn("step", F.octet_length("value").cast("long") + len(MAGIC))
        .withColumn(
            "whole",
            F.coalesce(F.octet_length("value") >= F.col("body_at").cast("long") + F.col("content_length"), F.lit(False)),
        )
    )


def with_offsets(rows: DataFrame) -> DataFrame:
    """Add the offset of each piece's version line and that of its successor.

    The first piece of a file is what stands before the first version line; it has no line of
    its own, so its offset is minus the line's length.
    """
    splits = rows.groupBy("file", "split").agg(F.sum("step").alias("total"))
    before = F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "split", F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    off = F.col("before") + F.sum("step").over(inside) - F.col("step") - len(MAGIC)
    return (
        rows.join(splits, ["file", "split"])
        .withColumn("off", off)
        .withColumn("next_off", F.col("off") + len(MAGIC) + F.col("body_at") + F.col("content_length") + len(BREAK))
    )


def reachable(pointers: DataFrame) -> DataFrame:
    """(file, off) of the candidates that the chain from offset 0 of their file reaches.

    Pointer jumping: in each round every candidate passes its mark on to the one it points to,
    and then points to where that one points, so the marked part of the chain doubles.
    """
    state = stored(pointers.select("file", "off", "next_off", (F.col("off") == 0).alias("marked")), "warc-chain")
    while True:
        to = state.select("file", F.col("off").alias("next_off"), F.col("next_off").alias("beyond"))
        hop = state.join(to, ["file", "next_off"], "left")
        kept = hop.select("file", "off", F.when(F.col("beyond").isNotNull(), F.col("beyond")).alias("next_off"), "marked", F.lit(True).alias("own"))
        passed = hop.where("marked").select("file", F.col("next_off").alias("off"), F.lit(None).cast("long").alias("next_off"), "marked", F.lit(False).alias("own"))
        state = stored(
            kept.union(passed)
            .groupBy("file", "off")
            .agg(F.max("next_off").alias("next_off"), F.max("marked").alias("marked"), F.max("own").alias("own"))
            .where("own")
            .drop("own"),
            "warc-chain",
        )
        if state.where("marked AND next_off IS NOT NULL").isEmpty():
            return state.where("marked").select("file", "off")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under ``path``, by the verified chain.

    Columns: ``file``, ``off``, ``head`` (header lines), ``record_type``, ``record_id``,
    ``refers_to``, ``target_uri``, ``declared_digest``, ``payload_bytes`` and ``payload_sha256``
    of the full payload (of a revisit as its headers state it), and ``payload`` (binary, null for
    revisits) if asked for.  A record that the file's end cuts short is left out.
    """
    rows = candidates(spark, path)
    meta = stored(
        with_offsets(rows.select("file", "split", "row", "step", "body_at", "content_length", "whole")).select(
            "file", "split", "row", "off", "next_off", "whole", "content_length"
        ),
        "warc-candidates",
    )
    reached = reachable(meta.where("content_length IS NOT NULL").select("file", "off", "next_off"))
    marks = meta.join(reached.withColumn("reached", F.lit(True)), ["file", "off"], "left")
    keys = ["file", "split", "row"]
    body = F.substring(F.col("value").cast("binary"), F.col("body_at") + 1, F.col("content_length"))
    ready = marks.where("reached AND whole").select(*keys, "off")
    whole = parsed(rows.where("whole").select(*keys, "head", body.alias("body")), keys, payloads).join(ready, keys).drop(*keys[1:])
    # Pieces of records that a copy of the version line has cut: each belongs to the last record before it.
    # Within a split that is a running maximum; what a split's first pieces belong to comes from the splits before it.
    held = F.max(F.when(F.col("reached"), F.col("off")))
    inside = Window.partitionBy("file", "split").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.groupBy("file", "split").agg(held.alias("last")).select("file", "split", F.max("last").over(earlier).alias("carried"))
    owner = F.coalesce(held.over(inside), F.col("carried"))
    broken = marks.where("off >= 0").join(carried, ["file", "split"]).select("file", "off", *keys[1:], "whole", "reached", owner.alias("owner"))
    heads = broken.where("reached AND NOT whole").select("file", "owner")
    parts = rows.select(*keys, "head", "body_at", "content_length", "value").join(
        stored(broken.join(heads, ["file", "owner"], "left_semi").select(*keys, "off", "owner"), "warc-broken"), keys
    )
    pieces = F.sort_array(F.collect_list(F.struct("off", F.hex(F.col("value").cast("binary")).alias("piece"))))
    first = F.max(F.when(F.col("off") == F.col("owner"), F.struct("head", "body_at", "content_length")))
    cut = (
        parts.groupBy("file", "owner")
        .agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), MAGIC.encode().hex()).alias("hex"), first.alias("h"))
        .select("file", F.col("owner").alias("off"), "h.*", "hex")
        .withColumn("body", F.substring(F.unhex("hex"), F.col("body_at") + 1, F.col("content_length")))
        .where(F.octet_length("body") == F.col("content_length"))
    )
    return whole.unionByName(parsed(cut.select("file", "off", "head", "body"), ["file", "off"], payloads))


def parsed(records: DataFrame, keys: list[str], payloads: bool) -> DataFrame:
    """The columns that a record's header lines and block give."""

    def value(name: str) -> Column:
        found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)
        return F.when(found != "", found)

    split = (
        records.withColumn("http", F.substring_index(F.col("body").cast("string"), BREAK, 1))
        .withColumn("payload", F.expr(f"substring(body, octet_length(http) + {len(BREAK) + 1})"))
        .withColumn("record_type", value("WARC-Type"))
        .withColumn("declared_digest", F.regexp_replace(value("WARC-Payload-Digest"), "^sha256:", ""))
    )
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    length = F.regexp_extract("http", r"(?im)^content-length:[ \t]*(\d+)", 1).try_cast("long")
    columns = [
        *keys, "head", "record_type", value("WARC-Record-ID").alias("record_id"), value("WARC-Refers-To").alias("refers_to"),
        value("WARC-Target-URI").alias("target_uri"), "declared_digest",
        F.when(revisit, length).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.sha2("payload", 256)).alias("payload_sha256"),
    ]
    return split.select(*columns, *([F.when(~revisit, F.col("payload")).alias("payload")] if payloads else []))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_warc(spark, path, payloads=False).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.col("payload_sha256").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
t AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM t
"""
