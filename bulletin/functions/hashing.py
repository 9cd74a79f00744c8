"""Content hashes and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(title: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(content, F.lit(""))), 256)


def salted(salt: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), *parts), 256)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 UUID of a name: SHA-1 of namespace and name with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )
