"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the DNS namespace of version 5 identifiers.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Version 5 identifier of a name under the DNS namespace, inside the JVM: SHA-1 with the version and variant digits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def point_id(revision: Column, language: Column, content_hash: Column, strategy_version: Column, ordinal: Column) -> Column:
    return uuid5(F.concat_ws("|", revision, language, content_hash, strategy_version, ordinal.cast("string")))


def passage_id(split: Column, language: Column, query_id: Column, position: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", split, language, query_id.cast("string"), position.cast("string")), 256), 1, 24)
