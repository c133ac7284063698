"""Identifiers that hang on content alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of names in the domain name system.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = DNS) -> Column:
    """The version 5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def content_code(prefix: str, family: Column, content: Column, number: Column, width: int = 6) -> Column:
    """PREFIX-FAMILY-HASH-NUMBER: the family's first letters, six digits of the content's hash, and a number of three digits or more."""
    letters = F.substring(F.regexp_replace(F.upper(F.coalesce(family, F.lit(""))), "[^A-Z]", ""), 1, width)
    family = F.when(letters == "", F.lit("GENERAL"[:width])).otherwise(letters)
    return F.concat_ws("-", F.lit(prefix), family, F.upper(F.substring(F.sha2(content, 256), 1, 6)), F.format_string("%03d", number))
