"""Deterministic identifiers as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of point ids; a parameter of `point_id`, since an index that exists already has its own.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "points.lexweave")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """RFC 4122 version 5 UUID of a name, as the standard library makes it; null stays null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def point_id(key: Column, index: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The id of a piece of a document: stable over runs, so writing it again replaces it."""
    return uuid5(F.concat(key, F.lit("#"), index.cast("string")), namespace)
