"""Identity: canonical JSON, digests and name-based ids as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(*fields: tuple[str, Column]) -> Column:
    """JSON of one object with sorted keys and no spaces; integral doubles are written without a fraction part."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])]), {"ignoreNullFields": "false"})


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def uuid5(namespace: str, name: Column) -> Column:
    """The version-5 id of a name in a namespace: SHA-1 of the namespace's bytes and the name, with version and variant."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    part = lambda at, n: F.substr(h, F.lit(at), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
