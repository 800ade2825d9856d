"""Signatures as Column expressions.

The key becomes part of the plan (explain shows it), so it belongs to jobs whose plans only their owner sees.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The hex HMAC-SHA256 of a text's UTF-8 bytes (or of binary); null for null."""
    short = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    padded = short.ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


#: Fields and list items of a signed text are divided by characters that no field holds.
FIELD, ITEM, PART = "\x1f", "\x1e", "\x1d"


def field(value: Column) -> Column:
    """A field's text: null is told from empty, and the dividing characters are escaped."""
    escaped = F.regexp_replace(value.cast("string"), "([\x1b\x1d\x1e\x1f])", "\x1b$1x")
    return F.coalesce(escaped, F.lit("\x1b0"))


def signed_text(kind: str, *fields: Column) -> Column:
    """One text for a record: its kind and its fields."""
    return F.concat_ws(FIELD, F.lit(kind), *[field(f) for f in fields])
