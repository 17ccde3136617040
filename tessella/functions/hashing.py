"""Hashes, encodings and masks as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def sha512(c: Column) -> Column:
    return F.sha2(c, 512)


def cache_key(prefix: str, namespace: str, raw: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:{namespace}:"), F.left(F.sha2(raw, 256), F.lit(32)))


def hmac_sha256(c: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 by its definition, on the JVM."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    lit = lambda b: F.unhex(F.lit(b.hex()))
    first = F.unhex(F.sha2(F.concat(lit(inner), c.cast("binary")), 256))
    return F.sha2(F.concat(lit(outer), first), 256)


def b64_encode(c: Column) -> Column:
    """Base64 of a string's UTF-8 bytes on one line."""
    return F.translate(F.base64(F.encode(c, "UTF-8")), "\r\n", "")


def b64_decode(c: Column) -> Column:
    return F.decode(F.unbase64(c), "UTF-8")


def mask_key(c: Column, visible: int = 4) -> Column:
    n = F.length(c)
    return F.when(n <= visible + 3, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(c, F.lit(3)), F.lit("..."), F.right(c, F.lit(visible))))


def mask_email(c: Column) -> Column:
    """First and last character of a local part of three or more, else its first, with stars."""
    local, host = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    masked = F.when(F.length(local) <= 2, F.concat(F.left(local, F.lit(1)), F.lit("***"))).otherwise(F.concat(F.left(local, F.lit(1)), F.lit("***"), F.right(local, F.lit(1))))
    return F.when(~c.contains("@"), c).otherwise(F.concat(masked, F.lit("@"), host))


def hash_url(c: Column) -> Column:
    """SHA-256 of a URL without surrounding blanks and trailing slashes."""
    return F.sha2(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "/+$", ""), 256)


def hmac_verify(c: Column, signature: Column, key: bytes) -> Column:
    """Whether ``signature`` is the hex HMAC-SHA256 of ``c``; a null one is not."""
    return F.coalesce(hmac_sha256(c, key) == signature, F.lit(False))
