"""Deterministic identities: pure hash expressions, no Python in the plan.

Null parts count as empty text, so an identity is never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits of base 32 as ``conv`` writes them, and RFC 4648 in lower case.
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "abcdefghijklmnopqrstuvwxyz234567"

SATELLITE_PREFIX = "carryover:satellite:v1"


def content_hash(content: Column) -> Column:
    """``sha256:`` and the hex digest of text or binary."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def base32_of_hex(digest: Column, hex_chars: int) -> Column:
    """Lower-case base 32 of the first ``hex_chars`` (a multiple of 5): 5 hex digits are 4 letters."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + k, 5), 16, 32), 4, "0") for k in range(0, hex_chars, 5)]
    return F.translate(F.concat(*parts), _CONV_DIGITS, _BASE32)


def _joined(*parts: Column) -> Column:
    nul = F.unhex(F.lit("00"))
    out = []
    for p in parts:
        out += [nul, F.encode(F.coalesce(p, F.lit("")), "UTF-8")]
    return F.concat(*out[1:])


def canonical_id(system: Column, satellite: Column, record_id: Column) -> Column:
    """32 letters from the first 20 bytes of SHA-256 over the parts, separated by NUL."""
    return base32_of_hex(F.sha2(_joined(system, satellite, record_id), 256), 40)


def satellite_id(path: Column, prefix: str = SATELLITE_PREFIX) -> Column:
    """8 letters from the first 5 bytes; ``prefix`` keeps these apart from record identities."""
    return base32_of_hex(F.sha2(_joined(F.lit(prefix), path), 256), 10)


def valid_record_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[a-z2-7]{32}\z"), F.lit(False))


def valid_satellite_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[a-z2-7]{8}\z"), F.lit(False))


def owner_hash(system: Column, qualifier: Column, prefix: str = "carryover:") -> Column:
    """Owner of a record: the system and its scope qualifier, or ``user``."""
    return F.concat(F.lit(prefix), content_hash(_joined(system, F.coalesce(qualifier, F.lit("user")))))


def cluster_id(domain: str, record_id: Column, *hashes: Column) -> Column:
    """Identity of a conflict: the parts follow each other without separators."""
    return content_hash(F.concat(F.lit(domain), *(F.coalesce(x, F.lit("")) for x in (record_id, *hashes))))
