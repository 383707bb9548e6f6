"""Deterministic identities and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\x1f"


def observation_id(
    facility: Column, system: Column, epoch: Column, sequence: Column, tag: Column
) -> Column:
    """SHA-256 of the five identity parts; a null part counts as empty text."""
    parts = [facility, system, epoch, sequence.cast("string"), tag]
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def checksum(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def content_digest(content: Column) -> Column:
    return F.concat(F.lit("sha-256=:"), F.base64(F.unhex(F.sha2(content, 256))), F.lit(":"))
