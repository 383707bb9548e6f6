"""Opaque paging cursor: unpadded URL-safe Base64 of instant and id."""

from __future__ import annotations

import base64
import re
from datetime import datetime, timezone

from sensorloom.functions.identity import UNIT_SEPARATOR


def _instant_text(at: datetime) -> str:
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
    text = at.strftime("%Y-%m-%dT%H:%M:%S")
    if at.microsecond % 1000:
        text += f".{at.microsecond:06d}"
    elif at.microsecond:
        text += f".{at.microsecond // 1000:03d}"
    return text + "Z"


def encode_cursor(observed_at: datetime, observation_id: str) -> str:
    raw = _instant_text(observed_at) + UNIT_SEPARATOR + observation_id
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[datetime, str]:
    try:
        if not re.fullmatch(r"[A-Za-z0-9_-]+={0,2}", cursor):
            raise ValueError(cursor)
        body = cursor.rstrip("=")
        decoded = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)).decode()
        instant, observation_id = decoded.split(UNIT_SEPARATOR, 1)
        if not instant.endswith("Z"):
            raise ValueError(instant)
        return datetime.fromisoformat(instant[:-1]).replace(tzinfo=timezone.utc), observation_id
    except ValueError as error:
        raise ValueError("INVALID_CURSOR") from error
