"""Time-ordered identifiers."""

from __future__ import annotations

import os
import time
import uuid


def time_ordered_id() -> str:
    """A UUID of version 7: milliseconds since 1970, then random bits."""
    value = int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10), "big")
    value = value & ~(0xF << 76) | 7 << 76
    return str(uuid.UUID(int=value & ~(0x3 << 62) | 0x2 << 62))
