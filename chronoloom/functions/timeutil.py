"""Instants as 100-ns ticks since the epoch, zones, and microseconds of zone-free timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS = 10_000_000
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def ticks_of_text(text: Column) -> Column:
    """Ticks of 'YYYY-MM-DDThh:mm:ss.fffffff' (UTC); up to seven digits of a second count, none are needed."""
    whole = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.to_timestamp_ntz(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    part = F.rpad(F.regexp_extract(text, r"\.(\d{1,7})", 1), 7, "0")
    return whole * TICKS + part.cast("long")


def micros_of_ticks(ticks: Column) -> Column:
    """Truncated to microseconds, as timestamps hold them."""
    return F.floor(ticks / 10).cast("long")


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a zone-free timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def zone_name(zone: str | None) -> str:
    """A zone in the form that zone functions take: offsets from UTC as '+01:00', other names as they are."""
    text = (zone or "UTC").strip()
    offset = re.sub(r"^UTC(?=[+-])", "", text, flags=re.IGNORECASE)
    if offset.upper() in ("UTC", "Z"):
        return "UTC"
    return re.sub(r"^([+-])(\d{1,2}?):?(\d\d)$", lambda m: f"{m[1]}{int(m[2]):02}:{m[3]}", offset)


def local_start(origin: Column, correction_us: Column, lead_s: Column, zone: str) -> Column:
    """Local wall clock of a recording's first sample: origin, clock correction and what pads its front."""
    us = F.unix_micros(origin) + correction_us - (lead_s * 1_000_000).cast("long")
    return F.from_utc_timestamp(F.timestamp_micros(us), zone_name(zone))
