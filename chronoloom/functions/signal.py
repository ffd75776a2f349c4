"""Scalar functions on samples, labels and header fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microvolts of one stored unit; old and new names of electrodes.
UNIT_UV = 0.72998046
ALIASES = {"T7": "T3", "T8": "T4", "P7": "T5", "P8": "T6"}


def scaled(units: Column) -> Column:
    return units * UNIT_UV


def quantised(x: Column, pmin: Column, pmax: Column, dmin: Column, dmax: Column) -> Column:
    """Digital value: nearest (half to even), held inside the digital range."""
    return F.least(F.greatest(F.rint((x - pmin) / (pmax - pmin) * (dmax - dmin) + dmin), dmin), dmax).cast("int")


def physical(d: Column, pmin: Column, pmax: Column, dmin: Column, dmax: Column) -> Column:
    return (d - dmin) * ((pmax - pmin) / (dmax - dmin)) + pmin


def rounded_range(largest: Column, least: float = 100.0) -> Column:
    """Two significant digits, rounded up, at least `least`: of the largest magnitude with 1 % of room."""
    room = F.greatest(largest * 1.01, F.lit(least))
    unit = F.pow(F.lit(10.0), F.floor(F.log10(room)) - 1)
    return F.ceil(room / unit) * unit


def electrode(label: Column) -> Column:
    """Upper case without prefixes, brackets and reference; old names for new ones."""
    name = F.regexp_replace(F.regexp_replace(F.upper(label), r"EEG|POL", ""), r"\([^)]*\)", "")
    name = F.trim(F.split_part(name, F.lit("-"), F.lit(1)))
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, name), name)


def number_or_text(value: Column) -> tuple[Column, Column]:
    """A value that is a whole number literal as a double, else as text."""
    is_number = value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(is_number, value.try_cast("double")), F.when(~is_number, value)


def channel_label(name: Column, reference: Column, amp: Column, override: Column) -> Column:
    """The user's label, or 'EEG name-reference', an input without a name being called by its number and one without a
    reference having the common one; at most 16 characters."""
    called = F.coalesce(name, F.concat(F.lit("ch"), amp.cast("string")))
    return F.substring(F.coalesce(override, F.concat(F.lit("EEG "), called, F.lit("-"), F.coalesce(reference, F.lit("Cz")))), 1, 16)


def header_field(text: Column, width: int) -> Column:
    """A fixed-width ASCII field of a header."""
    return F.rpad(F.regexp_replace(text, r"[^\x20-\x7E]", "?"), width, " ")


def anonymised(text: Column, kind: Column, free_text_kinds: list[str]) -> Column:
    return F.when(kind.isin(free_text_kinds), kind).otherwise(text)


def row_digest(*columns: str) -> Column:
    """32 bits of the digest of a row's text, as a number; nulls are told from texts. Summed up, it tells tables apart
    whatever the order of their rows."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
