"""Partial dates, durations and relative dates, and the texts that stand for them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("year", "month", "week", "day", "hour", "minute", "second")


def format_date(year=None, month=None, day=None, hour=None, minute=None, second=None, compat: bool = False) -> str:
    """YYYY-MM-DD HH:MM:SS with question marks for what is missing; `compat` leaves out the colon before seconds."""
    two = lambda v: "??" if v is None else f"{v:02}"
    parts = []
    if any(v is not None for v in (year, month, day)):
        parts.append(f"{'????' if year is None else f'{year:04}'}-{two(month)}-{two(day)}")
    if any(v is not None for v in (hour, minute, second)):
        parts.append(f"{two(hour)}:{two(minute)}{'' if compat and second is not None else ':'}{two(second)}")
    return " ".join(parts)


def format_duration(**amounts: int | None) -> str:
    """2 years 1 day; units that are missing or 0 are left out."""
    found = [(u, amounts.get(u + "s")) for u in UNITS]
    return " ".join(f"{n} {u}{'' if n == 1 else 's'}" for u, n in found if n)


def format_relative(direction: str, **amounts: int | None) -> str:
    return f"{'+' if direction == 'future' else '-'} {format_duration(**amounts)}"


def date_column(year: Column, month: Column, day: Column) -> Column:
    """The date part as a column."""
    part = lambda c, n: F.coalesce(F.lpad(c.cast("string"), n, "0"), F.lit("?" * n))
    known = year.isNotNull() | month.isNotNull() | day.isNotNull()
    return F.when(known, F.concat_ws("-", part(year, 4), part(month, 2), part(day, 2))).otherwise(F.lit(""))


def tnm_string(parts: dict[str, Any]) -> str:
    """pT2 N1 M0 (…) of the parts of a tumour staging."""
    out = (parts.get("prefix") or "").lower()
    for letter in ("tumour", "node", "metastasis"):
        if parts.get(letter):
            out += f"{letter[0].upper()}{parts[letter]}"
            out += parts.get(letter + "_specification") or parts.get(letter + "_suffix") or ""
    out += f"R{parts['resection']}" if parts.get("resection") else ""
    return out + (f" ({parts['version']} {parts.get('version_year', '')})".replace(" )", ")") if parts.get("version") else "")
