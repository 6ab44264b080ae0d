"""Durations in milliseconds, rounding, padding and progress estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

milliseconds = ms = lambda n=1: int(n)
seconds = s = lambda n=1: int(n * 1000)
minutes = m = lambda n=1: int(n * 60_000)
hours = h = lambda n=1: int(n * 3_600_000)
days = d = lambda n=1: int(n * 86_400_000)
weeks = w = lambda n=1: int(n * 604_800_000)
now = F.current_timestamp


def round_half_up(x: Column) -> Column:
    """Round halves toward plus infinity."""
    return F.floor(x + F.lit(0.5))


def pad_timestamp(ts: Column) -> Column:
    """Thirteen digits with leading zeros, so that text order is time order; longer numbers stay whole."""
    text = ts.cast("string")
    return F.when(F.length(text) < 13, F.lpad(text, 13, "0")).otherwise(text)


def progress(total: Column, n: Column, elapsed_ms: Column, count: Column) -> dict[str, Column]:
    """Rate and time left of a job: columns by name."""
    rate = elapsed_ms / count
    left = total - n
    left_ms = left * rate
    hr = F.floor(left_ms / 3_600_000)
    mins = F.floor(left_ms / 60_000 - hr * 60)
    secs = F.floor(left_ms / 1000 - F.floor(left_ms / 60_000 - hr * 60) * 60)
    text = F.when(hr != 0, F.concat(hr.cast("string"), F.lit("h "), F.lpad(mins.cast("string"), 2, "0"), F.lit("m")))
    text = text.when(mins != 0, F.concat(mins.cast("string"), F.lit("m "), F.lpad(secs.cast("string"), F.greatest(F.lit(2), F.length(secs.cast("string"))), "0"), F.lit("s")))
    return {"rate_ms": rate, "remaining_count": left, "remaining_ms": left_ms, "remaining_min": mins, "remaining_sec": secs, "remaining_fmt": text.otherwise(F.concat(secs.cast("string"), F.lit("s")))}
