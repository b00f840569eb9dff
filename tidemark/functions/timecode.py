"""Timecodes as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(timecode: Column) -> Column:
    """H:M:S, M:S or S, with decimals, in seconds."""
    return F.aggregate(F.split(timecode, ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))


def _parts(t: Column) -> tuple[Column, ...]:
    ms = F.bround(t * 1000).cast("long")
    return F.expr("0L") + F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000


def stamp(t: Column, mark: str = ".") -> Column:
    """HH:MM:SS and milliseconds after the mark."""
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", *(p.cast("long") for p in _parts(t)))


def srt(t: Column) -> Column:
    return stamp(t, ",")


def ass(t: Column) -> Column:
    """H:MM:SS and hundredths."""
    cs = F.bround(t * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360_000).cast("long"), (F.floor(cs / 6000) % 60).cast("long"), (F.floor(cs / 100) % 60).cast("long"), (cs % 100).cast("long"))


def short(t: Column) -> Column:
    """M:SS and hundredths."""
    cs = F.bround(t * 100).cast("long")
    return F.format_string("%d:%02d.%02d", F.floor(cs / 6000).cast("long"), (F.floor(cs / 100) % 60).cast("long"), (cs % 100).cast("long"))


def on_frame(t: Column, fps: int) -> Column:
    """The nearest frame's time; half-way goes to the even frame."""
    return F.bround(t * fps) / F.lit(float(fps))
