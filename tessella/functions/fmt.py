"""Formatting functions of reports and traces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_bytes(n: Column) -> Column:
    """Two decimals (exact halves to even) and B, KB, MB or GB, by 1024."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    x = n.cast("double")
    return (
        F.when(x < kb, F.format_string("%.2f B", x)).when(x < mb, F.format_string("%.2f KB", F.bround(x / kb, 2))).when(x < gb, F.format_string("%.2f MB", F.bround(x / mb, 2))).otherwise(F.format_string("%.2f GB", F.bround(x / gb, 2)))
    )


def count_text(n: Column) -> Column:
    return n.cast("string")


def parse_count(text: Column) -> Column:
    """All digits of the text as one number."""
    return F.regexp_replace(text, "[^0-9]", "").cast("decimal(38,0)")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def short(text: Column, n: int = 25) -> Column:
    return F.substring(text, 1, n)


def fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x.cast("double")) if places else F.bround(x.cast("double"), 0).cast("decimal(38,0)").cast("string")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[@-~]", "")


def plain_quotes(text: Column) -> Column:
    return F.regexp_replace(text, '"', "'")


def wall_clock(start_micros: Column, elapsed_ns: Column) -> Column:
    """Start plus elapsed as HH:mm:ss.SSSSSS."""
    return F.date_format(F.timestamp_micros(start_micros + F.floor(elapsed_ns / 1000)), "HH:mm:ss.SSSSSS")


def time_band(seconds: Column) -> Column:
    return F.when(seconds < 0.1, "fast").when(seconds < 1.0, "medium").otherwise("slow")


def memory_band(bytes_per_vertex: Column) -> Column:
    return F.when(bytes_per_vertex < 1024, "small").when(bytes_per_vertex < 10240, "medium").otherwise("large")


def ratio(x: Column, y: Column, scale: float = 1.0) -> Column:
    """scale * x / y, 0 where y is 0."""
    return F.when(y != 0, x.cast("double") / y.cast("double") * scale).otherwise(0.0)


def status(ok: Column) -> Column:
    return F.when(ok, "MATCHED").otherwise("MISMATCHED")
