"""Column functions that write values for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(v: Column, size: int, unit: str) -> Column:
    """``v / size`` with two decimals, rounded half up in whole numbers."""
    q = F.floor((v.cast("long") * 100 + size // 2) / size)
    return F.format_string(f"%d.%02d {unit}", F.floor(q / 100), q % 100)


def fmt_duration(ns: Column) -> Column:
    return (
        F.when(ns < 1_000, F.concat(ns.cast("long").cast("string"), F.lit(" ns")))
        .when(ns < 1_000_000, _two(ns, 10**3, "us"))
        .when(ns < 1_000_000_000, _two(ns, 10**6, "ms"))
        .otherwise(_two(ns, 10**9, "s"))
    )


def fmt_bytes(n: Column) -> Column:
    return (
        F.when(n < 1_000, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1_000_000, _two(n, 10**3, "KB"))
        .when(n < 1_000_000_000, _two(n, 10**6, "MB"))
        .otherwise(_two(n, 10**9, "GB"))
    )


def fmt_grouped(n: Column) -> Column:
    return F.regexp_replace(n.cast("long").cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", " ")


def fmt_time(ns: Column) -> Column:
    """``HH:MM:SS.mmm_uuu_nnn`` since the start."""
    n = ns.cast("long")
    part = lambda size, mod: (F.floor(n / size) % mod).cast("int")
    return F.format_string("%02d:%02d:%02d.%03d_%03d_%03d", part(3600 * 10**9, 1_000_000), part(60 * 10**9, 60), part(10**9, 60), part(10**6, 1000), part(1000, 1000), part(1, 1000))


def fmt_value(v: Column, unit: Column) -> Column:
    """By unit: ns as a duration, B as bytes, hexa in base 16, else the number and its unit."""
    return (
        F.when(unit == "ns", fmt_duration(v))
        .when(unit == "B", fmt_bytes(v))
        .when(unit == "hexa", F.concat(F.lit("0x"), F.hex(v.cast("long"))))
        .otherwise(F.concat_ws(" ", fmt_grouped(v), unit))
    )
