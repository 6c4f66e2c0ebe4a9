"""Logs: assembly, formatting, filtering, paging and counts."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import on_workers
from .scan import running

KEYS = ["stream_id", "thread_id"]
_SPEC = re.compile(r"%([-+ #0]*)(\d+)?(?:\.(\d+))?(?:hh|h|ll|l|z|j|t|L)?([diouxXeEfFgGaAcspb%])")


def assemble_logs(df: DataFrame) -> DataFrame:
    """One row a log from header rows (``kind='log'``) and the parameter rows (``kind='log_param'``) that follow.

    ``is_last`` marks the closing row. Parameters without a header, and logs that never close, are dropped.
    """
    d = running(df.where(F.col("kind").isin("log", "log_param")), KEYS, {"_g": ("sum", F.when(F.col("kind") == "log", 1).otherwise(0))}).where("_g > 0")
    param = F.when(F.col("kind") == "log_param", F.struct("seq", F.col("value_type").alias("type"), F.col("v_long").alias("i"), F.col("v_double").alias("d"), F.col("v_string").alias("s")))
    g = d.groupBy(*KEYS, "_g").agg(
        F.min("seq").alias("seq"), F.min("date_ns").alias("date_ns"), *[F.first(F.when(F.col("kind") == "log", F.col(c)), True).alias(c) for c in ("category", "log_level", "format")],
        F.array_sort(F.collect_list(param)).alias("params"), F.max("is_last").alias("_closed"),
    )
    return g.where("_closed").drop("_g", "_closed")


def _integer(conv: str, v: object) -> int:
    return int(v) if conv in "diu" else int(v) & ((1 << 64) - 1)


def _hexadecimal(v: float, prec: str | None, upper: bool) -> str:
    """``%a`` as C writes it: the mantissa without trailing zeros unless a precision is given."""
    if v != v or v in (float("inf"), float("-inf")):
        text = str(v)
    else:
        sign, digits, exp = re.match(r"(-?)0x([01]\.[0-9a-f]+)p([+-]\d+)", v.hex()).groups()
        if prec is None:
            digits = digits.rstrip("0").rstrip(".")
        else:
            n = int(prec)
            head = round(int(digits.replace(".", ""), 16) / 16 ** (len(digits) - 2 - n)) if n < len(digits) - 2 else int(digits.replace(".", ""), 16) * 16 ** (n - len(digits) + 2)
            text = f"{head:0{n + 1}x}"
            digits = text[: len(text) - n] + ("." + text[len(text) - n :] if n else "")
        text = f"{sign}0x{digits}p{exp}"
    return text.upper() if upper else text


@lru_cache(maxsize=4096)
def compiled(fmt: str) -> tuple[tuple[str, tuple | None], ...]:
    """The pieces of a format: text before each specifier, and the specifier's flags, width, precision and conversion."""
    out, last = [], 0
    for m in _SPEC.finditer(fmt):
        out.append((fmt[last : m.start()], (m.group(0), *m.groups())))
        last = m.end()
    return (*out, (fmt[last:], None))


def printf(fmt: str, values: list) -> str:
    """C formatting of typed values; a specifier without a value or unknown stays as written."""
    left, out = iter(values), []
    for text, spec in compiled(fmt):
        out.append(text)
        if spec is not None:
            out.append("%" if spec[4] == "%" else _one(spec, next(left, None)))
    return "".join(out)


def _one(spec: tuple, v: object) -> str:
    whole, flags, width, prec, conv = spec
    if v is None:
        return whole
    side = "<" if "-" in flags else ">"
    try:
        if conv in "diuoxX":
            v, kind = _integer(conv, v), "d" if conv in "diu" else conv
        elif conv == "p":
            return format(f"0x{int(v):x}", f"{side}{width or 0}")
        elif conv == "b":
            return format(format(_integer(conv, v), "b"), f"{'0' if '0' in flags else ' '}>{width or 0}")
        elif conv in "aA":
            return format(_hexadecimal(float(v), prec, conv == "A"), f"{side}{width or 0}")
        elif conv == "c":
            v, kind = chr(int(v)) if not isinstance(v, str) else v[:1], "s"
        elif conv == "s":
            v, kind = str(v), "s"
        else:
            v, kind = float(v), conv
        return f"%{flags}{width or ''}{'.' + prec if prec is not None else ''}{kind}" % v
    except (TypeError, ValueError):
        return whole


def format_logs(logs: DataFrame, format_col: str = "format", params: tuple[str, ...] = ("p0", "p1")) -> DataFrame:
    """``logs`` with ``message``, by one Arrow function over batches; each distinct format is taken apart once a worker."""
    on_workers(logs.sparkSession)

    @F.pandas_udf("string")
    def run(fmt: pd.Series, *values: pd.Series) -> pd.Series:
        return pd.Series([printf(f, [None if x is None or x != x else x for x in v]) if f is not None else None for f, *v in zip(fmt, *values, strict=True)])

    return logs.withColumn("message", run(F.col(format_col), *[F.col(p) for p in params]))


def filter_logs(logs: DataFrame, min_level: int = 0, categories: list[str] | None = None, threads: list[int] | None = None, rng: tuple[int, int] | None = None) -> DataFrame:
    out = logs.where(F.col("log_level") >= min_level)
    if categories is not None:
        out = out.where(F.col("category").isin(categories))
    if threads is not None:
        out = out.where(F.col("thread_id").isin(threads))
    return out if rng is None else out.where(F.col("date_ns").between(*rng))


def log_page(logs: DataFrame, from_ns: int, n: int) -> DataFrame:
    return logs.where(F.col("date_ns") >= from_ns).orderBy("date_ns", "seq").limit(n)


def log_page_back(logs: DataFrame, from_ns: int, n: int) -> DataFrame:
    """The n entries before a date; the last row's date is where the previous page begins."""
    return logs.where(F.col("date_ns") < from_ns).orderBy(F.desc("date_ns"), F.desc("seq")).limit(n)


def log_param_series(logs: DataFrame, fmt: str, column: str) -> DataFrame:
    """Points of one parameter of a format: numbers in ``value``, and strings in ``text`` if the parameter is a string."""
    is_text = dict(logs.dtypes)[column] == "string"
    value = [F.lit(None).cast("double").alias("value"), F.col(column).alias("text")] if is_text else [F.col(column).cast("double").alias("value")]
    return logs.where(F.col("format") == fmt).select(*KEYS, F.col("date_ns").alias("time_ns"), "seq", *value)


def log_counts(logs: DataFrame) -> DataFrame:
    return logs.cube("category", "log_level").agg(F.count("*").alias("n"), F.count_distinct("thread_id").alias("threads"))
