"""Numbers and dates of whole columns, step by step.

Each step of parsing is a projection of its own, so that the engine generates code for it and
evaluates no expression twice. Columns are named by a prefix, so a frame may hold several cells a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalar as S


def _steps(df: DataFrame, prefixes: list[str], *steps: dict) -> DataFrame:
    """Add for each prefix the columns of each step; a step maps a name to a function of a lookup by name."""
    names = [n for step in steps for n in step]
    for step in steps:
        df = df.withColumns({f"{p}_{n}": make(lambda x, p=p: F.col(f"{p}_{x}")) for p in prefixes for n, make in step.items()})
    return df.drop(*(f"{p}_{n}" for p in prefixes for n in names if n.startswith("_")))


def with_numbers(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """From <prefix>_trimmed: <prefix>_num_s, the plain decimal string, and <prefix>_num."""
    return _steps(
        df,
        prefixes,
        {"_body": lambda c: S._unparenthesized(c("trimmed"))},
        {"_bare": lambda c: S._unsigned(c("_body"))},
        {"_point": lambda c: S._point(c("_bare"))},
        {"_full": lambda c: S._full(c("_point"))},
        {"num_s": lambda c: S._signed(c("trimmed"), c("_body"), c("_point"), c("_full"))},
        {"_number": lambda c: c("num_s").try_cast("double")},
        {"num": lambda c: S.finite(c("_number"))},
    )


def with_dates(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """From <prefix>_trimmed: <prefix>_date, the analysis of a date or null."""

    def number(i: int):
        return lambda c: S.date_numbers(c("_layout"), c("_1"), c("_2"), c("_3"))[i]

    def possible(i: int):
        return lambda c: S.possible(c("_layout"), c("_y"), c("_m"), c("_d"))[i]

    def part(i: int):
        return lambda c: S.date_part(c("_front"), c("_words"), c("_layout"), c("_sep"), i)

    def when(c) -> Column:
        return F.when(c("_layout").isNotNull(), S.date_analysis(c("_layout"), c("_sep"), c("_time") != "", c("_y"), c("_m"), c("_d"), c("_as_month"), c("_as_day")))

    return _steps(
        df,
        prefixes,
        {"_time": lambda c: S.time_front(c("trimmed"))},
        {"_front": lambda c: F.when(c("_time") != "", S.js_trim(c("_time"))).otherwise(c("trimmed"))},
        {"_kind": lambda c: S.date_kind(c("_front"))},
        {"_words": lambda c: S.date_words(c("_front"), c("_kind"))},
        {"_layout": lambda c: S.date_layout(c("_kind"), c("_words"))},
        {"_sep": lambda c: S.date_separator(c("_front"), c("_layout"))},
        {f"_{i}": part(i) for i in (1, 2, 3)},
        {f"_{n}": number(i) for i, n in enumerate("ymd")},
        {f"_as_{n}": possible(i) for i, n in enumerate(("month", "day"))},
        {"date": when},
    )
