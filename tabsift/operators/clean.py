"""Conservative cleaning: white space, number format, unambiguous dates, exact duplicates."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.staged import with_dates, with_numbers
from ..plans.model import FIXERS, CleanOptions, Profile, Table
from ..sources.shared import materialize, spread
from ..sources.tables import renumber
from .cells import fenced
from .cells import profiles as column_profiles


@dataclass
class CleanResult:
    """The cleaned table; changes (row, column, column_name, before, after, fixer) and removals as frames, by their order."""

    table: Table
    changes: DataFrame
    removals: DataFrame
    summary: dict


def fix_whitespace(c: Column) -> Column:
    return F.when(~S.is_blank(c) & S.needs_whitespace_trim(c), S.normalize_whitespace(c)).otherwise(c)


def fix_number(c: Column) -> Column:
    return S.let(c, lambda x: F.coalesce(S.numeric_string(x), x))


def fix_date(c: Column, target: str) -> Column:
    return S.let(c, lambda x: F.coalesce(S.reformat_date(x, target), x))


def _kinds(profiles: list[Profile], types: tuple[str, ...]) -> Column:
    pairs = {p.index: p.type in types for p in profiles}
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items()))[F.col("col")] if pairs else F.lit(False)


def _iso(date: Column, options: CleanOptions) -> Column:
    return F.when(date["day"].isNotNull(), S.format_date(date, options.date_target))


def cell_changes(table: Table, profiles: list[Profile], options: CleanOptions) -> DataFrame:
    """(step, row, column, column_name, before, after, fixer) of every change, in log order by (step, place)."""
    if not table.headers:
        table = Table(["-"], table.df.select("rid", F.lit("").alias("c0")))
    long = spread(table.df).select("rid", F.posexplode(F.array(*table.columns)).alias("col", "raw"))
    numeric, date = _kinds(profiles, ("integer", "decimal")), _kinds(profiles, ("date",))
    long = long.withColumn("s0", fix_whitespace(F.col("raw")) if options.whitespace else F.col("raw"))
    long = long.withColumn("n_trimmed", F.when(numeric & F.lit(options.number_format), S.js_trim(F.col("s0"))))
    long = with_numbers(long, ["n"]).withColumn("s1", F.coalesce("n_num_s", "s0"))
    long = long.withColumn("d_trimmed", F.when(date & F.lit(options.date_format), S.js_trim(F.col("s1"))))
    long = with_dates(long, ["d"]).withColumn("s2", F.coalesce(_iso(F.col("d_date"), options), F.col("s1")))
    long = fenced(long.select("rid", "col", "raw", "s0", "s1", "s2"))
    change = lambda k, fixer, a, b: F.when(F.col(a) != F.col(b), F.struct(F.lit(k).alias("step"), F.col(a).alias("before"), F.col(b).alias("after"), F.lit(fixer).alias("fixer")))
    found = F.array_compact(F.array(change(0, FIXERS[0], "raw", "s0"), change(1, FIXERS[1], "s0", "s1"), change(2, FIXERS[2], "s1", "s2")))
    long = long.select("rid", "col", F.explode(found).alias("x"))
    names = F.array(*(F.lit(h) for h in table.headers))
    return long.select(F.col("x.step").alias("step"), F.col("rid").alias("row"), F.col("col").alias("column"), names[F.col("col")].alias("column_name"), "x.before", "x.after", "x.fixer")


def in_log_order(changes: DataFrame) -> DataFrame:
    """White space by row, then column; the other steps by column, then row."""
    return changes.orderBy("step", F.when(F.col("step") == 0, F.col("row")).otherwise(F.col("column")), F.when(F.col("step") == 0, F.col("column")).otherwise(F.col("row")))


def fixed_cells(table: Table, profiles: list[Profile], options: CleanOptions) -> DataFrame:
    """The table's frame after the first three steps: projections only."""
    df = spread(table.df)
    if options.whitespace:
        df = df.withColumns({c: fix_whitespace(F.col(c)) for c in table.columns})
    numeric = [f"c{p.index}" for p in profiles if p.type in ("integer", "decimal")] if options.number_format else []
    dates = [f"c{p.index}" for p in profiles if p.type == "date"] if options.date_format else []
    df = df.withColumns({f"{c}_trimmed": S.js_trim(F.col(c)) for c in [*numeric, *dates]}) if numeric or dates else df
    df = with_dates(with_numbers(df, numeric) if numeric else df, dates) if dates else with_numbers(df, numeric) if numeric else df
    fixed = {c: F.coalesce(f"{c}_num_s", c) for c in numeric} | {c: F.coalesce(_iso(F.col(f"{c}_date"), options), F.col(c)) for c in dates}
    return df.select("rid", *(fixed.get(c, F.col(c)).alias(c) for c in table.columns))


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row, kept_row) of every row that equals an earlier one, cell by cell and with case."""
    keyed = df.select("rid", F.sha2(F.to_json(F.array(*columns)) if columns else F.lit(""), 256).alias("key"))
    first = keyed.groupBy("key").agg(F.min("rid").alias("kept_row"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, "key").where("rid > kept_row").select(F.col("rid").alias("row"), "kept_row")


def clean_table(table: Table, options: CleanOptions | None = None) -> CleanResult:
    """Fix cells in the order of FIXERS by the profiles of the table as it was, then drop later duplicates."""
    options = options or CleanOptions()
    profiles = column_profiles(table)
    changes = materialize(cell_changes(table, profiles, options), "changes")
    df = materialize(fixed_cells(table, profiles, options), "fixed")
    removed = duplicate_rows(df, table.columns) if options.remove_duplicates else df.select(F.col("rid").alias("row"), F.col("rid").alias("kept_row")).where("false")
    removed = materialize(removed.select("row", "kept_row"), "removed")
    removals = removed.select("row", "kept_row", F.lit("exact duplicate").alias("reason"), F.lit("duplicate").alias("fixer"))
    kept = df.join(removed.select(F.col("row").alias("rid")), "rid", "left_anti")
    out = renumber(kept).select("rid", *table.columns)
    by = dict.fromkeys(FIXERS, 0) | {r.fixer: r.n for r in changes.groupBy("fixer").agg(F.count("*").alias("n")).collect()}
    by["duplicate"] = removed.count()
    summary = {"cells_changed": sum(by[f] for f in FIXERS[:3]), "rows_removed": by["duplicate"], "by_fixer": by}
    return CleanResult(Table(table.headers, out, table.meta), changes, removals, summary)
