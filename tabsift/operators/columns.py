"""Format and outlier checks of columns: all of them are flags of a cell, found in one scan.

The message templates are fixed values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.model import MAX_EXAMPLES, STRONG_CONFIDENCE, Issue, Outliers, Profile, Range, Table
from .issues import examples_of, gather, named

NUMERIC, STRONG = ("integer", "decimal"), ("integer", "decimal", "date", "boolean")


def _by_column(values: dict[int, object], kind: str) -> Column:
    """A column's own value (one for each column of the table, so a literal map)."""
    if not values:
        return F.lit(None).cast(kind)
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v).cast(kind)) for k, v in values.items()))[F.col("col")]


def bounds(p: Profile, options: Outliers) -> dict[str, float] | None:
    """What makes a number of this column an outlier; None if nothing can."""
    s = p.numeric
    if p.type not in NUMERIC or not s or s["count"] < 4 or (s["iqr"] <= 0 and s["stdev"] <= 0):
        return None
    by_iqr, by_z = s["iqr"] > 0, s["stdev"] > 0
    low, high = s["q1"] - options.iqr_multiplier * s["iqr"], s["q3"] + options.iqr_multiplier * s["iqr"]
    z = options.z_score_threshold * s["stdev"]
    return {"mean": s["mean"], "stdev": s["stdev"] if by_z else None, "low": low if by_iqr else None, "high": high if by_iqr else None, "lower": low if by_iqr else s["mean"] - z, "upper": high if by_iqr else s["mean"] + z}


def whitespace_hits(parsed: DataFrame) -> DataFrame:
    return parsed.where("ws").select("col", "rid", F.col("raw").alias("example"))


def date_hits(parsed: DataFrame) -> DataFrame:
    shown = F.struct(F.col("raw").alias("value"), F.col("date.shape").alias("shape"))
    return parsed.where("date is not null and not blank").select("col", "rid", shown.alias("example"), "raw", "date")


def date_summary(parsed: DataFrame) -> DataFrame:
    """For each column with dates: their number, the shapes by first row with counts, and the first row that forces either order."""
    hits = date_hits(parsed)
    late = ~F.coalesce(F.col("date.year_first"), F.lit(True))
    force = lambda f: F.min(F.when(late & F.col(f"date.{f}"), F.struct("rid", "raw")))
    shapes = hits.groupBy("col", F.col("date.shape").alias("shape")).agg(F.count("*").alias("n"), F.min("rid").alias("first"), force("forces_day_first").alias("day"), force("forces_month_first").alias("month"))
    return shapes.groupBy("col").agg(F.sum("n").alias("dates"), F.array_sort(F.collect_list(F.struct("first", "shape", "n"))).alias("shapes"), F.min("day").alias("day"), F.min("month").alias("month"))  # a row for each shape


def number_hits(parsed: DataFrame, columns: list[int]) -> DataFrame:
    """Cells of numeric columns, with the marks by which they differ."""
    rows = parsed.where(F.col("col").isin(*columns) & ~F.col("blank")) if columns else parsed.where("false")
    return rows.select("col", "rid", F.col("raw").alias("example"), S.has_currency_symbol(F.col("raw")).alias("currency"), S.has_grouping_separator(F.col("raw")).alias("grouping"))


def blank_hits(parsed: DataFrame) -> DataFrame:
    return parsed.where("blank").select("col", "rid", F.lit("").alias("example"))


def blank_summary(parsed: DataFrame) -> DataFrame:
    """For each column with blanks: all cells, the blank ones, and the first of these."""
    blank = F.col("blank")
    return parsed.groupBy("col").agg(F.count("*").alias("total"), F.count_if(blank).alias("blanks"), F.min(F.when(blank, F.col("rid"))).alias("first_row")).where("blanks > 0")


def mismatch_hits(parsed: DataFrame, profiles: list[Profile]) -> DataFrame:
    strong = {p.index: p.type for p in profiles if p.type in STRONG and p.type_confidence >= STRONG_CONFIDENCE}
    wanted = _by_column(strong, "string")
    rows = parsed.withColumn("wanted", wanted).where(F.col("wanted").isNotNull() & ~F.col("blank") & ~S.is_type_compatible(F.col("wanted"), F.col("type")))
    return rows.select("col", "rid", F.struct(F.col("raw").alias("value"), F.col("type").alias("found")).alias("example"))


def outlier_hits(parsed: DataFrame, profiles: list[Profile], options: Outliers) -> DataFrame:
    """Numbers outside a column's bounds, and by which method."""
    limit = {p.index: b for p in profiles if (b := bounds(p, options))}
    of = lambda k: _by_column({i: b[k] for i, b in limit.items() if b[k] is not None}, "double")
    n = F.col("num")
    rows = parsed.where(F.col("col").isin(*limit) & n.isNotNull()) if limit else parsed.where("false")
    by_iqr = F.coalesce((n < of("low")) | (n > of("high")), F.lit(False))
    by_z = F.coalesce(F.abs((n - of("mean")) / of("stdev")) > options.z_score_threshold, F.lit(False))
    return rows.select("col", "rid", n.alias("example"), by_iqr.alias("iqr"), by_z.alias("z")).where("iqr or z")


def range_hits(parsed: DataFrame, table: Table, rule: Range) -> DataFrame:
    """Numbers outside a range; a rule for an unknown column finds nothing."""
    n, outside = F.col("num"), F.lit(False)
    if rule.min is not None:
        outside = outside | (n < rule.min)
    if rule.max is not None:
        outside = outside | (n > rule.max)
    return parsed.where((F.col("col") == table.index(rule.column)) & n.isNotNull() & outside).select("col", "rid", n.alias("example"))


def _gathered(hits: DataFrame, rows: bool, extra: list | None = None) -> dict[int, object]:
    return {r.col: r for r in gather(hits, ["col"], rows, extra).collect()}  # a row for each column


def _rows(r: object) -> list[int] | None:
    return list(r.rows) if "rows" in r else None


def detect_format(parsed: DataFrame, profiles: list[Profile], rows: bool = False) -> list[Issue]:
    spaces = _gathered(whitespace_hits(parsed), rows)
    shapes = {r.col: r for r in date_summary(parsed).collect()}
    dates = _gathered(date_hits(parsed), rows) if any(len(r.shapes) > 1 for r in shapes.values()) else {}
    flags = [F.count_if("currency").alias("currency"), F.count_if("grouping").alias("grouping")]
    numbers = _gathered(number_hits(parsed, [p.index for p in profiles if p.type in NUMERIC]), rows, flags)
    out = []
    for p in profiles:
        place = {"column": p.index, "column_name": p.name}
        if r := spaces.get(p.index):
            out.append(Issue("format", "whitespace_format", "warning", f'Column "{p.name}" has {r.n} cell(s) with leading/trailing, doubled, or unusual whitespace/control characters that should be trimmed.', _rows(r), **place, data={"count": r.n, "examples": examples_of(r, "value")}, n=r.n))
        s = shapes.get(p.index)
        if s and s.dates >= 2:
            if len(s.shapes) >= 2:
                r, names = dates[p.index], [x["shape"] for x in s.shapes]
                out.append(Issue("format", "inconsistent_date_format", "warning", f'Column "{p.name}" mixes {len(names)} date formats ({", ".join(names)}); a single consistent format is recommended.', _rows(r), **place, data={"formats": names, "counts": {x["shape"]: x["n"] for x in s.shapes}, "examples": examples_of(r, "value", "shape")}, n=r.n))
            if s.day and s.month:
                out.append(Issue("format", "ambiguous_date_order", "error", f'Column "{p.name}" has conflicting day/month order: "{s.day.raw}" forces day-first while "{s.month.raw}" forces month-first.', [s.day.rid, s.month.rid], **place, data={"examples": [{"row": x.rid, "value": x.raw, "order": o} for x, o in ((s.day, "day-first"), (s.month, "month-first"))]}))
        if r := numbers.get(p.index):
            mixed = {"currency-symbol": 0 < r.currency < r.n, "thousands-separator": 0 < r.grouping < r.n}
            variants = [k for k, v in mixed.items() if v]
            if variants:
                out.append(Issue("format", "inconsistent_number_format", "info", f'Column "{p.name}" mixes number formatting ({", ".join(variants)}); values should use a uniform representation.', _rows(r), **place, data={"variants": variants, "withCurrency": r.currency, "withoutCurrency": r.n - r.currency, "withGrouping": r.grouping, "withoutGrouping": r.n - r.grouping, "examples": examples_of(r, "value")}, n=r.n))
    return out


def detect_outliers(table: Table, parsed: DataFrame, profiles: list[Profile], options: Outliers, rows: bool = False) -> list[Issue]:
    if not options.enabled:
        return []
    blanks = _gathered(blank_hits(parsed), rows) if options.flag_empty else {}
    odd = _gathered(mismatch_hits(parsed, profiles), rows) if options.flag_type_mismatch else {}
    far = _gathered(outlier_hits(parsed, profiles, options), rows, [F.bool_or("iqr").alias("iqr"), F.bool_or("z").alias("z")])
    out = []
    for p in profiles:
        place = {"column": p.index, "column_name": p.name}
        if r := blanks.get(p.index):
            if r.n == p.total_count:
                out.append(Issue("outlier", "empty_column", "info", f'Column "{p.name}" is entirely empty.', _rows(r), **place, data={"count": r.n}, n=r.n))
            else:
                out.append(Issue("outlier", "missing_value", "warning", f'Column "{p.name}" has {r.n} missing value(s).', _rows(r), **place, data={"count": r.n, "examples": [e.rid for e in r.examples][:MAX_EXAMPLES]}, n=r.n))
        if r := odd.get(p.index):
            out.append(Issue("outlier", "type_mismatch", "warning", f'Column "{p.name}" has {r.n} value(s) that do not match its {p.type} type.', _rows(r), **place, data={"expectedType": p.type, "examples": examples_of(r, "value", "found")}, n=r.n))
        if r := far.get(p.index):
            method = "both" if r.iqr and r.z else "iqr" if r.iqr else "zscore"
            b = bounds(p, options)
            out.append(Issue("outlier", "statistical_outlier", "info", f'Column "{p.name}" has {r.n} statistical outlier(s) ({method}).', _rows(r), **place, data={"method": method, "bounds": {"lower": named(b["lower"]), "upper": named(b["upper"])}, "examples": examples_of(r, "value")}, n=r.n))
    for rule in options.ranges:
        for i, r in _gathered(range_hits(parsed, table, rule), rows).items():
            out.append(Issue("outlier", "range_violation", "error", f'Column "{rule.column}" has {r.n} value(s) outside the allowed range.', _rows(r), i, rule.column, {k: named(v) for k, v in (("min", rule.min), ("max", rule.max)) if v is not None} | {"examples": examples_of(r, "value")}, n=r.n))
    return out
