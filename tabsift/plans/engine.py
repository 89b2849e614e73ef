"""Analysis and cleaning of whole tables."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..operators import cells as C
from ..operators.clean import CleanResult, clean_table
from ..operators.columns import detect_format, detect_outliers
from ..operators.duplicates import detect_duplicates
from ..operators.integrity import detect_integrity
from ..sources.shared import drop, materialize
from ..sources.tables import parse_csv
from .model import CATEGORIES, SEVERITIES, CleanOptions, Issue, Options, Report, Table


def summarize(issues: list[Issue]) -> dict:
    by_category, by_severity = Counter(i.category for i in issues), Counter(i.severity for i in issues)
    return {"total_issues": len(issues), "by_category": {c: by_category[c] for c in CATEGORIES}, "by_severity": {s: by_severity[s] for s in SEVERITIES}}


def analyze_table(table: Table, options: Options | None = None, rows: bool = False) -> Report:
    """Profile a table and run all detectors. Issues have counts and examples; with `rows` they also list all their
    rows on the driver, which is for small tables."""
    options = options or Options()
    parsed = materialize(C.cells(table), "cells")
    try:
        profiles = C.profiles(table, parsed)
        count = profiles[0].total_count if profiles and profiles[0].total_count else table.df.count()
        issues = detect_duplicates(table, options.duplicates, count, rows)
        if options.format:
            issues += detect_format(parsed, profiles, rows)
        issues += detect_outliers(table, parsed, profiles, options.outliers, rows)
        issues += detect_integrity(table, profiles, options.integrity, rows)
    finally:
        drop(parsed)
    return Report(count, list(table.headers), profiles, issues, summarize(issues))


def analyze_csv(spark: SparkSession, text: str, options: Options | None = None, rows: bool = True, **csv_options) -> Report:
    """A text is on the driver already, so its issues list their rows."""
    return analyze_table(parse_csv(spark, text, **csv_options), options, rows)


@dataclass
class CleanReport:
    before: Report
    clean: CleanResult
    after: Report


def clean_and_report(table: Table, clean: CleanOptions | None = None, engine: Options | None = None, rows: bool = False) -> CleanReport:
    """Analyse, clean, analyse again; the second analysis counts rows of the cleaned table."""
    before = analyze_table(table, engine, rows)
    cleaned = clean_table(table, clean)
    return CleanReport(before, cleaned, analyze_table(cleaned.table, engine, rows))
