"""Options, tables and reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

#: Fixed values of the rules.
MAX_EXAMPLES, NEAR_ROW_LIMIT, STRONG_CONFIDENCE = 50, 2000, 0.7
DEFAULT_TOLERANCE, DISCOVER_MAX_COLUMNS, DISCOVER_MIN_RATIO = 0.01, 12, 0.95
#: Issues of duplicate groups, and of near pairs, that a report without row lists holds; the frames behind them have all.
MAX_GROUPS = 1000
CATEGORIES, SEVERITIES = ("duplicate", "format", "outlier", "integrity"), ("error", "warning", "info")
TYPES = ("integer", "decimal", "date", "boolean", "string")
FIXERS = ("whitespace", "number_format", "date_format", "duplicate")


@dataclass
class Table:
    """Ordered headers, and a frame of `rid` (dense, from 0) and the string columns c0, c1, ..."""

    headers: list[str]
    df: DataFrame
    meta: dict[str, Any] = field(default_factory=dict)

    def index(self, name: str) -> int:
        """The first column of that name, or -1."""
        return self.headers.index(name) if name in self.headers else -1

    @property
    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.headers))]

    def rows(self) -> list[list[str]]:
        return [[r[c] for c in self.columns] for r in self.df.orderBy("rid").collect()]


@dataclass
class Near:
    enabled: bool = True
    threshold: float = 0.9
    key_columns: list[str] = field(default_factory=list)
    #: More rows than this are skipped; None compares any number.
    limit: int | None = NEAR_ROW_LIMIT


@dataclass
class Duplicates:
    enabled: bool = True
    case_insensitive: bool = True
    trim_whitespace: bool = True
    ignore_columns: list[str] = field(default_factory=list)
    near: Near = field(default_factory=Near)


@dataclass
class Range:
    column: str
    min: float | None = None
    max: float | None = None


@dataclass
class Outliers:
    enabled: bool = True
    z_score_threshold: float = 3
    iqr_multiplier: float = 1.5
    flag_empty: bool = True
    flag_type_mismatch: bool = True
    ranges: list[Range] = field(default_factory=list)


@dataclass
class SumCheck:
    components: list[str]
    total: str
    tolerance: float = DEFAULT_TOLERANCE
    label: str | None = None


@dataclass
class BalanceCheck:
    amount: str
    balance: str
    opening: float | None = None
    tolerance: float = DEFAULT_TOLERANCE
    label: str | None = None


@dataclass
class ReferentialCheck:
    """Values of a column must be in another column, in a list, or in the first column of a frame."""

    column: str
    references: str | list[str] | DataFrame
    allow_empty: bool = True
    label: str | None = None


@dataclass
class Integrity:
    enabled: bool = True
    sum_checks: list[SumCheck] = field(default_factory=list)
    balance_checks: list[BalanceCheck] = field(default_factory=list)
    referential_checks: list[ReferentialCheck] = field(default_factory=list)
    discover_sum_relationships: bool = False


@dataclass
class Options:
    duplicates: Duplicates = field(default_factory=Duplicates)
    format: bool = True
    outliers: Outliers = field(default_factory=Outliers)
    integrity: Integrity = field(default_factory=Integrity)


@dataclass
class CleanOptions:
    whitespace: bool = True
    number_format: bool = True
    date_format: bool = True
    date_target: str = "YYYY-MM-DD"
    remove_duplicates: bool = True


@dataclass
class Profile:
    index: int
    name: str
    type: str
    type_confidence: float
    total_count: int
    empty_count: int
    non_empty_count: int
    distinct_count: int
    type_counts: dict[str, int]
    numeric: dict[str, float] | None = None
    date_formats: list[str] | None = None


@dataclass
class Issue:
    category: str
    type: str
    severity: str
    message: str
    rows: list[int] | None = None
    column: int | None = None
    column_name: str | None = None
    data: dict[str, Any] = field(default_factory=dict)
    #: How many rows take part, where these are not listed.
    n: int | None = None

    @property
    def count(self) -> int:
        return len(self.rows) if self.rows is not None else self.n or 0


@dataclass
class Report:
    row_count: int
    headers: list[str]
    profiles: list[Profile]
    issues: list[Issue]
    summary: dict[str, Any]
