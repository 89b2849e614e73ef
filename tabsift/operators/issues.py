"""Issue frames: how detectors say what they found.

A hit is a row that takes part in an issue: (key, rid, example), where key orders issues and names
them. Hits stay a frame; `gather` turns them into one row for each issue with the count, the first
examples by rid, and, only where asked for, all rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import MAX_EXAMPLES, Issue


def gather(hits: DataFrame, by: list[str], rows: bool = False, extra: list | None = None) -> DataFrame:
    """For each key: n, examples (the first MAX_EXAMPLES structs by rid), all rows if asked, and extra aggregates."""
    order = Window.partitionBy(*by).orderBy("rid")
    first = hits.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= MAX_EXAMPLES)
    examples = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rid", "example"))), lambda s: s).alias("examples"))
    total = hits.groupBy(*by).agg(F.count("*").alias("n"), *([F.array_sort(F.collect_list("rid")).alias("rows")] if rows else []), *(extra or []))
    return total.join(examples, by)


def named(number: Any) -> Any:
    """A float as JavaScript would print it in JSON: integral values without a point."""
    return int(number) if isinstance(number, float) and number.is_integer() else number


def examples_of(row: Any, *names: str) -> list[dict]:
    out = []
    for e in row.examples:
        values = e.example if isinstance(e.example, (list, tuple)) else [e.example]
        out.append({"row": e.rid} | dict(zip(names, map(named, values), strict=True)))
    return out


def issue_rows(spark, issues: list[Issue]) -> DataFrame:
    """Issues as a frame, in order."""
    data = [(i, x.category, x.type, x.severity, x.message, x.count, x.rows, x.column, x.column_name, json.dumps(x.data, ensure_ascii=False)) for i, x in enumerate(issues)]
    return spark.createDataFrame(data, "seq int, category string, type string, severity string, message string, n long, rows array<long>, column int, column_name string, data string")


Detector = Callable[..., list[Issue]]
