"""Streams of rows: running column counts, and reports of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import needs_whitespace_trim
from ..operators.cells import cells
from ..operators.issues import issue_rows
from ..plans.engine import analyze_table
from ..plans.model import TYPES, Options, Table
from ..sources.tables import from_dataframe, stringified


def running_counts(stream: DataFrame) -> DataFrame:
    """Counts of cell types and of cells to trim for each column of a stream; the state is a row for each column."""
    fields = stream.schema.fields
    rows = stream.select(F.lit(0).cast("bigint").alias("rid"), *(stringified(f).alias(f"c{i}") for i, f in enumerate(fields)))
    parsed = cells(Table([f.name for f in fields], rows))
    names = F.array(*(F.lit(f.name) for f in fields))
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in (*TYPES, "empty")]
    return parsed.groupBy("col", names[F.col("col")].alias("name")).agg(F.count("*").alias("total"), *counts, F.count_if(~F.col("blank") & needs_whitespace_trim(F.col("raw"))).alias("to_trim"))


def report_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], options: Options | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Analyse each micro-batch as a table; sink(issues, batch) gets its issues as a frame."""

    def each(batch: DataFrame, number: int) -> None:
        report = analyze_table(from_dataframe(batch), options, rows=False)
        sink(issue_rows(batch.sparkSession, report.issues), number)

    writer = stream.writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
