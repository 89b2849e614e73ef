"""Span columns: array<struct<kind,start,end,base>> by start, then by the order of kinds."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

Span = tuple[str, int, int, bool]
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def span_column(find: Callable[[str], list[Span]], text: Column) -> Column:
    """Spans of a text column in code points, ends exclusive; of a null none."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find(t.as_py())] if t.is_valid else [] for t in x], ARROW)

    return F.arrow_udf(run, SPANS)(text)


def span_rows(docs: DataFrame, find: Callable[[str], list[Span]], key: str, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).alias(key), span_column(find, F.col(text)).alias("spans"))


def digests(found: DataFrame, kinds: list[str], key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        key,
        *map(count, kinds),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
