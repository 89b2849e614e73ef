"""The long frame of cells, and column profiles in one grouped pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.staged import with_dates, with_numbers
from ..plans.model import TYPES, Profile, Table
from ..sources.shared import materialize, spread


def fenced(df: DataFrame) -> DataFrame:
    """The frame behind a generator of one row: filters on parsed columns stay above it, so the optimizer
    does not copy whole parsing expressions into them."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


#: What a cell can be asked for beside its text: whether its white space needs cleaning, its number, its date, its type.
NEEDS = ("ws", "num", "date", "type")


def cells(table: Table, *need: str, columns: list[int] | None = None) -> DataFrame:
    """(rid, col, raw, trimmed, blank, ...): the cells of all or some columns with what is needed of them (all, if
    nothing is named); the rest is not parsed."""
    need = need or NEEDS
    use = list(range(len(table.headers))) if columns is None else columns
    raw = F.array(*(F.struct(F.lit(i).alias("col"), F.col(f"c{i}").alias("raw")) for i in use)) if use else F.array(F.struct(F.lit(0).alias("col"), F.lit("").alias("raw")))
    df = (spread(table.df) if use else table.df.where("false")).select("rid", F.inline(raw))
    typed = "type" in need
    df = df.withColumn("x_trimmed", S.js_trim(F.col("raw"))).withColumn("blank", F.col("x_trimmed") == "")
    out = ["rid", "col", "raw", F.col("x_trimmed").alias("trimmed"), "blank"]
    if typed or "num" in need:
        df = with_numbers(df, ["x"])
        out += [F.col("x_num_s").alias("num_s"), F.col("x_num").alias("num")]
    if typed or "date" in need:
        df = with_dates(df, ["x"])
        out += [F.col("x_date").alias("date")]
    if typed:
        boolean = F.lower("x_trimmed").isin(*S.TRUE_TEXT, *S.FALSE_TEXT)
        out += [S.cell_type(F.col("blank"), F.col("x_num"), boolean, F.col("x_date").isNotNull()).alias("type")]
    if "ws" in need:
        out += [(~F.col("blank") & S.needs_whitespace_trim(F.col("raw"), F.col("x_trimmed"))).alias("ws")]
    return fenced(df.select(*out))


#: Ranges into which a column's numbers are dealt to find exact quantiles.
RANGES = 64


def quantiles(parsed: DataFrame, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(col, q): exact quantiles with linear interpolation between ranks, as an array.

    Approximate quantiles deal a column's numbers into RANGES ranges; exact counts of these tell which
    ranges hold the wanted ranks, and only their distinct numbers are sorted, range by range.
    """
    rows = parsed.where("num is not null").select("col", "num")
    splits = rows.groupBy("col").agg(F.count("*").alias("n"), F.percentile_approx("num", [i / RANGES for i in range(1, RANGES)], 1000).alias("splits"))
    splits = F.broadcast(splits)  # a row for each column of the table
    dealt = rows.join(splits, "col").select("col", "num", F.size(F.filter("splits", lambda s: s < F.col("num"))).alias("range"))
    counts = dealt.groupBy("col", "range").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("col").orderBy("range"))
    counts = counts.select("col", "range", "c", (upto - F.col("c")).alias("before"))  # RANGES rows for each column
    place = (F.col("n") - 1) * F.col("p")
    ranks = splits.select("col", "n", F.posexplode(F.array(*(F.lit(p) for p in probabilities))).alias("k", "p"))
    ranks = ranks.select("col", "k", F.explode(F.array(F.struct(F.floor(place).alias("rank"), (1 - (place - F.floor(place))).alias("w")), F.struct((F.floor(place) + 1).alias("rank"), (place - F.floor(place)).alias("w")))).alias("x")).select("col", "k", "x.*").where("w > 0")
    wanted = ranks.join(counts, "col").where("before <= rank and rank < before + c").select("col", "range", "k", "w", (F.col("rank") - F.col("before")).alias("inner"))
    values = dealt.join(F.broadcast(wanted.select("col", "range").distinct()), ["col", "range"], "left_semi").groupBy("col", "range", "num").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("col", "range").orderBy("num"))
    values = values.withColumn("last", upto)
    found = values.join(F.broadcast(wanted), ["col", "range"]).where("last - c <= inner and inner < last")
    each = found.groupBy("col", "k").agg(F.sum(F.col("num") * F.col("w")).alias("q"))
    return each.groupBy("col").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda s: s["q"]).alias("q"))


def profile_frame(parsed: DataFrame) -> DataFrame:
    """A row for each column: counts, distinct values, numeric statistics, date shapes by first row."""
    is_num = F.col("type").isin("integer", "decimal")
    n = F.when(is_num, F.col("num"))
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in (*TYPES, "empty")]
    out = parsed.groupBy("col").agg(
        F.count("*").alias("total"),
        *counts,
        F.count_distinct(F.when(~F.col("blank"), F.col("trimmed"))).alias("distinct"),
        F.count(n).alias("count"),
        F.min(n).alias("min"),
        F.max(n).alias("max"),
        F.avg(n).alias("mean"),
        F.sum(n).alias("sum"),
        F.when(F.count(n) < 2, 0.0).otherwise(F.stddev_samp(n)).alias("stdev"),
    )
    shapes = parsed.where("date is not null and not blank").groupBy("col", F.col("date.shape").alias("shape")).agg(F.min("rid").alias("rid"))
    order = shapes.groupBy("col").agg(F.transform(F.array_sort(F.collect_list(F.struct("rid", "shape"))), lambda s: s["shape"]).alias("shapes"))  # a row for each shape
    top = F.greatest(*(F.col(f"n_{t}") for t in TYPES))
    kind = F.when(F.col("total") == F.col("n_empty"), "empty")
    for t in TYPES:
        kind = kind.when(F.col(f"n_{t}") == top, t)
    out = out.join(order, "col", "left").join(quantiles(parsed.where(is_num)), "col", "left").withColumn("type", kind)
    return out.withColumn("confidence", F.when(F.col("type") != "empty", top / (F.col("total") - F.col("n_empty"))).otherwise(0.0))


def profiles(table: Table, parsed: DataFrame | None = None) -> list[Profile]:
    """The profiles of all columns in order; one row for each column reaches the driver."""
    parsed = materialize(cells(table, "type"), "cells") if parsed is None else parsed
    found = {r.col: r for r in profile_frame(parsed).collect()}
    out = []
    for i, name in enumerate(table.headers):
        r = found.get(i)
        if r is None:
            out.append(Profile(i, name, "empty", 0.0, 0, 0, 0, 0, dict.fromkeys((*TYPES, "empty"), 0)))
            continue
        numeric = None
        if r.type in ("integer", "decimal"):
            q1, median, q3 = r.q
            numeric = {"count": r["count"], "min": r.min, "max": r.max, "mean": r.mean, "stdev": r.stdev, "sum": r.sum, "q1": q1, "median": median, "q3": q3, "iqr": q3 - q1}
        out.append(Profile(i, name, r.type, r.confidence, r.total, r.n_empty, r.total - r.n_empty, r.distinct, {t: r[f"n_{t}"] for t in (*TYPES, "empty")}, numeric, list(r.shapes or []) if r.type == "date" else None))
    return out
