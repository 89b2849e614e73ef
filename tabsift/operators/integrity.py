"""Sums, running balances, references, and sums that hold without a rule."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.staged import with_numbers
from ..plans.model import DEFAULT_TOLERANCE, DISCOVER_MAX_COLUMNS, DISCOVER_MIN_RATIO, BalanceCheck, Integrity, Issue, Profile, ReferentialCheck, SumCheck, Table
from ..sources.shared import materialize, spread
from .cells import fenced
from .issues import examples_of, gather, named

#: Rows whose running balance one task follows; a longer table goes on from chunk to chunk.
CHUNK = 1 << 20


def numbers(table: Table, columns: list[int]) -> DataFrame:
    """(rid, b<i>, n<i>): whether a cell is blank, and its number."""
    columns = list(dict.fromkeys(columns))
    df = spread(table.df).select("rid", *(S.js_trim(F.col(f"c{i}")).alias(f"x{i}_trimmed") for i in columns))
    df = with_numbers(df, [f"x{i}" for i in columns])
    return fenced(df.select("rid", *(e for i in columns for e in ((F.col(f"x{i}_trimmed") == "").alias(f"b{i}"), F.col(f"x{i}_num").alias(f"n{i}")))))


def _difference(expected: Column, actual: Column) -> Column:
    return F.struct(expected.alias("expected"), actual.alias("actual"), (expected - actual).alias("diff"))


def sum_rows(table: Table, rule: SumCheck) -> DataFrame:
    """(rid, example, bad, failed) of all rows with a total: components add up from left to right, blanks and failures as 0."""
    parts, total = [table.index(c) for c in rule.components], table.index(rule.total)
    df = numbers(table, [*parts, total]).where(~F.col(f"b{total}") & F.col(f"n{total}").isNotNull())
    expected, failed = F.lit(0.0), F.lit(False)
    for i in parts:
        expected = expected + F.coalesce(F.col(f"n{i}"), F.lit(0.0))
        failed = failed | (~F.col(f"b{i}") & F.col(f"n{i}").isNull())
    df = df.select("rid", expected.alias("expected"), F.col(f"n{total}").alias("actual"), failed.alias("failed"))
    bad = F.abs(F.col("expected") - F.col("actual")) > rule.tolerance
    return df.select("rid", _difference(F.col("expected"), F.col("actual")).alias("example"), bad.alias("bad"), "failed")


def balance_rows(table: Table, rule: BalanceCheck) -> DataFrame:
    """(rid, example) of rows whose balance is not that of the valid row before plus the amount.

    Rows follow each other inside chunks of row ids; what a chunk starts from comes from the last
    valid balances of the chunks before it, one row for each chunk.
    """
    amount, balance = table.index(rule.amount), table.index(rule.balance)
    df = numbers(table, [amount, balance]).select("rid", F.col(f"n{amount}").alias("amount"), F.col(f"n{balance}").alias("balance"))
    df = df.where("amount is not null and balance is not null").withColumn("chunk", F.floor(F.col("rid") / CHUNK))
    last = df.groupBy("chunk").agg(F.max(F.struct("rid", "balance")).alias("last"))
    carry = last.select("chunk", F.lag("last.balance").over(Window.orderBy("chunk")).alias("carry"))
    own = F.lag("balance").over(Window.partitionBy("chunk").orderBy("rid"))
    rows = df.withColumn("own", own).join(carry, "chunk")
    if rule.opening is not None:
        start = F.lit(float(rule.opening))
    else:
        start = F.when(F.col("rid") == 0, F.col("balance") - F.col("amount"))
    rows = rows.withColumn("prev", F.coalesce("own", "carry", start)).where("prev is not null")
    expected = F.col("prev") + F.col("amount")
    return rows.where(F.abs(expected - F.col("balance")) > rule.tolerance).select("rid", _difference(expected, F.col("balance")).alias("example"))


def referential_rows(table: Table, rule: ReferentialCheck) -> DataFrame:
    """(rid, example) of values that the reference lacks; values are trimmed and compared with case."""
    value = S.js_trim(F.col(f"c{table.index(rule.column)}"))
    rows = table.df.select("rid", value.alias("value"))
    blank, real = rows.where("value = ''"), rows.where("value <> ''")
    if isinstance(rule.references, list):
        found = real.where(~F.col("value").isin(*[v.strip(S.WS_CHARS) for v in rule.references])) if rule.references else real
    else:
        if isinstance(rule.references, str):
            known = table.df.select(S.js_trim(F.col(f"c{table.index(rule.references)}")).alias("value"))
        else:
            known = rule.references.select(S.js_trim(rule.references[rule.references.columns[0]].cast("string")).alias("value"))
        found = real.join(known.where("value <> ''").distinct(), "value", "left_anti")
    out = found.select("rid", F.col("value").alias("example"))
    return out if rule.allow_empty else out.unionByName(blank.select("rid", F.col("value").alias("example")))


def _partial_counts(columns: list[int]):
    """Of a batch, for each total and pair of components: rows where all three are numbers, and those that add up."""
    combos = [(k, i, j) for k in range(len(columns)) for i, j in itertools.combinations([x for x in range(len(columns)) if x != k], 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        valid, matched = np.zeros(len(combos), np.int64), np.zeros(len(combos), np.int64)
        for batch in batches:
            x = [batch.column(f"n{c}").to_numpy(zero_copy_only=False) for c in columns]
            ok = [~np.isnan(v) for v in x]
            sums = {}
            for at, (k, i, j) in enumerate(combos):
                if (i, j) not in sums:
                    sums[i, j] = x[i] + x[j], ok[i] & ok[j]
                s, both = sums[i, j]
                both = both & ok[k]
                valid[at] += both.sum()
                matched[at] += (np.abs(s[both] - x[k][both]) <= DEFAULT_TOLERANCE).sum()
        place = lambda p: pa.array([columns[c[p]] for c in combos], pa.int32())
        yield pa.RecordBatch.from_pydict({"k": place(0), "i": place(1), "j": place(2), "valid": valid, "matched": matched})

    return run


def sum_candidates(table: Table, columns: list[int]) -> DataFrame:
    """(k, i, j, valid, matched) for all totals k and pairs i < j: counted inside each task, then added up."""
    nums = numbers(table, columns).select(*(F.col(f"n{c}") for c in columns))
    return nums.mapInArrow(_partial_counts(columns), "k int, i int, j int, valid long, matched long").groupBy("k", "i", "j").agg(F.sum("valid").alias("valid"), F.sum("matched").alias("matched"))


def discover(table: Table, profiles: list[Profile]) -> list[Issue]:
    use = [p.index for p in profiles if p.type in ("integer", "decimal")]
    if len(use) < 3:
        return []
    if len(use) > DISCOVER_MAX_COLUMNS:
        return [Issue("integrity", "discovered_sum_relationship", "info", f"Skipped sum-relationship discovery: {len(use)} numeric columns exceed the limit of {DISCOVER_MAX_COLUMNS}", data={"skipped": True, "numericColumnCount": len(use), "limit": DISCOVER_MAX_COLUMNS})]
    out, seen = [], set()
    for r in sum_candidates(table, use).orderBy("k", "i", "j").collect():  # at most 660 rows
        if not r.valid or r.matched / r.valid < DISCOVER_MIN_RATIO:
            continue
        a, b, k = (table.headers[x] for x in (r.i, r.j, r.k))
        if (key := (*sorted((a, b)), k)) not in seen:
            seen.add(key)
            out.append(Issue("integrity", "discovered_sum_relationship", "info", f"Column '{k}' appears to equal '{a}' + '{b}'", data={"components": [a, b], "total": k, "matchRatio": r.matched / r.valid}))
    return out


def _unknown(missing: list[str], label: str | None, detail: dict) -> Issue:
    head = f"{label}: " if label else ""
    return Issue("integrity", "integrity_unknown_column", "error", f"{head}referenced column(s) not found: {', '.join(missing)}", data={"label": label, "missing": missing} | detail)


def _one(hits: DataFrame, rows: bool, extra: list | None = None):
    got = gather(hits.withColumn("key", F.lit(0)), ["key"], rows, extra).collect()
    return got[0] if got else None


def detect_integrity(table: Table, profiles: list[Profile], options: Integrity, rows: bool = False) -> list[Issue]:
    if not options.enabled:
        return []
    out = []
    listed = lambda r: list(r.rows) if rows else None
    for s in options.sum_checks:
        missing = [c for c in [*s.components, s.total] if table.index(c) < 0]
        rule = {"components": s.components, "total": s.total}
        if missing:
            out.append(_unknown(missing, s.label, rule))
            continue
        every = materialize(sum_rows(table, s), "sums")
        if r := _one(every.where("bad"), rows):
            failed = bool(every.agg(F.bool_or("failed")).first()[0])
            head = f"{s.label}: " if s.label else ""
            out.append(Issue("integrity", "sum_mismatch", "error", f"{head}sum of [{', '.join(s.components)}] does not equal '{s.total}' in {r.n} row(s)", listed(r), data={"label": s.label} | rule | {"tolerance": s.tolerance, "anyParseFailure": failed, "examples": examples_of(r, "expected", "actual", "diff")}, n=r.n))
    for b in options.balance_checks:
        missing = [c for c in (b.amount, b.balance) if table.index(c) < 0]
        rule = {"amount": b.amount, "balance": b.balance}
        if missing:
            out.append(_unknown(missing, b.label, rule))
        elif r := _one(balance_rows(table, b), rows):
            head = f"{b.label}: " if b.label else ""
            out.append(Issue("integrity", "balance_mismatch", "error", f"{head}running balance '{b.balance}' does not match prior balance + '{b.amount}' in {r.n} row(s)", listed(r), data={"label": b.label} | rule | {"tolerance": b.tolerance, "examples": examples_of(r, "expected", "actual", "diff")}, n=r.n))
    for c in options.referential_checks:
        missing = [x for x in (c.column, c.references) if isinstance(x, str) and table.index(x) < 0]
        if missing:
            out.append(_unknown(missing, c.label, {"column": c.column}))
        elif r := _one(referential_rows(table, c), rows):
            head = f"{c.label}: " if c.label else ""
            out.append(Issue("integrity", "referential_violation", "error", f"{head}column '{c.column}' has {r.n} value(s) not present in the reference set", listed(r), table.index(c.column), c.column, {"label": c.label, "column": c.column, "examples": [{"row": e.rid, "value": named(e.example)} for e in r.examples]}, n=r.n))
    if options.discover_sum_relationships:
        out += discover(table, profiles)
    return out
