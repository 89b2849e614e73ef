"""A registered query for each operator, and DuckDB SQL with the same rows.

The driver's tables are clean, so dirt is put in by arithmetic on keys; the SQL that does so runs
unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cells as C
from ..operators import clean as L
from ..operators import columns as K
from ..operators import duplicates as D
from ..operators import integrity as I
from ..operators.issues import issue_rows
from ..sources import tables as T
from ..sources import xlsx
from ..sources.shared import materialize, scratch_path, spread
from ..streaming.tables import running_counts
from .engine import analyze_table, summarize
from .model import TYPES, BalanceCheck, CleanOptions, Duplicates, Integrity, Near, Options, Outliers, Range, ReferentialCheck, SumCheck, Table

# dirty input

_V = "(o_orderkey * 37 % 90000 + 1000)"
_Y, _M, _D = "CAST(year(o_orderdate) AS STRING)", "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')", "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
_K = "CAST(o_custkey % 40 AS STRING)"
_THOUSANDS = f"CAST(CAST(floor({_V} / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST({_V} % 1000 AS STRING), 3, '0')"
COLUMNS = {
    "id": "CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 89 = 0 THEN '  ' ELSE CAST(o_orderkey AS STRING) END",
    "customer": f"CASE o_orderkey % 11 WHEN 0 THEN ' Cust ' || {_K} WHEN 1 THEN 'Cust  ' || {_K} WHEN 2 THEN 'CUST' || chr(160) || {_K} WHEN 3 THEN 'cust ' || {_K} || chr(9) WHEN 4 THEN 'Cu' || chr(1) || 'st ' || {_K} ELSE 'Cust ' || {_K} END",
    "order_date": f"CASE o_orderkey % 9 WHEN 0 THEN {_Y} || '/' || {_M} || '/' || {_D} WHEN 1 THEN {_D} || '/' || {_M} || '/' || {_Y} WHEN 2 THEN {_M} || '/' || {_D} || '/' || {_Y} WHEN 3 THEN 'Mar ' || {_D} || ', ' || {_Y} WHEN 4 THEN {_D} || ' September ' || {_Y} WHEN 5 THEN {_Y} || '-' || {_M} || '-' || {_D} || ' 13:45' WHEN 6 THEN {_Y} || '-02-' || {_D} ELSE {_Y} || '-' || {_M} || '-' || {_D} END",
    "amount": f"CASE o_orderkey % 16 WHEN 0 THEN '$' || {_THOUSANDS} || '.50' WHEN 1 THEN '(' || {_THOUSANDS} || ')' WHEN 2 THEN '-' || CAST({_V} AS STRING) || ' ' WHEN 3 THEN replace({_THOUSANDS}, ',', '.') || ',25' WHEN 4 THEN {_THOUSANDS} WHEN 5 THEN CAST({_V} AS STRING) || '%' WHEN 6 THEN ',' || CAST(o_orderkey % 10 AS STRING) WHEN 7 THEN 'n/a' ELSE CAST({_V} AS STRING) END",
    "flag": "CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' T ' WHEN 3 THEN 'maybe' ELSE 'N' END",
    "a": "CASE WHEN o_orderkey % 31 = 0 THEN 'x' WHEN o_orderkey % 37 = 0 THEN '' ELSE CAST(o_orderkey % 1000 AS STRING) END",
    "b": "CAST(o_orderkey * 7 % 500 AS STRING)",
    "total": "CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE CAST(o_orderkey % 1000 + o_orderkey * 7 % 500 + CASE WHEN o_orderkey % 101 = 0 THEN 5 ELSE 0 END AS STRING) END",
    "status": "CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE o_orderstatus || CASE WHEN o_orderkey % 59 = 0 THEN ' ' ELSE '' END END",
    "void": "''",
}
DIRTY = "SELECT o_orderkey AS rid, " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(COLUMNS.values())) + " FROM orders"
PLACE = {name: i for i, name in enumerate(COLUMNS)}


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def dirty(spark: SparkSession, sf_dir: str) -> Table:
    _views(spark, sf_dir, "orders")
    return Table(list(COLUMNS), spark.sql(DIRTY))


# SQL of cell parsing, for DuckDB

_WS = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_CUR = "$₩€£¥¢₹₽元"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _valid(y: str, m: str, d: str) -> str:
    return f"coalesce({y} BETWEEN 1 AND 9999 AND {m} BETWEEN 1 AND 12 AND {d} >= 1 AND {d} <= CASE WHEN {m} IN (4, 6, 9, 11) THEN 30 WHEN {m} = 2 THEN CASE WHEN ({y} % 4 = 0 AND {y} % 100 <> 0) OR {y} % 400 = 0 THEN 29 ELSE 28 END ELSE 31 END, false)"


_MONTHS = "CASE {x} " + " ".join(f"WHEN '{n}' THEN {i + 1}" for i, names in enumerate(zip(S.MONTHS, S.LONG_MONTHS, strict=True)) for n in dict.fromkeys((*names, *(["sept"] if i == 8 else [])))) + " END"
CELLS = f"dirty AS ({DIRTY}), cells AS (" + " UNION ALL ".join(f"SELECT rid, {i} AS col, c{i} AS raw FROM dirty" for i in range(len(COLUMNS))) + ")"
PARSED = CELLS + f""",
t1 AS (SELECT *, {_trim('raw')} AS trimmed FROM cells),
t2 AS (SELECT *, regexp_matches(trimmed, '^\\(.*\\)$') AS paren, CASE WHEN regexp_matches(trimmed, '^\\(.*\\)$') THEN {_trim("substr(trimmed, 2, length(trimmed) - 2)")} ELSE trimmed END AS body FROM t1),
t3 AS (SELECT *, regexp_replace(CASE WHEN body LIKE '-%' OR body LIKE '+%' THEN {_trim('substr(body, 2)')} ELSE body END, '[{_WS}%{_CUR}]', '', 'g') AS bare FROM t2),
t4 AS (SELECT *, CASE WHEN contains(bare, ',') AND contains(bare, '.') THEN CASE WHEN regexp_matches(bare, ',[^.]*$') THEN regexp_replace(replace(bare, '.', ''), ',', '.') ELSE replace(bare, ',', '') END
  WHEN contains(bare, ',') THEN CASE WHEN regexp_matches(bare, '^[^,]{{1,3}}(,[^,]{{3}})+$') THEN replace(bare, ',', '') WHEN regexp_matches(bare, '^[^,]*,[^,]*$') AND NOT regexp_matches(bare, ',[^,]{{3}}$') THEN replace(bare, ',', '.') ELSE replace(bare, ',', '') END ELSE bare END AS point FROM t3),
t5 AS (SELECT *, CASE WHEN point LIKE '.%' THEN '0' || point ELSE point END AS plain FROM t4),
t6 AS (SELECT *, CASE WHEN NOT regexp_matches(point, '^([0-9]+(\\.[0-9]+)?|\\.[0-9]+)$') THEN NULL WHEN (paren <> (body LIKE '-%')) AND NOT regexp_matches(plain, '^0(\\.0+)?$') THEN '-' || plain ELSE plain END AS num_s FROM t5),
t7 AS (SELECT *, TRY_CAST(num_s AS DOUBLE) AS num, trimmed = '' AS blank, regexp_extract(trimmed, '^(.+?)[ T]((?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?(?:[{_WS}]*[AaPp][Mm])?)$', 1) AS front FROM t6),
t8 AS (SELECT *, front <> '' AS timed, CASE WHEN front <> '' THEN {_trim('front')} ELSE trimmed END AS dp FROM t7),
t9 AS (SELECT *, lower({_trim(f"regexp_replace(dp, '[,{_WS}]+', ' ', 'g')")}) AS named,
  CASE WHEN regexp_matches(dp, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$|^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}$') THEN '-' WHEN regexp_matches(dp, '^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}$|^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') THEN '/' WHEN regexp_matches(dp, '^[0-9]{{4}}\\.[0-9]{{1,2}}\\.[0-9]{{1,2}}$|^[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{4}}$') THEN '.' END AS sep FROM t8),
t10 AS (SELECT *, CASE WHEN sep IS NOT NULL THEN TRY_CAST(split_part(dp, sep, 1) AS INT) END AS p1, CASE WHEN sep IS NOT NULL THEN TRY_CAST(split_part(dp, sep, 2) AS INT) END AS p2, CASE WHEN sep IS NOT NULL THEN TRY_CAST(split_part(dp, sep, 3) AS INT) END AS p3,
  sep IS NOT NULL AND regexp_matches(dp, '^[0-9]{{4}}') AS yf, regexp_matches(named, '^[a-z]+ [0-9]{{1,2}} [0-9]{{4}}$') AS wf, regexp_matches(named, '^[0-9]{{1,2}} [a-z]+ [0-9]{{4}}$') AS df FROM t9),
t11 AS (SELECT *, CASE WHEN wf THEN {_MONTHS.format(x="split_part(named, ' ', 1)")} WHEN df THEN {_MONTHS.format(x="split_part(named, ' ', 2)")} END AS nm, CASE WHEN wf THEN TRY_CAST(split_part(named, ' ', 2) AS INT) WHEN df THEN TRY_CAST(split_part(named, ' ', 1) AS INT) END AS nd, CASE WHEN wf OR df THEN TRY_CAST(split_part(named, ' ', 3) AS INT) END AS ny FROM t10),
t12 AS (SELECT *, sep IS NOT NULL AND NOT yf AND {_valid('p3', 'p2', 'p1')} AS dok, sep IS NOT NULL AND NOT yf AND {_valid('p3', 'p1', 'p2')} AS mok FROM t11),
t13 AS (SELECT *, CASE WHEN yf AND {_valid('p1', 'p2', 'p3')} THEN 'YYYY' || sep || 'MM' || sep || 'DD' WHEN dok OR mok THEN 'DD' || sep || 'MM' || sep || 'YYYY' WHEN sep IS NULL AND wf AND {_valid('ny', 'nm', 'nd')} THEN 'MMM DD, YYYY' WHEN sep IS NULL AND df AND {_valid('ny', 'nm', 'nd')} THEN 'DD MMM YYYY' END AS shape FROM t12),
parsed AS (SELECT rid, col, raw, trimmed, blank, num_s, num, shape, shape IS NOT NULL AND timed AS timed, CASE WHEN shape IS NOT NULL AND sep IS NOT NULL AND NOT yf THEN p1 > 12 ELSE false END AS day_first, CASE WHEN shape IS NOT NULL AND sep IS NOT NULL AND NOT yf THEN p2 > 12 ELSE false END AS month_first,
  CASE WHEN shape IS NULL THEN NULL WHEN sep IS NULL THEN ny WHEN yf THEN p1 WHEN dok <> mok THEN p3 END AS y, CASE WHEN shape IS NULL THEN NULL WHEN sep IS NULL THEN nm WHEN yf THEN p2 WHEN dok <> mok THEN CASE WHEN dok THEN p2 ELSE p1 END END AS m, CASE WHEN shape IS NULL THEN NULL WHEN sep IS NULL THEN nd WHEN yf THEN p3 WHEN dok <> mok THEN CASE WHEN dok THEN p1 ELSE p2 END END AS d,
  CASE WHEN blank THEN 'empty' WHEN num IS NOT NULL AND num = floor(num) THEN 'integer' WHEN num IS NOT NULL THEN 'decimal' WHEN lower(trimmed) IN ('true', 'yes', 'y', 't', 'false', 'no', 'n', 'f') THEN 'boolean' WHEN shape IS NOT NULL THEN 'date' ELSE 'string' END AS type,
  NOT blank AND (raw <> trimmed OR regexp_matches(raw, '[{_WS}]{{2,}}') OR regexp_matches(raw, '[\\x{{00A0}}\\x{{3000}}]') OR regexp_matches(raw, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) AS ws FROM t13)"""
_COUNTS = ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t}" for t in (*TYPES, "empty"))
_TOP = "greatest(" + ", ".join(f"n_{t}" for t in TYPES) + ")"
PROFILED = PARSED + f""",
pc AS (SELECT col, count(*) AS total, {_COUNTS}, count(DISTINCT trimmed) FILTER (NOT blank) AS distinct_count, count(num) AS n_num, min(num) AS lo, max(num) AS hi, avg(num) AS mean, sum(num) AS s, coalesce(stddev_samp(num), 0) AS sd, quantile_cont(num, 0.25) AS q1, quantile_cont(num, 0.5) AS q2, quantile_cont(num, 0.75) AS q3 FROM parsed GROUP BY col),
prof AS (SELECT *, CASE WHEN total = n_empty THEN 'empty' """ + " ".join(f"WHEN n_{t} = {_TOP} THEN '{t}'" for t in TYPES) + f""" END AS ptype, CASE WHEN total = n_empty THEN 0 ELSE {_TOP} / (total - n_empty) END AS confidence FROM pc)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# scalar functions


@query(f"WITH {PARSED} SELECT rid, col, blank, trim(regexp_replace(raw, '[{_WS}]+', ' ', 'g'), ' ') AS normalized, regexp_matches(raw, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') AS control, regexp_matches(raw, '[\\x{{00A0}}\\x{{3000}}]') AS unusual, ws AS to_trim FROM parsed")
def whitespace_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dirty(spark, sf_dir)
    raw = F.col("raw")
    rows = spread(table.df).select("rid", F.posexplode(F.array(*table.columns)).alias("col", "raw"))
    return rows.select("rid", "col", S.is_blank(raw).alias("blank"), S.normalize_whitespace(raw).alias("normalized"), S.has_control_chars(raw).alias("control"), S.has_unusual_space(raw).alias("unusual"), (~S.is_blank(raw) & S.needs_whitespace_trim(raw)).alias("to_trim"))


@query(f"WITH {PARSED} SELECT rid, col, coalesce(num_s, '-') AS num_s, coalesce(num, 0) AS num, num IS NOT NULL AS numeric_cell, num IS NOT NULL AND coalesce(num = floor(num), false) AS integer_cell FROM parsed")
def numeric_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dirty(spark, sf_dir)
    num = F.col("num")
    return C.cells(table, "num").select("rid", "col", F.coalesce("num_s", F.lit("-")).alias("num_s"), F.coalesce(num, F.lit(0.0)).alias("num"), num.isNotNull().alias("numeric_cell"), S.is_integral(num).alias("integer_cell"))


@query(f"WITH {PARSED} SELECT rid, col, CASE WHEN lower(trimmed) IN ('true', 'yes', 'y', '1', 't') THEN 'true' WHEN lower(trimmed) IN ('false', 'no', 'n', '0', 'f') THEN 'false' ELSE '-' END AS flag, type FROM parsed")
def type_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dirty(spark, sf_dir)
    return C.cells(table, "type").select("rid", "col", F.coalesce(S.parse_boolean(F.col("raw")).cast("string"), F.lit("-")).alias("flag"), "type")


@query(f"WITH {PARSED} SELECT rid, col, coalesce(shape, '-') AS shape, timed, day_first, month_first, coalesce(y, 0) AS y, coalesce(m, 0) AS m, coalesce(d, 0) AS d, CASE WHEN d IS NOT NULL AND NOT timed THEN CAST(y AS STRING) || '-' || lpad(CAST(m AS STRING), 2, '0') || '-' || lpad(CAST(d AS STRING), 2, '0') ELSE '-' END AS iso FROM parsed")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dirty(spark, sf_dir)
    a = F.col("date")
    rows = C.cells(table, "date").withColumn("iso", F.when(a["day"].isNotNull(), S.format_date(a)))
    flag = lambda name, to: F.coalesce(a[name], F.lit(False)).alias(to)
    part = lambda name, to: F.coalesce(a[name], F.lit(0)).alias(to)
    text = [F.coalesce(c, F.lit("-")).alias(n) for c, n in ((a["shape"], "shape"), (F.col("iso"), "iso"))]
    return rows.select("rid", "col", *text, flag("has_time", "timed"), flag("forces_day_first", "day_first"), flag("forces_month_first", "month_first"), part("year", "y"), part("month", "m"), part("day", "d"))


# profile

_NUMERIC = "ptype IN ('integer', 'decimal')"


@query(
    f"WITH {PROFILED}, sh AS (SELECT col, shape, min(rid) AS r FROM parsed WHERE shape IS NOT NULL AND NOT blank GROUP BY col, shape), so AS (SELECT col, string_agg(shape, '|' ORDER BY r) AS shapes FROM sh GROUP BY col) "
    + "SELECT prof.col, total, distinct_count, "
    + ", ".join(f"n_{t}" for t in (*TYPES, "empty"))
    + f", ptype AS type, round(confidence, 9) AS confidence, CASE WHEN {_NUMERIC} THEN n_num ELSE 0 END AS n, "
    + ", ".join(f"CASE WHEN {_NUMERIC} THEN round({a}, 3) END AS {b}" for a, b in (("lo", "min"), ("hi", "max"), ("mean", "mean"), ("s", "sum"), ("sd", "stdev"), ("q1", "q1"), ("q2", "median"), ("q3", "q3")))
    + ", CASE WHEN ptype = 'date' THEN shapes ELSE '-' END AS date_formats FROM prof LEFT JOIN so ON prof.col = so.col"
)
def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.profile_frame(materialize(C.cells(dirty(spark, sf_dir), "type"), "cells"))
    numeric = F.col("type").isin("integer", "decimal")
    stat = lambda c, name: F.when(numeric, F.round(c, 3)).alias(name)
    return p.select("col", "total", F.col("distinct").alias("distinct_count"), *(f"n_{t}" for t in (*TYPES, "empty")), "type", F.round("confidence", 9).alias("confidence"), F.when(numeric, F.col("count")).otherwise(0).alias("n"), stat(F.col("min"), "min"), stat(F.col("max"), "max"), stat(F.col("mean"), "mean"), stat(F.col("sum"), "sum"), stat(F.col("stdev"), "stdev"), stat(F.col("q")[0], "q1"), stat(F.col("q")[1], "median"), stat(F.col("q")[2], "q3"), F.when(F.col("type") == "date", F.array_join("shapes", "|")).otherwise("-").alias("date_formats"))


# duplicates



def _normal(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '[{_WS}]+', ' ', 'g'), ' '))"


_KEPT = [i for n, i in PLACE.items() if n in ("customer", "flag", "status")]


@query(f"WITH {CELLS}, k AS (SELECT rid, " + " || chr(1) || ".join(_normal(f"c{i}") for i in _KEPT) + " AS key FROM dirty) SELECT min(rid) OVER (PARTITION BY key) AS keep, rid FROM k QUALIFY count(*) OVER (PARTITION BY key) > 1")
def exact_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_groups(dirty(spark, sf_dir), Duplicates(ignore_columns=[n for n in COLUMNS if PLACE[n] not in _KEPT]))


_TWICE = "SELECT 2 * item_id AS rid, text AS c0 FROM benchmark UNION ALL SELECT 2 * item_id + 1 AS rid, text || ' revised' AS c0 FROM benchmark"


@query(
    f"""WITH t AS ({_TWICE}), s AS (SELECT rid, {_normal('c0')} AS x FROM t), g AS (SELECT rid, x, substr(x, CAST(i AS BIGINT), 2) AS b FROM s, range(1, length(x)) r(i)), c AS (SELECT rid, b, count(*) AS n FROM g GROUP BY rid, b),
    p AS (SELECT a.rid AS i, z.rid AS j, sum(least(a.n, z.n)) AS o FROM c a JOIN c z ON a.b = z.b AND a.rid < z.rid GROUP BY a.rid, z.rid),
    d AS (SELECT i, j, 2 * o / (length(u.x) + length(v.x) - 2) AS sim FROM p JOIN s u ON u.rid = i JOIN s v ON v.rid = j) SELECT i, j, floor(sim * 1000 + 0.5) / 1000 AS similarity FROM d WHERE sim >= 0.9 AND sim < 1"""
)
def near_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "benchmark")
    return D.near_duplicates(Table(["text"], spark.sql(_TWICE)), Duplicates(near=Near(limit=None)))


# format


@query(f"WITH {PARSED} SELECT rid, col, raw AS value FROM parsed WHERE ws")
def whitespace_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.whitespace_hits(C.cells(dirty(spark, sf_dir), "ws")).select("rid", "col", F.col("example").alias("value"))


@query(f"WITH {PARSED}, h AS (SELECT * FROM parsed WHERE shape IS NOT NULL AND NOT blank), s AS (SELECT col, shape, count(*) AS n, min(rid) AS r FROM h GROUP BY col, shape) SELECT col, CAST(sum(n) AS BIGINT) AS dates, count(*) AS formats, string_agg(shape || '=' || n, ';' ORDER BY r) AS counts FROM s GROUP BY col HAVING count(*) > 1")
def inconsistent_date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.date_summary(C.cells(dirty(spark, sf_dir), "date")).where(F.size("shapes") > 1)
    return s.select("col", "dates", F.size("shapes").cast("long").alias("formats"), F.array_join(F.transform("shapes", lambda x: F.concat(x["shape"], F.lit("="), x["n"].cast("string"))), ";").alias("counts"))


@query(f"WITH {PARSED}, h AS (SELECT col, min(rid) FILTER (day_first) AS day_row, min(rid) FILTER (month_first) AS month_row, arg_min(raw, rid) FILTER (day_first) AS day_value, arg_min(raw, rid) FILTER (month_first) AS month_value FROM parsed WHERE NOT blank GROUP BY col) SELECT * FROM h WHERE day_row IS NOT NULL AND month_row IS NOT NULL")
def ambiguous_date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.date_summary(C.cells(dirty(spark, sf_dir), "date")).where("day is not null and month is not null")
    return s.select("col", F.col("day.rid").alias("day_row"), F.col("day.raw").alias("day_value"), F.col("month.rid").alias("month_row"), F.col("month.raw").alias("month_value"))


@query(f"WITH {PROFILED}, n AS (SELECT p.col, count(*) AS cells, count(*) FILTER (regexp_matches(raw, '[{_CUR}]')) AS with_currency, count(*) FILTER (contains(raw, ',')) AS with_grouping FROM parsed p JOIN prof ON prof.col = p.col WHERE {_NUMERIC} AND NOT blank GROUP BY p.col) SELECT * FROM n WHERE (with_currency > 0 AND with_currency < cells) OR (with_grouping > 0 AND with_grouping < cells)")
def inconsistent_number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dirty(spark, sf_dir)
    parsed = materialize(C.cells(table, "type"), "cells")
    use = [p.index for p in C.profiles(table, parsed) if p.type in K.NUMERIC]
    n = K.number_hits(parsed, use).groupBy("col").agg(F.count("*").alias("cells"), F.count_if("currency").alias("with_currency"), F.count_if("grouping").alias("with_grouping"))
    return n.where("(with_currency > 0 and with_currency < cells) or (with_grouping > 0 and with_grouping < cells)")


# outliers


@query(f"WITH {PARSED}, b AS (SELECT col, count(*) AS total, count(*) FILTER (blank) AS blanks, min(rid) FILTER (blank) AS first_row FROM parsed GROUP BY col) SELECT col, blanks, first_row, CASE WHEN blanks = total THEN 'empty_column' ELSE 'missing_value' END AS type FROM b WHERE blanks > 0")
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = K.blank_summary(C.cells(dirty(spark, sf_dir), "blank"))
    return b.select("col", "blanks", "first_row", F.when(F.col("blanks") == F.col("total"), "empty_column").otherwise("missing_value").alias("type"))


@query(f"WITH {PROFILED} SELECT rid, p.col, raw AS value, type AS found FROM parsed p JOIN prof ON prof.col = p.col WHERE confidence >= 0.7 AND ptype IN ('integer', 'decimal', 'date', 'boolean') AND NOT blank AND type <> ptype AND NOT (type IN ('integer', 'decimal') AND ptype IN ('integer', 'decimal'))")
def type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dirty(spark, sf_dir)
    parsed = materialize(C.cells(table, "type"), "cells")
    return K.mismatch_hits(parsed, C.profiles(table, parsed)).select("rid", "col", F.col("example.value").alias("value"), F.col("example.found").alias("found"))


_IQR = "(q3 - q1 > 0 AND (num < q1 - 0.6 * (q3 - q1) OR num > q3 + 0.6 * (q3 - q1)))"
_Z = "(sd > 0 AND abs((num - mean) / sd) > 1.8)"


@query(f"WITH {PROFILED} SELECT rid, p.col, num AS value, {_IQR} AS iqr, {_Z} AS z FROM parsed p JOIN prof ON prof.col = p.col WHERE {_NUMERIC} AND n_num >= 4 AND num IS NOT NULL AND ({_IQR} OR {_Z})")
def statistical_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dirty(spark, sf_dir)
    parsed = materialize(C.cells(table, "type"), "cells")
    return K.outlier_hits(parsed, C.profiles(table, parsed), Outliers(z_score_threshold=1.8, iqr_multiplier=0.6)).select("rid", "col", F.col("example").alias("value"), "iqr", "z")


@query(f"WITH {PARSED} SELECT rid, num AS value FROM parsed WHERE col = {PLACE['amount']} AND (num < 0 OR num > 50000)")
def range_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dirty(spark, sf_dir)
    return K.range_hits(C.cells(table, "num", columns=[PLACE["amount"]]), table, Range("amount", 0, 50000)).select("rid", F.col("example").alias("value"))


# integrity

_WIDE = ", ".join(f"max(num) FILTER (col = {PLACE[n]}) AS {n}, bool_or(blank) FILTER (col = {PLACE[n]}) AS {n}_blank" for n in ("a", "b", "total"))


@query(f"WITH {PARSED}, w AS (SELECT rid, {_WIDE} FROM parsed GROUP BY rid) SELECT rid, coalesce(a, 0) + coalesce(b, 0) AS expected, total AS actual, coalesce(a, 0) + coalesce(b, 0) - total AS diff FROM w WHERE total IS NOT NULL AND abs(coalesce(a, 0) + coalesce(b, 0) - total) > 0.01")
def sum_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sum_rows(dirty(spark, sf_dir), SumCheck(["a", "b"], "total")).where("bad").select("rid", "example.*")


_RUN = "SELECT event_id AS rid, CASE WHEN event_id % 71 = 3 THEN 'x' ELSE CAST(event_id % 10 - 4 AS STRING) END AS c0, CAST(5 * CAST(floor(event_id / 10) AS BIGINT) + CAST((event_id % 10) * (event_id % 10 + 1) / 2 AS BIGINT) - 4 * (event_id % 10 + 1) + CASE WHEN event_id % 113 = 50 THEN 7 ELSE 0 END AS STRING) AS c1 FROM events"


@query(f"WITH t AS ({_RUN}), v AS (SELECT rid, TRY_CAST(c0 AS DOUBLE) AS a, TRY_CAST(c1 AS DOUBLE) AS b FROM t WHERE TRY_CAST(c0 AS DOUBLE) IS NOT NULL), l AS (SELECT rid, a, b, coalesce(lag(b) OVER (ORDER BY rid), CASE WHEN rid = 0 THEN b - a END) AS prev FROM v) SELECT rid, prev + a AS expected, b AS actual, prev + a - b AS diff FROM l WHERE abs(prev + a - b) > 0.01")
def balance_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "events")
    return I.balance_rows(Table(["amount", "balance"], spark.sql(_RUN)), BalanceCheck("amount", "balance")).select("rid", "example.*")


@query(f"WITH {CELLS} SELECT rid, {_trim(f'c{PLACE["status"]}')} AS value FROM dirty WHERE {_trim(f'c{PLACE["status"]}')} NOT IN ('O', 'F')")
def referential_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.referential_rows(dirty(spark, sf_dir), ReferentialCheck("status", ["O", "F"], allow_empty=False)).select("rid", F.col("example").alias("value"))


@query("SELECT o_orderkey AS rid, CAST(o_custkey AS STRING) AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def referential_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "orders", "customer")
    table = Table(["cust"], spark.sql("SELECT o_orderkey AS rid, CAST(o_custkey AS STRING) AS c0 FROM orders"))
    known = spark.sql("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
    return I.referential_rows(table, ReferentialCheck("cust", known)).select("rid", F.col("example").alias("value"))


@query("WITH t AS (SELECT CAST(l_linenumber AS DOUBLE) AS x0, l_quantity AS x1, CAST(l_linenumber AS DOUBLE) + l_quantity AS x2, l_discount AS x3 FROM lineitem) " + " UNION ALL ".join(f"SELECT {k} AS k, {i} AS i, {j} AS j, count(*) AS valid, count(*) FILTER (abs(x{i} + x{j} - x{k}) <= 0.01) AS matched FROM t" for k in range(4) for i in range(4) for j in range(i + 1, 4) if k not in (i, j)))
def discovered_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "lineitem")
    typed = spark.sql("SELECT l_linenumber AS line, l_quantity AS quantity, l_linenumber + l_quantity AS both, l_discount AS discount FROM lineitem")
    return I.sum_candidates(T.from_dataframe(typed), [0, 1, 2, 3])


# cleaning

_FIXED = PROFILED + f""",
f1 AS (SELECT p.rid, p.col, p.raw, ptype, CASE WHEN ws THEN trim(regexp_replace(p.raw, '[{_WS}]+', ' ', 'g'), ' ') ELSE p.raw END AS s0, num_s, y, m, d, timed FROM parsed p JOIN prof ON prof.col = p.col),
f2 AS (SELECT *, CASE WHEN {_NUMERIC} AND num_s IS NOT NULL THEN num_s ELSE s0 END AS s1 FROM f1),
f3 AS (SELECT *, CASE WHEN ptype = 'date' AND d IS NOT NULL AND NOT timed THEN CAST(y AS STRING) || '-' || lpad(CAST(m AS STRING), 2, '0') || '-' || lpad(CAST(d AS STRING), 2, '0') ELSE s1 END AS s2 FROM f2)"""


@query(f"WITH {_FIXED} SELECT rid AS row, col AS \"column\", raw AS before, s0 AS after, 'whitespace' AS fixer FROM f3 WHERE raw <> s0 UNION ALL SELECT rid, col, s0, s1, 'number_format' FROM f3 WHERE s0 <> s1 UNION ALL SELECT rid, col, s1, s2, 'date_format' FROM f3 WHERE s1 <> s2")
def clean_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dirty(spark, sf_dir)
    return L.cell_changes(table, C.profiles(table), CleanOptions()).select("row", "column", "before", "after", "fixer")


_CLEANED = [i for n, i in PLACE.items() if n in ("customer", "flag", "status")]


@query(f"WITH {_FIXED}, w AS (SELECT rid, " + ", ".join(f"max(s2) FILTER (col = {i}) AS c{k}" for k, i in enumerate(_CLEANED)) + " FROM f3 GROUP BY rid), k AS (SELECT *, min(rid) OVER (PARTITION BY c0, c1, c2) AS kept FROM w) SELECT row_number() OVER (ORDER BY rid) - 1 AS rid, c0, c1, c2 FROM k WHERE rid = kept")
def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dirty(spark, sf_dir)
    narrow = Table([list(COLUMNS)[i] for i in _CLEANED], table.df.select("rid", *(F.col(f"c{i}").alias(f"c{k}") for k, i in enumerate(_CLEANED))))
    return L.clean_table(narrow).table.df


@query(f"WITH {_FIXED}, w AS (SELECT rid, " + ", ".join(f"max(s2) FILTER (col = {i}) AS c{k}" for k, i in enumerate(_CLEANED)) + " FROM f3 GROUP BY rid), k AS (SELECT *, min(rid) OVER (PARTITION BY c0, c1, c2) AS kept_row FROM w) SELECT rid AS row, kept_row FROM k WHERE rid > kept_row")
def clean_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = dirty(spark, sf_dir)
    narrow = Table([list(COLUMNS)[i] for i in _CLEANED], table.df.select("rid", *(F.col(f"c{i}").alias(f"c{k}") for k, i in enumerate(_CLEANED))))
    return L.clean_table(narrow).removals.select("row", "kept_row")


# sources, streams, reports


@query(f"SELECT rid, {', '.join(f'c{i}' for i in range(len(COLUMNS)))} FROM ({DIRTY})")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    T.write_csv(dirty(spark, sf_dir), path, files=5)
    return T.read_csv(spark, path).df


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS rid, CAST(n_nationkey AS STRING) AS c0, n_name AS c1, CAST(n_regionkey AS STRING) AS c2 FROM nation")
def xlsx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # a fixed table of 25 rows
    return xlsx.parse_xlsx(spark, xlsx.to_xlsx(["n_nationkey", "n_name", "n_regionkey"], [list(r) for r in rows])).df


@query("WITH c AS (SELECT 0 AS col, 'c_custkey' AS name, CAST(c_custkey AS STRING) AS raw FROM customer UNION ALL SELECT 1, 'c_name', c_name FROM customer UNION ALL SELECT 2, 'c_mktsegment', c_mktsegment FROM customer) SELECT col, name, count(*) AS total, count(*) FILTER (regexp_matches(raw, '^[0-9]+$')) AS n_integer, count(*) FILTER (NOT regexp_matches(raw, '^[0-9]+$')) AS n_string, CAST(0 AS BIGINT) AS to_trim FROM c GROUP BY col, name")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"counts_{uuid.uuid4().hex}"
    fields = spark.read.parquet(f"{sf_dir}/customer.parquet").schema
    stream = spark.readStream.schema(fields).parquet(f"{sf_dir}/customer.parq*").select("c_custkey", "c_name", "c_mktsegment")
    folder = scratch_path(spark, "stream")
    q = running_counts(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("col", "name", "total", "n_integer", "n_string", "to_trim")


OPTIONS = Options(outliers=Outliers(ranges=[Range("amount", 0, 50000)]), integrity=Integrity(sum_checks=[SumCheck(["a", "b"], "total")], referential_checks=[ReferentialCheck("status", ["O", "F"])], discover_sum_relationships=True))


@query()
def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of the dirty table as a frame; counts and examples, not all rows."""
    return issue_rows(spark, analyze_table(dirty(spark, sf_dir), OPTIONS, rows=False).issues)


@query()
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summarize(analyze_table(dirty(spark, sf_dir), OPTIONS, rows=False).issues)
    return spark.createDataFrame([("category", k, v) for k, v in s["by_category"].items()] + [("severity", k, v) for k, v in s["by_severity"].items()], "kind string, name string, n long")
