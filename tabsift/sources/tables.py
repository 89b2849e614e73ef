"""Tables from rows, CSV text or files, and typed frames; CSV out."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from itertools import islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import is_blank
from ..plans.model import Table
from .shared import materialize

csv.field_size_limit((1 << 31) - 1)  # cells may be long
#: The candidates in the order of trial.
DELIMITERS = (",", "\t", "|", ";", "\x1e", "\x1f")


def number_rows(df: DataFrame, name: str = "rid") -> DataFrame:
    """A dense number from 0 in the frame's order: the place in the partition plus the rows of those before it.

    The rows are written once with their places, so that counts and numbers agree whatever becomes of executors.
    """
    marked = materialize(df.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    counts = marked.groupBy(F.shiftrightunsigned("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each partition
    out = marked.withColumn("_p", F.shiftrightunsigned("_m", 33)).join(F.broadcast(before), "_p")
    return out.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_before")


def renumber(df: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Make the ids of a frame dense again, in their order: a row's place in its chunk of ids plus the rows of the chunks before."""
    rows = df.withColumn("_chunk", F.floor(F.col("rid") / chunk))
    counts = rows.groupBy("_chunk").agg(F.count("*").alias("_n"))
    before = counts.select("_chunk", (F.sum("_n").over(Window.orderBy("_chunk")) - F.col("_n")).alias("_before"))  # a row for each chunk
    place = F.row_number().over(Window.partitionBy("_chunk").orderBy("rid")) - 1
    out = rows.withColumn("_place", place).join(before, "_chunk")
    return out.withColumn("rid", F.col("_before") + F.col("_place")).drop("_chunk", "_place", "_before")


def schema(width: int) -> T.StructType:
    return T.StructType([T.StructField("rid", T.LongType(), False), *(T.StructField(f"c{i}", T.StringType(), False) for i in range(width))])


def _fit(row: Sequence[str | None], width: int) -> list[str]:
    return [(row[i] if i < len(row) and row[i] is not None else "") for i in range(width)]


def table_from_rows(spark: SparkSession, headers: Sequence[str], rows: Sequence[Sequence[str | None]]) -> Table:
    """Rows padded or cut to the headers' width; headers stay as they are."""
    data = [(i, *_fit(r, len(headers))) for i, r in enumerate(rows)]
    return Table(list(headers), spark.createDataFrame(data, schema(len(headers))))


def headed(raw: list[list[str]], has_header: bool) -> tuple[list[str], list[list[str]]]:
    """Headers and body of parsed rows: blank headers and headless columns are named by their place."""
    if not raw:
        return [], []
    if has_header:
        return [f"col{i}" if not h.strip() else h for i, h in enumerate(raw[0])], raw[1:]
    return [f"col{i}" for i in range(max(map(len, raw)))], raw


def guess_delimiter(text: str) -> str | None:
    """The candidate that splits the first rows into most fields and no less evenly than those before it, or None."""
    best, least, most = None, float("inf"), 1.99
    for d in DELIMITERS:
        widths = [len(r) for r in islice(csv.reader(io.StringIO(text[: 1 << 20], newline=""), delimiter=d), 10) if any(c.strip() for c in r)]
        if widths and (mean := sum(widths) / len(widths)) > most:
            drift = sum(abs(a - b) for a, b in pairwise(widths))
            if drift <= least:
                best, least, most = d, drift, mean
    return best


def _found(text: str, delimiter: str | None) -> tuple[str, list[str]]:
    """The delimiter, and an error if there is none to be seen."""
    delimiter = delimiter or guess_delimiter(text)
    return delimiter or ",", [] if delimiter else ["Delimiter: Unable to auto-detect delimiting character; defaulted to ','"]


def _quote_error(text: str, delimiter: str) -> list[str]:
    """The first error of quotes, with the row it is in."""
    row = 0
    try:
        for _ in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True):
            row += 1
    except csv.Error as e:
        return [f"Quotes: {'Quoted field unterminated' if 'end of data' in str(e) else 'Trailing quote on quoted field is malformed'} (row {row})"]
    return []


def parse_csv(spark: SparkSession, text: str, has_header: bool = True, delimiter: str | None = None) -> Table:
    """CSV text as a table. Rows whose cells are all blank are dropped."""
    text = text.removeprefix("\ufeff")
    delimiter, errors = _found(text, delimiter)
    raw = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if any(c.strip() for c in r)]
    headers, body = headed(raw, has_header)
    out = table_from_rows(spark, headers, body)
    out.meta = {"delimiter": delimiter, "parse_errors": errors + _quote_error(text, delimiter)}
    return out


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


#: Lines of the first file from which the delimiter and the header are read.
HEAD = 200


def read_csv(spark: SparkSession, path: str, has_header: bool = True, delimiter: str | None = None, multiline: bool | None = None, max_columns: int = 20480) -> Table:
    """CSV files as one table, in the order of their names; each file's first row is its header.

    A first scan of the lines finds files that open a quote in one line and close it in another; only then
    (or with `multiline=True`) a file is read by one task, else large files are split among tasks. The width
    is the first header's, or the widest row's without headers. Rows whose cells are all blank are dropped. Rows are
    written once to the shared folder with their file and place, from which they are numbered.
    """
    lines = spark.read.text(path)
    quotes = _count(F.col("value"), '"')
    stats = lines.where(~is_blank(F.col("value"))).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.sum(quotes).alias("quotes"), F.max(quotes % 2).alias("odd"))
    files = sorted(stats.collect(), key=lambda r: r.f)  # a row for each file
    if not files:
        return Table([], spark.createDataFrame([], schema(0)), {"delimiter": delimiter or ",", "parse_errors": _found("", delimiter)[1]})
    text = "\n".join(r.value for r in lines.where(F.col("_metadata.file_path") == files[0].f).limit(HEAD).collect()).removeprefix("\ufeff")
    delimiter, errors = _found(text, delimiter)
    first = next(r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if any(c.strip() for c in r))
    if multiline is None:
        multiline = any(r.odd for r in files)
    width = len(first)
    if not has_header:
        width = max(width, lines.select(F.max(_count(F.regexp_replace("value", '"[^"]*"', ""), delimiter))).first()[0] + 1)
    names = [f"c{i}" for i in range(width)]
    fields = [*names, "_more"]  # a row that goes on after the last column is not blank
    read = spark.read.schema(", ".join(f"{n} string" for n in fields)).options(sep=delimiter, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxColumns=max_columns, maxCharsPerColumn=-1, emptyValue="", enforceSchema=True)
    place = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m")]
    blank = is_blank(F.concat(*(F.coalesce(F.col(n), F.lit("")) for n in fields)))
    rows = read.csv(path).where(~blank).select(*place, *(F.coalesce(n, F.lit("")).alias(n) for n in names))
    rows = materialize(rows, "csv")
    blocks = rows.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))  # a row for each block of a file
    order = Window.orderBy("_f", "_b")
    header = F.dense_rank().over(Window.orderBy("_f")) if has_header else F.lit(0)
    top = (F.row_number().over(Window.partitionBy("_f").orderBy("_b")) == 1) & F.lit(has_header)
    blocks = blocks.select("_f", "_b", "_m0", (F.sum("_n").over(order) - F.col("_n") - header).alias("_before"), top.alias("_top"))
    body = rows.join(blocks, ["_f", "_b"]).where(~(F.col("_top") & (F.col("_m") == F.col("_m0"))))
    df = body.select((F.col("_before") + F.col("_m") - F.col("_m0")).alias("rid"), *names)
    if any(r.quotes % 2 for r in files):
        ends = {r["_f"]: r.n for r in rows.groupBy("_f").agg(F.count("*").alias("n")).collect()}
        total = 0
        for r in files:
            total += ends.get(r.f, 0)
            errors += [f"Quotes: Quoted field unterminated (row {total - 1})"] if r.quotes % 2 else []
    headers = [f"col{i}" if not h.strip() else h for i, h in enumerate(first)] if has_header else [f"col{i}" for i in range(width)]
    return Table(headers, df, {"delimiter": delimiter, "parse_errors": errors})


def stringified(field: T.StructField) -> Column:
    """A typed column as cells: numbers without exponent, dates as such, nulls as blanks."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        out = F.regexp_replace(F.call_function("format_number", c, F.lit("0.################")), "^-0$", "0")
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def from_dataframe(df: DataFrame, rid: str | None = None) -> Table:
    """A typed frame as a table; `rid` names a dense number from 0, or else rows are numbered in their order."""
    fields = [f for f in df.schema.fields if f.name != rid]
    cells = df.select(*([F.col(rid).cast("bigint").alias("rid")] if rid else []), *(stringified(f).alias(f"c{i}") for i, f in enumerate(fields)))
    return Table([f.name for f in fields], cells if rid else number_rows(cells).select("rid", *(f"c{i}" for i in range(len(fields)))))


def cleaned_name(name: str) -> str:
    """What a cleaned copy of a file is called."""
    return re.sub(r"\.[^.]+$", "", name) + ".cleaned.csv"


def quoted(cell: str, delimiter: str = ",") -> str:
    need = any(x in cell for x in (delimiter, '"', "\n", "\r", "\ufeff")) or cell[:1] == " " or cell[-1:] == " "
    return '"' + cell.replace('"', '""') + '"' if need else cell


def to_csv(table: Table) -> str:
    """Header and rows with \\n between lines, quoted only where needed, no line break at the end."""
    return "\n".join(",".join(quoted(c) for c in r) for r in [table.headers, *table.rows()])


def write_csv(table: Table, path: str, files: int | None = None) -> None:
    """The table as CSV files in row order (as many as tasks, or about `files`), each with the header; cells that need it are quoted."""
    ordered = table.df.orderBy("rid") if files is None else table.df.repartitionByRange(files, "rid").sortWithinPartitions("rid")
    rows = ordered.select(*table.columns)
    headers = table.headers

    def headed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([h], pa.string()) for h in headers], names)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    names = table.columns
    # Headers may repeat, which a frame's writer does not take: they go in as each file's first row.
    out = rows.mapInArrow(headed_rows, ", ".join(f"{n} string" for n in names)) if headers else rows
    out.write.options(header=False, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
