"""Scalar functions on cells, as pure Column expressions.

A cell is a string; blank means missing. White space is the class of ECMAScript, which Java's \\s
is not. All functions accept nulls. Lengths are in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, currency symbols, boolean words, month names.
WS = "\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
CURRENCY = "$₩€£¥¢₹₽元"
TRUE_TEXT, FALSE_TEXT = ("true", "yes", "y", "t"), ("false", "no", "n", "f")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
LINE = "[^\\n\\r\\u2028\\u2029]"


#: White space that cleaning would change inside a cell, and control characters.
ODD = f"[{WS}]{{2,}}|[\\u00A0\\u3000]|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
PAREN, PLAIN = f"^\\({LINE}*\\)\\z", "^([0-9]+(\\.[0-9]+)?|\\.[0-9]+)\\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once: nested functions stay linear in size. Such an expression has no
    generated code, so frames that parse many cells use the steps of staged.py instead."""
    return F.transform(F.array(value), body)[0]


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return F.coalesce(js_trim(c), F.lit("")) == ""


def normalize_whitespace(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, f"[{WS}]+", " "))


def has_control_chars(c: Column) -> Column:
    return c.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]")


def has_unusual_space(c: Column) -> Column:
    return c.rlike("[\\u00A0\\u3000]")


def needs_whitespace_trim(c: Column, trimmed: Column | None = None) -> Column:
    return (c != (js_trim(c) if trimmed is None else trimmed)) | c.rlike(ODD)


def has_currency_symbol(c: Column) -> Column:
    return c.rlike(f"[{CURRENCY}]")


def has_grouping_separator(c: Column) -> Column:
    return F.contains(c, F.lit(","))


# numbers: each step is a function of the columns before it, so that a frame can keep them apart


def parenthesized(t: Column) -> Column:
    return t.startswith("(") & t.rlike(PAREN)


def _unparenthesized(t: Column) -> Column:
    return F.when(parenthesized(t), js_trim(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)


def _unsigned(s: Column) -> Column:
    return F.translate(F.when(s.startswith("-") | s.startswith("+"), js_trim(s.substr(F.lit(2), F.length(s)))).otherwise(s), WS_CHARS + "%" + CURRENCY, "")


def _point(s: Column) -> Column:
    none = F.replace(s, F.lit(","), F.lit(""))
    decimal_comma = F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), "^([^,]*),", "$1.")
    both = F.when(s.rlike(",[^.]*\\z"), decimal_comma).otherwise(none)
    single = s.rlike("^[^,]*,[^,]*\\z") & ~s.rlike(",[^,]{3}\\z")
    grouped = s.rlike("^[^,]{1,3}(,[^,]{3})+\\z")
    return F.when(~F.contains(s, F.lit(",")), s).when(F.contains(s, F.lit(".")), both).when(~grouped & single, decimal_comma).otherwise(none)


def _full(point: Column) -> Column:
    return F.when(point.startswith("."), F.concat(F.lit("0"), point)).otherwise(point)


def _signed(trimmed: Column, body: Column, point: Column, full: Column) -> Column:
    negative = parenthesized(trimmed) != body.startswith("-")
    return F.when(point.rlike(PLAIN), F.when(negative & ~full.rlike("^0(\\.0+)?\\z"), F.concat(F.lit("-"), full)).otherwise(full))


def numeric_string(c: Column) -> Column:
    """The cell as a plain decimal string without loss of digits; null if it is no number."""
    return let(js_trim(c), lambda t: let(_unparenthesized(t), lambda b: let(_unsigned(b), lambda u: let(_point(u), lambda p: let(_full(p), lambda f: _signed(t, b, p, f))))))


def finite(n: Column) -> Column:
    return F.when(F.abs(n) < float("inf"), n)


def to_number(numeric: Column) -> Column:
    return let(numeric.try_cast("double"), finite)


def parse_number(c: Column) -> Column:
    return to_number(numeric_string(c))


def looks_numeric(c: Column) -> Column:
    return parse_number(c).isNotNull()


def is_integral(n: Column) -> Column:
    return F.coalesce(n == F.rint(n), F.lit(False))


def looks_integer(c: Column) -> Column:
    return let(parse_number(c), is_integral)


def parse_boolean(c: Column) -> Column:
    t = F.lower(js_trim(c))
    return F.when(t.isin(*TRUE_TEXT, "1"), True).when(t.isin(*FALSE_TEXT, "0"), False)


def looks_boolean(c: Column) -> Column:
    return parse_boolean(c).isNotNull()


def looks_boolean_text(c: Column) -> Column:
    return F.coalesce(F.lower(js_trim(c)).isin(*TRUE_TEXT, *FALSE_TEXT), F.lit(False))


# dates


TIME = f"^({LINE}+?)[ T]((?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?(?:[{WS}]*[AaPp][Mm])?)\\z"


def is_leap_year(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def valid_date(y: Column, m: Column, d: Column) -> Column:
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(is_leap_year(y), 29).otherwise(28)).otherwise(31)
    return y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= last)


YEAR_FIRST, YEAR_LAST = "^([0-9]{4})([-/.])([0-9]{1,2})\\2([0-9]{1,2})\\z", "^([0-9]{1,2})([-/.])([0-9]{1,2})\\2([0-9]{4})\\z"
WORD_FIRST, DAY_FIRST = "^[a-z]+ [0-9]{1,2} [0-9]{4}\\z", "^[0-9]{1,2} [a-z]+ [0-9]{4}\\z"


def month_number(name: Column) -> Column:
    out = F.when(name == "sept", 9)
    for i, names in enumerate(zip(MONTHS, LONG_MONTHS, strict=True)):
        out = out.when(name.isin(*dict.fromkeys(names)), i + 1)
    return out


def time_front(trimmed: Column) -> Column:
    """What stands before a time of day; blank without one."""
    return F.when(F.contains(trimmed, F.lit(":")), F.regexp_extract(trimmed, TIME, 1)).otherwise("")


def date_kind(date: Column) -> Column:
    """1 for the year first, 2 for the year last, 3 for what may hold a month's name; null for what is no date."""
    return F.when(date.rlike("[0-9]{4}"), F.when(date.rlike(YEAR_FIRST), 1).when(date.rlike(YEAR_LAST), 2).when(date.rlike("[A-Za-z]"), 3))


def date_words(date: Column, kind: Column) -> Column:
    return F.when(kind == 3, F.lower(js_trim(F.regexp_replace(date, f"[,{WS}]+", " "))))


def date_layout(kind: Column, words: Column) -> Column:
    """The kind, where 3 is a month's name and then the day and 4 the other way round."""
    return F.when(kind < 3, kind).when(words.rlike(WORD_FIRST), 3).when(words.rlike(DAY_FIRST), 4)


def date_separator(date: Column, layout: Column) -> Column:
    return F.when(layout == 1, F.substring(date, 5, 1)).when(layout == 2, date.substr(F.length(date) - 4, F.lit(1))).when(layout > 2, " ")


def date_part(date: Column, words: Column, layout: Column, separator: Column, i: int) -> Column:
    return F.split_part(F.when(layout < 3, date).otherwise(words), separator, F.lit(i))


def date_numbers(layout: Column, p1: Column, p2: Column, p3: Column) -> tuple[Column, Column, Column]:
    """Year, month and day; with the year last the first number as month, the second as day."""
    first = F.when(layout == 1, p2).when(layout == 2, p1)
    month = F.when(layout < 3, first.try_cast("int")).when(layout == 3, month_number(p1)).when(layout == 4, month_number(p2))
    day = F.when(layout == 1, p3).when(layout == 4, p1).otherwise(p2)
    return F.when(layout == 1, p1).otherwise(p3).try_cast("int"), month, day.try_cast("int")


def date_analysis(layout: Column, separator: Column, has_time: Column, y: Column, m: Column, d: Column, as_month: Column, as_day: Column) -> Column:
    """The struct of a date, components only where one reading is possible; as_month and as_day tell whether
    the first number is possible as the month and, with the year last, as the day."""
    last = layout == 2
    one = ~last | (as_month != as_day)
    swap = last & as_day
    shape = F.when(layout == 1, F.concat(F.lit("YYYY"), separator, F.lit("MM"), separator, F.lit("DD"))).when(last, F.concat(F.lit("DD"), separator, F.lit("MM"), separator, F.lit("YYYY"))).when(layout == 3, "MMM DD, YYYY").otherwise("DD MMM YYYY")
    found = F.struct(
        shape.alias("shape"),
        F.when(layout < 3, layout == 1).alias("year_first"),
        F.when(layout < 3, separator).otherwise("name").alias("separator"),
        (last & (m > 12)).alias("forces_day_first"),
        (last & (d > 12)).alias("forces_month_first"),
        has_time.alias("has_time"),
        F.when(one, y).alias("year"),
        F.when(one, F.when(swap, d).otherwise(m)).alias("month"),
        F.when(one, F.when(swap, m).otherwise(d)).alias("day"),
    )
    return F.when(as_month | as_day, found)


def possible(layout: Column, y: Column, m: Column, d: Column) -> tuple[Column, Column]:
    """Whether the first number is possible as the month, and with the year last as the day."""
    no = F.lit(False)
    return F.coalesce(layout.isNotNull() & valid_date(y, m, d), no), F.coalesce((layout == 2) & valid_date(y, d, m), no)


def analyze_date(c: Column) -> Column:
    def numbers(date: Column, timed: Column, words: Column, layout: Column, sep: Column) -> Column:
        parts = F.struct(*(date_part(date, words, layout, sep, i).alias(f"p{i}") for i in (1, 2, 3)))
        ymd = lambda p: F.struct(*(x.alias(n) for x, n in zip(date_numbers(layout, p["p1"], p["p2"], p["p3"]), "ymd", strict=True)))
        ok = lambda v: F.struct(*(x.alias(n) for x, n in zip(possible(layout, v["y"], v["m"], v["d"]), ("month", "day"), strict=True)))
        return let(parts, lambda p: let(ymd(p), lambda v: let(ok(v), lambda o: date_analysis(layout, sep, timed, v["y"], v["m"], v["d"], o["month"], o["day"]))))

    def laid_out(date: Column, timed: Column) -> Column:
        return let(date_kind(date), lambda k: let(date_words(date, k), lambda w: let(date_layout(k, w), lambda n: let(date_separator(date, n), lambda sep: numbers(date, timed, w, n, sep)))))

    return let(js_trim(c), lambda t: let(time_front(t), lambda f: let(F.when(f != "", js_trim(f)).otherwise(t), lambda d: laid_out(d, f != ""))))


def looks_date(c: Column) -> Column:
    return analyze_date(c).isNotNull()


def format_date(analysis: Column, target: str = "YYYY-MM-DD") -> Column:
    """An analysed date in the target form; null with a time of day or where the order is ambiguous. Years are not padded."""
    sep = "/" if target == "YYYY/MM/DD" else "-"
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(~analysis["has_time"], F.concat_ws(sep, analysis["year"].cast("string"), two(analysis["month"]), two(analysis["day"]))).cast("string")


def reformat_date(c: Column, target: str = "YYYY-MM-DD") -> Column:
    return let(analyze_date(c), lambda a: F.when(a["day"].isNotNull(), format_date(a, target)))


def cell_type(blank: Column, number: Column, boolean_text: Column, date: Column) -> Column:
    return F.when(blank, "empty").when(is_integral(number), "integer").when(number.isNotNull(), "decimal").when(boolean_text, "boolean").when(date, "date").otherwise("string")


def infer_cell_type(c: Column) -> Column:
    return let(c, lambda x: let(parse_number(x), lambda n: cell_type(is_blank(x), n, looks_boolean_text(x), looks_date(x))))


def is_type_compatible(expected: Column, found: Column) -> Column:
    numeric = ("integer", "decimal")
    return (expected == found) | (expected.isin(*numeric) & found.isin(*numeric))


def round3(x: Column) -> Column:
    """Three decimals, halves upwards."""
    return F.floor(x * 1000 + 0.5) / 1000


def normalize_cell(c: Column, trim_whitespace: bool, case_insensitive: bool) -> Column:
    out = normalize_whitespace(c) if trim_whitespace else c
    return F.lower(out) if case_insensitive else out


def bigrams(c: Column) -> Column:
    return F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def dice_similarity(a: Column, b: Column) -> Column:
    """Sorensen-Dice similarity of bigram multisets: 1 for equal strings, else 0 for those shorter than 2."""

    def score(x: Column, y: Column) -> Column:
        count = lambda g, of: F.size(F.filter(of, lambda v: v == g))
        both = F.reduce(F.array_distinct(x), F.lit(0), lambda n, g: n + F.least(count(g, x), count(g, y)))
        return 2 * both / (F.size(x) + F.size(y))

    return F.when(a == b, 1.0).otherwise(F.coalesce(let(F.struct(bigrams(a).alias("x"), bigrams(b).alias("y")), lambda s: score(s["x"], s["y"])), F.lit(0.0)))
