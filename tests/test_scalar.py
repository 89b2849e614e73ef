import pytest
from pyspark.sql import functions as F

from tabsift.functions import scalar as S

NUMBERS = [
    ("$1,234.50", "1234.50"), ("1.234,56", "1234.56"), ("(1,234)", "-1234"), ("-$5", "-5"), ("$-5", None), ("(-5)", "5"), ("--5", None), ("5-", None),
    ("50%", "50"), ("12,5", "12.5"), (",5", "0.5"), (",500", "500"), ("1,2,3", "123"), ("1,23,456", "123456"), ("1234,567", "1234567"), ("12,", None),
    ("1.", None), ("1.000.000", None), ("12.000", "12.000"), ("1 234", "1234"), ("1e5", None), ("1,234.56,7", None), ("USD 5", None), ("-0.00", "0.00"),
    ("007", "007"), ("", None), (None, None), ("  ", None), ("٣", None), (".5", "0.5"), ("-.5", "-0.5"), ("()", None), ("+ 5", "5"), (" 5　", "5"), ("9" * 400, "9" * 400),
]
DATES = [  # text, shape, forces day first, forces month first, time, (y, m, d)
    ("2024-01-05", "YYYY-MM-DD", False, False, False, (2024, 1, 5)),
    ("2024/1/5", "YYYY/MM/DD", False, False, False, (2024, 1, 5)),
    ("2024.01.15", "YYYY.MM.DD", False, False, False, (2024, 1, 15)),
    ("2024-02-30", None, None, None, None, None),
    ("2023-02-29", None, None, None, None, None),
    ("2024-02-29 13:45", "YYYY-MM-DD", False, False, True, (2024, 2, 29)),
    ("2024-02-29T25:00", None, None, None, None, None),
    ("25/02/2024", "DD/MM/YYYY", True, False, False, (2024, 2, 25)),
    ("02/25/2024", "DD/MM/YYYY", False, True, False, (2024, 2, 25)),
    ("05/05/2024", "DD/MM/YYYY", False, False, False, None),
    ("13/13/2024", None, None, None, None, None),
    ("01-02/2024", None, None, None, None, None),
    ("Jan 5, 2024", "MMM DD, YYYY", False, False, False, (2024, 1, 5)),
    ("sept 31 2024", None, None, None, None, None),
    ("5 SEPTEMBER 2024", "DD MMM YYYY", False, False, False, (2024, 9, 5)),
    ("Janu 5 2024", None, None, None, None, None),
    ("0000-01-01", None, None, None, None, None),
    ("", None, None, None, None, None),
    (None, None, None, None, None, None),
]


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numeric_string(spark):
    assert column(spark, [n[0] for n in NUMBERS], S.numeric_string) == [n[1] for n in NUMBERS]


def test_parse_number_rejects_infinity(spark):
    assert column(spark, ["9" * 400, "1,5", "x"], S.parse_number) == [None, 1.5, None]
    assert column(spark, ["1.0", "1.5", "x", None], S.looks_integer) == [True, False, False, False]


def test_dates(spark):
    found = column(spark, [d[0] for d in DATES], S.analyze_date)
    for (text, shape, day, month, timed, ymd), a in zip(DATES, found, strict=True):
        assert (a and a.shape) == shape, text
        if a:
            assert (a.forces_day_first, a.forces_month_first, a.has_time) == (day, month, timed), text
            assert ((a.year, a.month, a.day) if a.day is not None else None) == ymd, text


@pytest.mark.parametrize(("text", "out"), [("1/2/2024", None), ("25/2/2024", "2024-02-25"), ("2024/1/9", "2024-01-09"), ("2024-01-09 10:00", None), ("Mar 5 987", None), ("0987-01-02", "987-01-02"), ("x", None)])
def test_reformat(spark, text, out):
    assert column(spark, [text], S.reformat_date) == [out]


def test_white_space(spark):
    values = ["a", " a", "a  b", "a b", "a\tb", "a\x01b", "　", "", None, "a\u0085"]
    assert column(spark, values, S.needs_whitespace_trim)[:8] == [False, True, True, True, False, True, True, False]
    assert column(spark, values, S.is_blank) == [False] * 6 + [True, True, True, False]
    assert column(spark, ["  a 　 b\n"], S.normalize_whitespace) == ["a b"]


def test_types(spark):
    values = ["1", "1.0", "1.5", "yes", "1/2/2024", "2024.01", "x", " ", "T", "0"]
    assert column(spark, values, S.infer_cell_type) == ["integer", "integer", "decimal", "boolean", "date", "decimal", "string", "empty", "boolean", "integer"]
    assert column(spark, ["Yes", "0", "maybe", None], S.parse_boolean) == [True, False, None, None]


def test_round3_rounds_halves_up(spark):
    assert column(spark, ["0.8765", "0.12345"], lambda c: S.round3(c.cast("double"))) == [0.877, 0.123]


def test_dice(spark):
    pairs = [("Jonathan Smith", "Jonathon Smith", 22 / 26), ("aaa", "aa", 2 / 3), ("a", "a", 1.0), ("a", "b", 0.0), ("ab", "cd", 0.0), ("", "ab", 0.0)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, s double")
    got = rows.select("s", S.dice_similarity(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == pytest.approx([r.s for r in got])
