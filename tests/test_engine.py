import pytest

from tabsift.api import *  # noqa: F403

ORDERS = "\n".join(
    [
        "order_id,customer,order_date,qty,unit_price,subtotal,tax,total,status",
        "1001,Alice,2024-01-05,2,500,1000,100,1100,paid",
        '1002,Bob,01/06/2024,1,"1,200","1,200",120,1320,paid',
        "1001,Alice,2024-01-05,2,500,1000,100,1100,paid",
        "1003, Alice ,2024-01-07,3,300,900,90,990,pending",
        "1004,Carol,2024-01-08,5,200,1000,100,1200,paid",
        "1005,Dave,2024/01/09,1,150,150,15,165,shipped",
        "1006,Eve,2024-01-10,2,250,500,50,,paid",
        "1007,Frank,2024-01-11,1,1000,1000,100,1100,unknown",
    ]
)
RULES = Options(integrity=Integrity(sum_checks=[SumCheck(["subtotal", "tax"], "total")], referential_checks=[ReferentialCheck("status", ["paid", "pending", "shipped", "cancelled"])]))
BANK = "date,description,amount,balance\n2024-03-01,Opening balance,0,1000\n2024-03-02,Coffee shop,-5,995\n2024-03-03,Salary,2000,2995\n2024-03-05,Rent payment,-800,2200\n2024-03-06,Refund,50,2250\n"


def table(spark, headers, *rows):
    return table_from_rows(spark, headers, rows)


def found(spark, headers, rows, options=None):
    return {(i.type, i.column_name): i for i in analyze_table(table(spark, headers, *rows), options, rows=True).issues}


@pytest.fixture(scope="module")
def golden(spark):
    return clean_and_report(parse_csv(spark, ORDERS), engine=RULES, rows=True)


def test_golden_issues(golden):
    got = [(i.type, i.column_name, i.rows) for i in golden.before.issues]
    assert got == [
        ("exact_duplicate_row", None, [0, 2]),
        ("whitespace_format", "customer", [3]),
        ("inconsistent_date_format", "order_date", list(range(8))),
        ("inconsistent_number_format", "unit_price", list(range(8))),
        ("inconsistent_number_format", "subtotal", list(range(8))),
        ("statistical_outlier", "qty", [4]),
        ("statistical_outlier", "subtotal", [5]),
        ("statistical_outlier", "tax", [5]),
        ("missing_value", "total", [6]),
        ("statistical_outlier", "total", [1, 5]),
        ("sum_mismatch", None, [4]),
        ("referential_violation", "status", [7]),
    ]
    assert golden.before.summary == {"total_issues": 12, "by_category": {"duplicate": 1, "format": 4, "outlier": 5, "integrity": 2}, "by_severity": {"error": 2, "warning": 4, "info": 6}}
    bounds = next(i.data["bounds"] for i in golden.before.issues if i.column_name == "qty")
    assert bounds == {"lower": -0.875, "upper": 4.125}


def test_golden_clean(golden):
    assert golden.clean.summary == {"cells_changed": 4, "rows_removed": 1, "by_fixer": {"whitespace": 1, "number_format": 2, "date_format": 1, "duplicate": 1}}
    assert golden.after.row_count == 7
    assert [(i.type, i.rows) for i in golden.after.issues if i.type == "statistical_outlier"] == [("statistical_outlier", [3]), ("statistical_outlier", [4]), ("statistical_outlier", [4]), ("statistical_outlier", [4])]
    assert golden.after.summary["total_issues"] == 8
    assert to_csv(golden.clean.table).splitlines()[2] == "1002,Bob,01/06/2024,1,1200,1200,120,1320,paid"


def test_report_text(golden):
    text = render_report(golden)
    assert "- 행: 8 → 7 (중복 1건 제거)" in text and "| 5 | order_date | `2024/01/09` | `2024-01-09` | date_format |" in text
    assert "외 2건" in render_report(golden, 2)
    assert [localize(i, "ko") for i in golden.before.issues][0] == "완전히 동일한 행 2개(중복)"
    rules = render_rules(Integrity(sum_checks=[SumCheck(["a", "<b>"], "t")]), ["a"])
    assert rules == "<ul><li class=unknown>a + &lt;b&gt; = t</li></ul>"
    assert "<li>2 = 0</li>" in render_changes(golden.clean) and "<p>+3</p>" in render_changes(golden.clean, 1)
    assert cleaned_name("a.b.csv") == "a.b.cleaned.csv"
    page = render_html(golden.before)
    assert page.index("sum_mismatch") < page.index("whitespace_format") < page.index("statistical_outlier")


def test_bank(spark):
    r = analyze_csv(spark, BANK, Options(integrity=Integrity(balance_checks=[BalanceCheck("amount", "balance")])))
    assert [i.rows for i in r.issues if i.type == "balance_mismatch"] == [[3]]


def test_balance_keeps_previous(spark):
    rows = [("100", "1100"), ("x", "garbage"), ("100", "1200")]
    options = Options(integrity=Integrity(balance_checks=[BalanceCheck("a", "b", opening=1000)]))
    assert ("balance_mismatch", None) not in found(spark, ["a", "b"], rows, options)
    first = Options(integrity=Integrity(balance_checks=[BalanceCheck("a", "b")]))
    assert found(spark, ["a", "b"], [("x", "5"), ("1", "9"), ("1", "11")], first)[("balance_mismatch", None)].rows == [2]


def test_sums(spark):
    rule = Options(integrity=Integrity(sum_checks=[SumCheck(["qty", "tax"], "total", label="L")]))
    i = found(spark, ["qty", "tax", "total"], [("100", "10", "110"), ("50", "5", "60"), ("1", "x", "9"), ("1", "1", "")], rule)[("sum_mismatch", None)]
    assert i.rows == [1, 2] and i.data["anyParseFailure"] and i.data["examples"][0] == {"row": 1, "expected": 55, "actual": 60, "diff": -5}
    assert i.message == "L: sum of [qty, tax] does not equal 'total' in 2 row(s)"
    assert ("sum_mismatch", None) not in found(spark, ["a", "b", "t"], [("0.1", "0.2", "0.3")], Options(integrity=Integrity(sum_checks=[SumCheck(["a", "b"], "t")])))
    missing = found(spark, ["a"], [("1",)], Options(integrity=Integrity(sum_checks=[SumCheck(["a", "q"], "t")])))
    assert missing[("integrity_unknown_column", None)].data["missing"] == ["q", "t"]


def test_references(spark):
    rule = Options(integrity=Integrity(referential_checks=[ReferentialCheck("s", ["active"], allow_empty=True)]))
    assert ("referential_violation", "s") not in found(spark, ["s"], [("active ",), (" ",)], rule)
    other = Options(integrity=Integrity(referential_checks=[ReferentialCheck("s", "r", allow_empty=False)]))
    assert found(spark, ["s", "r"], [("a", "a"), ("b", ""), ("", "c")], other)[("referential_violation", "s")].rows == [1, 2]


def test_discovery(spark):
    rows = [("10", "5", "15"), ("20", "3", "23"), ("100", "50", "150"), ("7", "8", "15")]
    on = Options(integrity=Integrity(discover_sum_relationships=True))
    i = found(spark, ["a", "b", "c"], rows, on)[("discovered_sum_relationship", None)]
    assert i.message == "Column 'c' appears to equal 'a' + 'b'" and i.data["matchRatio"] == 1
    wide = found(spark, [f"x{k}" for k in range(13)], [tuple("1" * 13), tuple("2" * 13)], on)
    assert wide[("discovered_sum_relationship", None)].data == {"skipped": True, "numericColumnCount": 13, "limit": 12}


def test_duplicates(spark):
    r = found(spark, ["name"], [("New York",), ("new york",), ("New　York",), ("New  York",), ("x",)])
    assert r[("exact_duplicate_row", None)].rows == [0, 1, 2, 3]
    near = Options(duplicates=Duplicates(near=Near(threshold=0.8)))
    i = found(spark, ["name"], [("Jonathan Smith",), ("Jonathon Smith",)], near)[("near_duplicate_row", None)]
    assert i.rows == [0, 1] and i.data == {"similarity": 0.846} and i.message.endswith("(similarity 0.846)")
    both = analyze_table(table(spark, ["n"], ("Catherine",), ("Catherine",), ("Katherine",)), Options(duplicates=Duplicates(near=Near(threshold=0.6))), rows=True).issues
    assert [x.rows for x in both if x.type == "near_duplicate_row"] == [[0, 2], [1, 2]]
    ignored = Options(duplicates=Duplicates(ignore_columns=["id"]))
    assert found(spark, ["id", "n"], [("1", "a"), ("2", "a")], ignored)[("exact_duplicate_row", None)].rows == [0, 1]


def test_reports_without_row_lists(spark):
    t = table(spark, ["n", "w"], *[("Catherine", " x")] * 70, *[("Katherine", "y")] * 3, ("Bob", "z"), ("Bob", "z"))
    options = Options(duplicates=Duplicates(near=Near(threshold=0.6, key_columns=["n"])))
    found = {i.type: i for i in reversed(analyze_table(t, options).issues)}
    assert found["exact_duplicate_row"].rows is None and found["exact_duplicate_row"].count == 70
    assert found["exact_duplicate_row"].data == {"count": 70, "keepRow": 0, "duplicateRows": list(range(1, 50))}
    assert [i.rows for i in analyze_table(t, options).issues if i.type == "near_duplicate_row"] == [[0, 70]]
    assert localize(found["whitespace_format"], "ko") == '컬럼 "w"에 공백/제어문자 정리가 필요한 셀 70개'
    assert "<td>70</td>" in render_html(analyze_table(t, options))
    listed = [i.rows for i in analyze_table(t, options, rows=True).issues if i.type == "near_duplicate_row"]
    assert len(listed) == 210


def test_reference_lists_are_trimmed_like_cells(spark):
    rule = Options(integrity=Integrity(referential_checks=[ReferentialCheck("s", ["a", "\ufeffb", "\x1cc"])]))
    assert found(spark, ["s"], [("a",), ("b",), ("c",)], rule)[("referential_violation", "s")].rows == [2]


def test_near_guard(spark):
    rows = [(f"{i * 7919 % 10007:05d}{i}",) for i in range(2001)]
    assert ("near_duplicate_skipped", None) in found(spark, ["n"], rows)


def test_near_pairs_match_brute_force(spark):
    import random
    from collections import Counter

    from tabsift.operators.duplicates import near_pairs

    r = random.Random(4)
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(words)), "rid long, s string")
    want = {}
    for i, a in enumerate(words):
        for j in range(i + 1, len(words)):
            b = words[j]
            if a != b and min(len(a), len(b)) > 1:
                x, y = (Counter(w[k : k + 2] for k in range(len(w) - 1)) for w in (a, b))
                s = 2 * sum((x & y).values()) / (len(a) + len(b) - 2)
                if 0.7 <= s < 1:
                    want[i, j] = round(s, 9)
    assert {(p.i, p.j): round(p.similarity, 9) for p in near_pairs(rows, 0.7).collect()} == want


def test_date_order(spark):
    i = found(spark, ["d"], [("02/25/2024",), ("25/02/2024",)])[("ambiguous_date_order", "d")]
    assert i.rows == [1, 0] and i.severity == "error"
    mixed = found(spark, ["c"], [("a",), ("b",), ("c",), ("2024-01-05",), ("Jan 5 2024",)])
    assert mixed[("inconsistent_date_format", "c")].rows == [3, 4]


def test_example_cap(spark):
    i = found(spark, ["v"], [(f" v{k}",) for k in range(60)])[("whitespace_format", "v")]
    assert len(i.rows) == 60 and [e["row"] for e in i.data["examples"]] == list(range(50))


def test_outliers(spark):
    i = found(spark, ["v"], [("5",)] * 9 + [("100",)], Options(outliers=Outliers(z_score_threshold=2)))[("statistical_outlier", "v")]
    assert i.rows == [9] and i.data["method"] == "zscore"
    m = found(spark, ["v"], [("1",), ("2",), ("3",), ("x",)])[("type_mismatch", "v")]
    assert m.data == {"expectedType": "integer", "examples": [{"row": 3, "value": "x", "found": "string"}]}
    e = found(spark, ["v", "w"], [("1", ""), ("2", " ")])
    assert e[("empty_column", "w")].rows == [0, 1]
    r = found(spark, ["v"], [("1",), ("x",), ("9",)], Options(outliers=Outliers(ranges=[Range("v", 2, None), Range("nope", 0, 1)])))
    assert r[("range_violation", "v")].rows == [0]


def test_profiles(spark):
    p = profiles(table(spark, ["n", "b", "m"], ("1", "yes", "1"), ("2", "no", "x"), ("3", "T", "2"), ("10", "f", "y")))
    assert p[0].type == "integer" and p[0].numeric["q1"] == 1.75 and p[0].numeric["q3"] == 4.75 and p[0].distinct_count == 4
    assert (p[1].type, p[1].type_confidence) == ("boolean", 1) and p[2].type == "integer"


def test_quantiles_are_exact(spark):
    import random

    import numpy as np

    from tabsift.operators.cells import cells, quantiles

    r = random.Random(3)
    for n in (1, 2, 3, 4, 7, 100, 1501):
        values = [r.choice([r.randint(0, 40), round(r.random() * 1000, 3)]) for _ in range(n)]
        t = table(spark, ["a", "b"], *[(str(v), str(i)) for i, v in enumerate(values)])
        got = {x.col: x.q for x in quantiles(cells(t)).collect()}
        assert got[0] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75])) and got[1] == pytest.approx(np.quantile(range(n), [0.25, 0.5, 0.75]))


def test_clean_keeps_what_is_unsafe(spark):
    c = clean_table(table(spark, ["d", "e"], ("05/06/2024", ""), ("07/08/2024", " "), ("a\x01", "")))
    assert c.summary["cells_changed"] == 0 and c.table.rows()[2] == ["a\x01", ""]
    order = clean_table(table(spark, ["id", "n"], ("1", "Alice"), ("2", "Bob"), ("1", " Alice ")))
    assert [(r.row, r.kept_row) for r in order.removals.collect()] == [(2, 0)]


def test_empty_tables(spark):
    assert analyze_csv(spark, "").issues == []
    assert analyze_csv(spark, "a,b\n").issues == []
    empty = clean_and_report(parse_csv(spark, "a,b\n"), engine=RULES)
    assert empty.after.row_count == 0 and to_csv(empty.clean.table) == "a,b"


def test_partitions_do_not_matter(spark):
    t = parse_csv(spark, ORDERS)
    mixed = Table(t.headers, t.df.repartition(7))
    assert analyze_table(mixed, RULES, rows=True).issues == analyze_table(t, RULES, rows=True).issues
