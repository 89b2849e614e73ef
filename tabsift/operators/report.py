"""Reports as text: Markdown and HTML, in English or Korean."""

from __future__ import annotations

import re
from html import escape

from ..plans.model import Integrity, Issue, Report
from .clean import in_log_order

#: Categories that cleaning leaves to a person.
MANUAL = ("integrity", "outlier")
#: Fixed values, as are the texts of render_report: Korean messages by issue type; {n} rows, {col} column name, the rest from data.
KOREAN = {
    "exact_duplicate_row": "완전히 동일한 행 {n}개(중복)",
    "near_duplicate_row": "유사 중복 행 (유사도 {similarity})",
    "near_duplicate_skipped": "행이 많아 유사 중복 검사를 건너뜀",
    "whitespace_format": '컬럼 "{col}"에 공백/제어문자 정리가 필요한 셀 {n}개',
    "inconsistent_date_format": '컬럼 "{col}"에 날짜 포맷이 {n_formats}종 섞여 있음{formats}',
    "ambiguous_date_order": '컬럼 "{col}"에 월/일 순서가 충돌하는 날짜가 있음',
    "inconsistent_number_format": '컬럼 "{col}"에 숫자 표기(통화·천단위)가 혼용됨',
    "missing_value": '컬럼 "{col}"에 빈 값 {n}개',
    "empty_column": '컬럼 "{col}"이(가) 전부 비어 있음',
    "type_mismatch": '컬럼 "{col}"에 타입 불일치 셀 {n}개{expected}',
    "range_violation": '컬럼 "{col}"에 허용 범위를 벗어난 값 {n}개',
    "statistical_outlier": '컬럼 "{col}"에 통계적 이상치 {n}개',
    "sum_mismatch": "합계 불일치 {n}개 행 ({components} ≠ {total})",
    "balance_mismatch": "잔액 불일치 {n}개 행 ({balance})",
    "referential_violation": '컬럼 "{col}"에 허용되지 않은(참조에 없는) 값 {n}개',
    "discovered_sum_relationship": "합계 관계 자동발견: {total} = {components}",
}


def truncate(s: str, most: int = 24) -> str:
    return s if len(s) <= most else s[: most - 1] + "…"


def md_cell(s: str, most: int = 24) -> str:
    """Text that keeps a Markdown table whole."""
    return re.sub(r"[\r\n]+", " ", truncate(s, most).replace("|", "\\|"))


def localize(issue: Issue, locale: str = "en") -> str:
    """The message in a locale; types without a Korean text keep the English one."""
    if locale == "en" or issue.type not in KOREAN:
        return issue.message
    d = issue.data
    formats, expected = d.get("formats") or [], d.get("expectedType")
    return KOREAN[issue.type].format(
        n=issue.count,
        col=issue.column_name or "",
        similarity=d.get("similarity", "?"),
        n_formats=len(formats) or "여러",
        formats=f" ({', '.join(formats)})" if formats else "",
        expected=f" (예상: {expected})" if expected else "",
        components=" + ".join(d.get("components") or []) or ("구성요소" if issue.type == "sum_mismatch" else "두 컬럼"),
        total=d.get("total", "합계" if issue.type == "sum_mismatch" else "?"),
        balance=d.get("balance", "잔액"),
    )


def _capped(lines: list[str], total: int, most: int, more: str) -> list[str]:
    return lines[:most] + ([more.format(total - most)] if total > most else [])


def render_report(report, max_rows: int = 30) -> str:
    """The before/after report as Markdown; only max_rows rows of each log reach the driver."""
    before, after, s = report.before, report.after, report.clean.summary
    by = s["by_fixer"]
    b, a = before.summary["total_issues"], after.summary["total_issues"]
    lines = ["# 정제 리포트\n", "## 요약"]
    lines.append(f"- 행: {before.row_count} → {after.row_count} (중복 {s['rows_removed']}건 제거)")
    lines.append(f"- 자동 수정 셀: {s['cells_changed']}건 (공백 {by['whitespace']} · 숫자 {by['number_format']} · 날짜 {by['date_format']})")
    lines.append(f"- 검출 이슈: {b}건 → {a}건 (해결 {b - a}건)\n")
    if s["cells_changed"]:
        rows = in_log_order(report.clean.changes).limit(max_rows).collect()
        lines += ["## 자동 수정 내역", "> 행 번호는 원본 CSV 기준(0-based).", "", "| 행 | 컬럼 | before | after | 종류 |", "|---|---|---|---|---|"]
        lines += _capped([f"| {r.row} | {md_cell(r.column_name)} | `{md_cell(r.before)}` | `{md_cell(r.after)}` | {r.fixer} |" for r in rows], s["cells_changed"], max_rows, "| … | | | | 외 {}건 |")
        lines.append("")
    if s["rows_removed"]:
        rows = report.clean.removals.orderBy("row").limit(max_rows).collect()
        lines.append("## 제거된 중복 행")
        lines += _capped([f"- 행 {r.row} (행 {r.kept_row} 와 동일 → 제거)" for r in rows], s["rows_removed"], max_rows, "- … 외 {}건")
        lines.append("")
    manual = [i for i in after.issues if i.category in MANUAL]
    if manual:
        lines += ["## 수동 검토 필요 (자동 수정 대상 아님)", "| 종류 | 심각도 | 컬럼 | 내용 |", "|---|---|---|---|"]
        lines += _capped([f"| {i.type} | {i.severity} | {md_cell(i.column_name or '-')} | {md_cell(i.message, 60)} |" for i in manual], len(manual), max_rows, "| … | | | 외 {}건 |")
        lines.append("")
    return "\n".join(lines)


def by_severity(issues: list[Issue]) -> list[Issue]:
    """Errors first, then warnings, each in the order found."""
    return sorted(issues, key=lambda i: {"error": 0, "warning": 1, "info": 2}.get(i.severity, 9))


def shown_rows(rows: list[int] | None, locale: str = "en", count: int = 0) -> str:
    """How many rows, and the first of them; only the number where they are not listed."""
    if not rows:
        return "-" if not count else f"{count}개" if locale == "ko" else str(count)
    sample = ", ".join(map(str, rows[:5])) + ("…" if len(rows) > 5 else "")
    return f"{len(rows)}개 (행 {sample})" if locale == "ko" else f"{len(rows)} (rows {sample})"


def _escaped(s: object) -> str:
    return escape(str(s)).replace("&#x27;", "&#39;")


def render_rules(options: Integrity, headers: list[str]) -> str:
    """The integrity rules as HTML lists; rules that name a column the table lacks are marked."""
    lines = [(f"{' + '.join(s.components)} = {s.total}", [*s.components, s.total]) for s in options.sum_checks]
    lines += [(f"{b.balance} = previous {b.balance} + {b.amount}", [b.amount, b.balance]) for b in options.balance_checks]
    lines += [(f"{r.column} in {', '.join(r.references) if isinstance(r.references, list) else r.references if isinstance(r.references, str) else 'table'}", [r.column, *([r.references] if isinstance(r.references, str) else [])]) for r in options.referential_checks]
    items = "".join(f'<li{"" if set(names) <= set(headers) else " class=unknown"}>{_escaped(text)}</li>' for text, names in lines)
    return f"<ul>{items}</ul>"


def render_changes(clean, max_rows: int = 100) -> str:
    """The first changes and removals of a cleaning as HTML."""
    changes = in_log_order(clean.changes).limit(max_rows).collect()
    rows = "".join(f"<tr><td>{c.row}</td><td>{_escaped(c.column_name)}</td><td><code>{_escaped(c.before)}</code></td><td><code>{_escaped(c.after)}</code></td><td>{c.fixer}</td></tr>" for c in changes)
    more = clean.summary["cells_changed"] - len(changes)
    removed = "".join(f"<li>{r.row} = {r.kept_row}</li>" for r in clean.removals.orderBy("row").limit(max_rows).collect())
    return f"<table>{rows}</table>" + (f"<p>+{more}</p>" if more else "") + f"<ul>{removed}</ul>"


def render_html(report: Report, locale: str = "en") -> str:
    """Counts and the issues by severity as HTML; all cell text is escaped."""
    e = _escaped
    s = report.summary
    cards = "".join(f"<li>{e(k)}: {v}</li>" for k, v in [("total", s["total_issues"]), *s["by_severity"].items(), *s["by_category"].items()])
    rows = "".join(f"<tr><td>{e(i.severity)}</td><td>{e(i.category)}</td><td><code>{e(i.type)}</code></td><td>{e(i.column_name or '-')}</td><td>{e(shown_rows(i.rows, locale, i.count))}</td><td>{e(localize(i, locale))}</td></tr>" for i in by_severity(report.issues))
    return f"<section><p>{report.row_count} × {len(report.headers)}</p><ul>{cards}</ul></section><table>{rows}</table>"
