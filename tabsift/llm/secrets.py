"""Secret scans by multipart credential linking.

Base spans: assignments to secret names, access key identifiers and long hex runs. Beside them the
text has weak parts: other identifiers, strings of high entropy, and endpoints. A weak part alone
is no finding; an interval join of the parts inside a scope (a block of text between blank lines, of
any length) reports those whose complement is there: an identifier with a secret, a secret with an
identifier or an endpoint, an endpoint with both.

Nulls and empty texts have no spans. All work is within a row, linear in the text's length but for
the sorting of its parts; repeated rows give equal results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame

from .spans import Span, span_rows

KINDS = ["assign", "access", "hex"]
WEAK = ["access_id", "secret", "endpoint"]
ORDER = {k: i for i, k in enumerate(KINDS + WEAK)}
#: The least entropy in bits a character of a weak secret.
ENTROPY = 3.6

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~/-]*)?|(?<![A-Za-z0-9.@-])(?:[a-z0-9-]{1,63}\.){1,5}(?:com|net|org|io|dev|cloud|internal|local)(?::[0-9]{1,5})?(?![A-Za-z0-9-])")
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str) -> list[Span]:
    out = [("assign", m.start(), m.end(), True) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), True) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), True) for m in HEX.finditer(text)]
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def weak_parts(text: str) -> list[Span]:
    """Identifiers (upper case and digits), strings of high entropy in mixed classes, endpoints."""
    out = []
    for m in LONG.finditer(text):
        s = m[0]
        if not any(c.isdigit() for c in s):
            continue
        if re.fullmatch("[A-Z0-9]{16,32}", s):
            if any(c.isalpha() for c in s):
                out.append(("access_id", *m.span(), False))
        elif len(s) >= 20 and s != s.lower() and s != s.upper() and entropy(s) >= ENTROPY:
            out.append(("secret", *m.span(), False))
    if "." in text:
        out += [("endpoint", *m.span(), False) for m in ENDPOINT.finditer(text)]
    return out


def _near(a: Span, starts: list[int], ends: list[int], edges: list[int]) -> bool:
    """Whether an interval of a sorted list, whose ends are the farthest so far, is in the scope of a."""
    k = bisect_right(edges, a[1])
    i = bisect_right(ends, edges[k - 1] if k else 0)
    return i < len(starts) and (k == len(edges) or starts[i] < edges[k])


def link(base: list[Span], weak: list[Span], edges: list[int]) -> list[Span]:
    """The weak parts with a complement in their scope."""
    weak = _apart(weak, base)

    def sides(*kinds: str) -> tuple[list[int], list[int]]:
        rows = sorted((s[1], s[2]) for s in base + weak if s[0] in kinds)
        ends, top = [], 0
        for _, e in rows:  # nested spans: the farthest end so far keeps the list sorted
            top = max(top, e)
            ends.append(top)
        return [r[0] for r in rows], ends

    ids, keys, ends = sides("access", "access_id"), sides("assign", "hex", "secret"), sides("endpoint")
    out = []
    for w in weak:
        has_id, has_key = _near(w, *ids, edges), _near(w, *keys, edges)
        if {"access_id": has_key, "secret": has_id or _near(w, *ends, edges), "endpoint": has_id and has_key}[w[0]]:
            out.append(w)
    return out


def _apart(weak: list[Span], base: list[Span]) -> list[Span]:
    """The weak parts that overlap no base span."""
    rows = sorted((b[1], b[2]) for b in base)
    ends, top = [], 0
    for _, e in rows:
        top = max(top, e)
        ends.append(top)
    return [w for w in weak if not ((i := bisect_left(ends, w[1] + 1)) < len(rows) and rows[i][0] < w[2])]


def find(text: str) -> list[Span]:
    base, weak = base_spans(text), weak_parts(text)
    if weak:
        weak = link(base, weak, [m.start() for m in BLANK.finditer(text)])
    return sorted(base + weak, key=lambda s: (s[1], ORDER[s[0]]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of every whole text."""
    return span_rows(docs, find, key, text)
