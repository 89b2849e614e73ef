"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans: digit groups of any grouping, spelled-out mail
addresses, IPv6 addresses, national numbers and account numbers. Boosted trees, trained here in
numpy on generated examples, judge each by its format and by the words beside it; a threshold for
each kind, calibrated on held-out examples, selects the spans. Exact base rules (mail, IPv4, card,
phone) run first; their spans always stay and no candidate may overlap them.

Nulls and empty texts have no spans, an empty table gives an empty one. All work is within a row and
grows with the length of its text and the sorting of its candidates; repeated rows give equal
results. Of overlapping candidates the one with the greatest margin stays; ties: the one that starts
first, then the kind that comes first. Only the key and the text of a table are read, so further
columns may have any name.
"""

from __future__ import annotations

import functools
import re
import string
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from .spans import Span, span_rows

KINDS = ["email", "ip", "card", "phone"]
EXTRA = ["email_spelled", "ipv6", "national_id", "iban", "phone_local", "card_other"]
ORDER = {k: i for i, k in enumerate(KINDS + EXTRA)}
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Share of selected held-out examples that must be right, by the calibrated thresholds.
PRECISION = 0.995


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """The regular expression's leftmost matches, found from each @ so that long runs cost no more than their length."""
    out, cut, at = [], 0, text.find("@")
    while at >= 0:
        run = text[cut:at]
        start = cut + len(run.rstrip(LOCAL))
        cut = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end(), True))
            cut = m.end()
        at = text.find("@", cut)
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text)
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span(), True))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span(), True))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span(), True))
    return out


# candidates

SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20{0,3}[\[(<]\x20?at\x20?[\])>]\x20{0,3}[A-Za-z0-9-]{1,63}(?:\x20{0,3}(?:[\[(<]\x20?dot\x20?[\])>]|\.)\x20{0,3}[A-Za-z0-9-]{1,63}){1,4}|[A-Za-z0-9._%+-]{1,64}\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63}){1,4}", re.I | re.A)
IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
GROUPS = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")
CONTEXT = [
    re.compile(x, re.I | re.A)
    for x in (r"\b(phone|tel|call|mobile|fax|cell|whatsapp|sms)", r"\b(card|visa|credit|debit|payment|cvv|amex)", r"\b(ssn|social|national id|tax id|passport|insurance)", r"\b(iban|account|bank|swift|bic)", r"\b(mail|contact|write|reach|email)", r"\b(ip|host|server|client|address|login)", r"\b(order|invoice|ref|version|id|no|number|page|isbn|sku|time|date|year)\b")
]


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text if " dot " in text or "at" in text and ("[" in text or "(" in text or "<" in text) else ""
    if low:
        out += [("email_spelled", *m.span()) for m in SPELLED.finditer(text)]
    if ":" in text:
        out += [("ipv6", *m.span()) for m in IPV6.finditer(text)]
    for m in GROUPS.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        if n <= 15:
            out.append(("phone_local", *m.span()))
        if n >= 13:
            out.append(("card_other", *m.span()))
    if out or "-" in text:
        out += [("national_id", *m.span()) for m in NATIONAL.finditer(text)]
    out += [("iban", *m.span()) for m in IBAN.finditer(text)]
    return out


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    digits = re.sub("[^0-9]", "", s)
    groups = [len(g) for g in re.findall("[0-9]+", s)] or [0]
    f = [float(kind == k) for k in EXTRA]
    f += [len(s), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1]]
    f += [s.count(c) for c in " -./(:"]
    f += [len({c for c in s if not c.isalnum()}), float(bool(digits) and luhn(digits)), float(kind == "iban" and iban_ok(s)), len(set(digits))]
    f += [float(before[-1:].isalnum()), float(before[-1:] in "#$€£=_"), float(after[:1].isalnum()), float(after[:1] in "%$€£_")]
    f += [float(bool(c.search(before))) for c in CONTEXT]
    f += [float(bool(CONTEXT[i].search(after))) for i in (0, 4)]
    return f


# boosted trees


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16) -> list:
    """Second-order gradient boosting of logistic loss; each tree is a list of (feature, cut) by node and leaf values."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    score = np.zeros(len(y))
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p) + 1e-9
        node = np.zeros(len(y), np.int64)
        tree = []
        for level in range(depth):
            splits = []
            for k in range(1 << level):
                here = np.flatnonzero(node == k)
                best = (0.0, 0, np.inf)
                if len(here) > 10:
                    gs, hs = g[here].sum(), h[here].sum()
                    for j, cut in enumerate(cuts):
                        if len(cut):
                            at = np.searchsorted(cut, x[here, j])
                            gl = np.cumsum(np.bincount(at, g[here], len(cut) + 1))[:-1]
                            hl = np.cumsum(np.bincount(at, h[here], len(cut) + 1))[:-1]
                            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                            i = int(np.argmax(gain))
                            if gain[i] > best[0] + 1e-9:
                                best = (float(gain[i]), j, float(cut[i]))
                splits.append((best[1], best[2]))
            tree.append(splits)
            node = _step(x, node, splits)
        leaf = np.zeros(1 << depth)
        np.subtract.at(leaf, node, g)
        weight = np.bincount(node, h, 1 << depth) + 1
        leaf = rate * leaf / weight
        score += leaf[node]
        trees.append((tree, leaf))
    return trees


def _step(x: np.ndarray, node: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    feature = np.array([s[0] for s in splits])
    cut = np.array([s[1] for s in splits])
    return 2 * node + (x[np.arange(len(x)), feature[node]] > cut[node])


def margins(trees: list, x: np.ndarray) -> np.ndarray:
    score = np.zeros(len(x))
    for tree, leaf in trees:
        node = np.zeros(len(x), np.int64)
        for splits in tree:
            node = _step(x, node, splits)
        score += leaf[node]
    return score


def examples(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """Generated (text, kind, start, end, label): personal data in its formats and contexts, and look-alikes."""
    r = np.random.default_rng(seed)

    def pick(*x: str) -> str:
        return x[r.integers(len(x))]

    def num(k: int) -> str:
        return "".join(map(str, r.integers(0, 10, k)))

    def word() -> str:
        return "".join(r.choice(list("abcdefghilmnoprstuv"), r.integers(2, 9)))

    out = []
    plain = lambda: " ".join(word() for _ in range(r.integers(2, 6)))
    while len(out) < n:
        kind, yes = EXTRA[r.integers(len(EXTRA))], int(r.integers(2))
        lead = plain() + " "
        if kind == "email_spelled":
            s = f"{word()}.{word()} [at] {word()} [dot] com" if r.integers(2) else f"{word()} at {word()} dot {pick('com', 'org', 'net')}"
            lead += pick("contact ", "mail me: ", "") if yes else ""
            if not yes:
                s = pick(f"{word()} at {word()} dot {word()}", f"{word()} (at) {word()}.{word()}")
        elif kind == "ipv6":
            s = ":".join(f"{r.integers(1, 65536):x}" for _ in range(8)) if yes else f"{num(2)}:{num(2)}:{num(2)}"
            lead += pick("host ", "") if yes else pick("time ", "at ", "")
        elif kind == "national_id":
            s = f"{num(3)}-{num(2)}-{num(4)}"
            lead += pick("ssn ", "social security number ", "SSN: ", "tax id ") if yes else pick("order ", "ref ", "version ", "invoice no ", "")
        elif kind == "iban":
            body = num(18)
            s = ("DE" + f"{98 - int(body + '131400') % 97:02d}" + body) if yes else "".join(r.choice(list("ABCDEFGH"), 2)) + num(18)
            lead += pick("iban ", "account ", "") if yes else pick("sku ", "")
            if r.integers(2):
                s = " ".join(s[i : i + 4] for i in range(0, len(s), 4))
        elif kind == "phone_local":
            s = pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}")
            lead += pick("call ", "phone ", "tel: ", "mobile ") if yes else pick("order ", "invoice ", "ref no ", "isbn ", "", "")
            if not yes and r.integers(2):
                s = pick(num(r.integers(7, 16)), f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(1)}.{num(3)}.{num(3)}")
        else:
            s = num(16) if r.integers(2) else " ".join(num(4) for _ in range(4))
            lead += pick("card ", "visa ", "credit card number ") if yes else pick("id ", "order ", "", "")
        out.append((lead + s + pick(" ", ". ", ", ") + plain(), kind, len(lead), len(lead) + len(s), yes))
    return out


@functools.cache
def model(n: int = 6000, seed: int = 7) -> tuple[list, dict[str, float]]:
    """Trees, and for each kind the least margin at which PRECISION of the held-out third is right."""
    rows = examples(n, seed)
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
    y = np.array([r[4] for r in rows])
    fit = np.arange(n) % 3 != 0
    trees = boost(x[fit], y[fit])
    m, cut = margins(trees, x[~fit]), {}
    kinds = np.array([r[1] for r in rows])[~fit]
    for k in EXTRA:
        own, right = m[kinds == k], y[~fit][kinds == k]
        order = np.argsort(-own)
        good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
        cut[k] = max(0.0, float(own[order][np.flatnonzero(good).max()])) if good.any() else float("inf")
    return trees, cut


def select(text: str, base: list[Span], trees: list, cut: dict[str, float]) -> list[Span]:
    """Of the candidates apart from base spans, those over their threshold; of overlapping ones the best."""
    found = candidates(text)
    if not found:
        return []
    taken = sorted((s[1], s[2]) for s in base)
    starts = [t[0] for t in taken]
    tops = list(accumulate((t[1] for t in taken), max))  # base spans of different kinds may nest

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return not i or tops[i - 1] <= a

    found = [c for c in found if free(c[1], c[2])]
    if not found:
        return []
    m = margins(trees, np.array([features(text, *c) for c in found]))
    ranked = sorted(((float(s), c) for s, c in zip(m, found, strict=True) if s >= cut[c[0]]), key=lambda z: (-z[0], z[1][1], ORDER[z[1][0]]))
    out: list[Span] = []
    begins: list[int] = []  # the chosen spans are apart, so both lists ascend
    ends: list[int] = []
    for _, (k, a, b) in ranked:
        i = bisect_left(begins, b)
        if not i or ends[i - 1] <= a:
            begins.insert(i, a)
            ends.insert(i, b)
            out.append((k, a, b, False))
    return out


class Finder:
    """All spans of a text; carries the trained trees to the workers."""

    def __init__(self) -> None:
        self.trees, self.cut = model()

    def __call__(self, text: str) -> list[Span]:
        base = base_spans(text)
        return sorted(base + select(text, base, self.trees, self.cut), key=lambda s: (s[1], ORDER[s[0]]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of every whole text."""
    return span_rows(docs, Finder(), key, text)


def redact(text: str, spans: list) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, cut = [], 0
    for s in spans:
        if s["start"] >= cut:
            out += [text[cut : s["start"]], f"<{s['kind'].upper()}>"]
        cut = max(cut, s["end"])
    return "".join([*out, text[cut:]])
