"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, URL schemes, account cues (both in any case), and
digits. A parser that looks only at an anchor's surroundings then finds the exact boundaries and validates them. Base
kinds (email, ip, card, phone) give exactly the leftmost non-overlapping matches of their patterns that pass validation;
more kinds (url, account) are added: `url` from a scheme to the next blank or quote; `account` after a cue, at most
FILLERS filler words and one line break: an IBAN whose check digits hold, digits (LEAST_DIGITS or more, with single
hyphens), or capitals and digits together as passports have them, each to its very end.

Defined cases: a null or empty text has no spans; positions count code points; other columns are ignored; repeated rows
give repeated results. Work grows with the text's length: each parser moves forward only, over blanks that no other cue's
parser reads, and over a run of digits once for each cue before it.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from verdigris.llm.spans import Span, found

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
# Anchors by what they start.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "compte", "cuenta")
# Words that may stand between a cue and its number.
BETWEEN = frozenset("no nr num number numbers numero número nummer id is are was my the our your ist est es de la le of code".split())
FILLERS, LEAST_DIGITS, LEAST_GROUPED, LEAST_MIXED, IBAN_SIZE = 4, 6, 8, 6, (15, 34)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DIGIT = frozenset("0123456789")
PHONE = frozenset(" ().0123456789-")
CAPITAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOW = {c: c + 32 for c in range(65, 91)}
_url = re.compile(r"(?:(?:https?|ftp)://|mailto:)[^\s\"'<>]+", re.I | re.A)
_word = re.compile(r"[^\W\d_]+")
_mixed = re.compile(r"[A-Z0-9]+")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("+", "plus"), *((d, "digit") for d in "0123456789"), *((s, "scheme") for s in SCHEMES), *((c, "cue") for c in CUES)]:
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


_anchors: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += 2 * int(d) - 9 * (d > "4")
    return total % 10 == 0


def email(t: str, at: int, done: int) -> tuple[int, int] | None:
    """The address around the at-sign, not reaching back over done."""
    a = at
    while a > done and t[a - 1] in LOCAL:
        a -= 1
    b, n, dots = at + 1, len(t), 0
    while b < n and t[b] in LABEL:
        b += 1
    if a == at or b == at + 1:
        return None
    while b + 1 < n and t[b] == "." and t[b + 1] in LABEL:
        b += 2
        while b < n and t[b] in LABEL:
            b += 1
        dots += 1
    return (a, b) if dots else None


def phone(t: str, at: int) -> tuple[int, int, bool] | None:
    """The number after the plus sign, and whether it has 10 to 15 digits."""
    n = len(t)
    if at + 1 >= n or t[at + 1] not in DIGIT:
        return None
    b = at + 2
    while b < n and t[b] in PHONE:
        b += 1
    while b > at + 3 and t[b - 1] not in DIGIT:
        b -= 1
    if b <= at + 3 or t[b - 1] not in DIGIT:
        return None
    return at, b, 10 <= sum(c in DIGIT for c in t[at:b]) <= 15


def runs(t: str, at: int, joiners: str) -> tuple[list[tuple[int, int]], int]:
    """From the digit at `at` the runs of digits with one joiner between each, and the end of the last."""
    out, a, n = [], at, len(t)
    while True:
        b = a
        while b < n and t[b] in DIGIT:
            b += 1
        out.append((a, b))
        if b + 1 < n and t[b] in joiners and t[b + 1] in DIGIT:
            a = b + 1
        else:
            return out, b


def _iban(t: str, at: int) -> int:
    """The end of the IBAN at `at`, its groups parted by single blanks or not at all; 0 without one that is valid."""
    n, b, compact, ends = len(t), at, [], []
    while b < n and len(compact) < IBAN_SIZE[1]:
        if t[b] in CAPITAL or t[b] in DIGIT:
            compact.append(t[b])
            b += 1
            if b == n or t[b] not in CAPITAL and t[b] not in DIGIT:
                ends.append((len(compact), b))
        elif t[b] == " " and len(compact) % 4 == 0 and compact:
            b += 1
        else:
            break
    for size, end in reversed(ends):
        x = "".join(compact[:size])
        if size >= IBAN_SIZE[0] and x[:2].isalpha() and x[2:4].isdigit() and not t[end : end + 1].isalnum() and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1:
            return end
    return 0


def account(t: str, at: int) -> tuple[int, int] | None:
    """The number after the cue that ends at `at`."""
    n, b, fillers, lines, marks = len(t), at, 0, 0, 0
    if t[b : b + 1] in ("s", "S"):  # accounts
        b += 1
    if t[b : b + 1].isalnum() or t[b : b + 1] == "_":
        return None
    while b < n and t[b] not in DIGIT:
        if t[b] in " \t\r":
            b += 1
        elif t[b] == "\n" and not lines:
            lines, b = 1, b + 1
        elif t[b] in ":=#.-*" and marks < 4:
            marks, b = marks + 1, b + 1
        elif t[b] in CAPITAL and (e := _iban(t, b) or _mixed_end(t, b)):
            return b, e
        elif (m := _word.match(t, b, b + 8)) and m[0].lower() in BETWEEN and fillers < FILLERS:
            fillers, b = fillers + 1, m.end()
        else:
            return None
    if b >= n:
        return None
    parts, e = runs(t, b, "-")
    if not t[e : e + 1].isalnum() and t[e : e + 1] != "_" and sum(y - x for x, y in parts) >= LEAST_DIGITS:
        return b, e
    if len(parts) == 1:  # too short by itself: groups that single blanks part
        parts, e = runs(t, b, " -")
        if not t[b - 1].isalnum() and all(y - x > 1 for x, y in parts) and sum(y - x for x, y in parts) >= LEAST_GROUPED and not t[e : e + 1].isalnum() and t[e : e + 1] != "_":
            return b, e
    return (b, e) if (e := _mixed_end(t, b)) else None


def _mixed_end(t: str, at: int) -> int:
    """The end of capitals and digits that stand together, of which most are digits; 0 otherwise."""
    m = _mixed.match(t, at)
    e = m.end() if m else at
    if e - at < LEAST_MIXED or t[e : e + 1].isalnum() or t[e : e + 1] == "_" or 2 * sum(c in DIGIT for c in m[0]) <= e - at:
        return 0
    return e


def find(t: str) -> list[Span]:
    if not _anchors:
        _anchors.append(_automaton())
    out: list[Span] = []
    mail = call = dotted = dashed = link = named = 0  # ends of what was matched last
    low = t.lower()
    for end, (kind, size) in _anchors[0].iter(low if len(low) == len(t) else t.translate(_LOW)):
        at = end - size + 1
        if kind == "digit":
            if at >= dotted:  # each stretch of digits and dots is parsed once, at its first digit
                parts, dotted = runs(t, at, ".")
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    if all(int(t[a:b].lstrip("0")[:4] or 0) <= 255 for a, b in four):
                        out.append(("ip", four[0][0], four[3][1]))
            if at >= dashed:
                parts, dashed = runs(t, at, " -")
                digits = "".join(t[a:b] for a, b in parts)
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, dashed))
        elif kind == "at":
            if at >= mail and (m := email(t, at, mail)):
                out.append(("email", *m))
                mail = m[1]
        elif kind == "plus":
            if at >= call and (p := phone(t, at)):
                call = p[1]
                if p[2]:
                    out.append(("phone", p[0], p[1]))
        elif kind == "scheme":
            if at >= link and (u := _url.match(t, at)):
                link = u.end()
                out.append(("url", at, len(t[at:link].rstrip(".,;:!?)")) + at))
        elif end >= named and not (at and t[at - 1].isalnum()) and (a := account(t, end + 1)):
            out.append(("account", *a))
            named = a[1]
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    return found(docs, find, BASE, KINDS, text)
