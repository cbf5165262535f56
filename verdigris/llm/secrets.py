"""Secrets by assignment-aware lexing.

A lexer cuts a text into strings (with prefixes, escapes, three quotes), words, operators, comment marks, brackets and
lines, as they are common to source code and to JSON, YAML, INI and environment files. At each assignment operator (=, :,
:=, =>, ?=, +=, ||=; not at comparisons) a parser reads the target on the left (bare, dotted, quoted, in a subscript, or
before a type) and the value on the right: strings that stand together or are joined, names, an unquoted run, or a PEM
block. Pairs with a sensitive target name and a plausible literal are scored. A name that an earlier pair bound, in a scope
(indentation, braces) that is still open, passes its literal on, so `k = "..."; api_key = k` reports the first literal.
Base kinds (assign, access, hex) give exactly the leftmost non-overlapping matches of their patterns; `literal` adds the
literals that scoring and propagation find, part by part where strings are joined.

Defined cases: a null or empty text has no spans; positions count code points; other columns are ignored; repeated rows
give repeated results. Strings, names and runs count whole, however long; a quote that nothing closes on its line is a
sign like others, as is one inside a word. What stands in a comment is read, but binds no name. An unquoted run is a name
where all of it is an identifier, or a dotted one that is bound. Addresses with a scheme but without a user are no secrets.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from verdigris.llm.spans import Span, found

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "literal")
# Names that the base kind knows, and what others add to a name's score.
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "api_key": 3, "access_key": 3, "private_key": 3, "credential": 3, "auth": 1, "bearer": 2}
LITERAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
LEAST = 4
# Operators that assign, and those that only look like it.
ASSIGNING = frozenset(["=", ":", ":=", "=>", "?=", "+=", "||="])

_operator = re.compile(r"[:=]")
_access = re.compile(r"AKIA[A-Z0-9]{12,}")
_hex = re.compile(r"[0-9a-f]{32,}")
_named = re.compile(r"(?:password|passwd|secret|token|api_?key)\Z", re.I | re.A)
_sensitive = re.compile("|".join(re.escape(k).replace("_", "[_-]") for k in sorted(SENSITIVE)), re.I)
_token = re.compile(
    r"""(?P<skip>\\.)
    |(?P<str>(?<!\w)[rbfuRBFU]{0,2}(?:"{3}(?:[^"\\]|\\.|"(?!""))*+"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`))
    |(?P<pem>-----BEGIN\ [A-Z0-9\ ]++-----)
    |(?P<note>(?<!\S)\#|(?<![:\w])//|--(?=\s)|/\*|<!--)
    |(?P<end>\*/|-->)
    |(?P<op>===?|!==?|<=|>=|=~|=>|->|::|:=|\?=|\+=|\|\|=|=|:)
    |(?P<join>\+|\.\.|&)
    |(?P<word>[\w$@][\w.$-]*+)
    |(?P<line>\n[ \t]*+)
    |(?P<mark>[\[\](){},;.|>])""",
    re.X | re.S,
)
_called = re.compile(r"[(]\s*[rbfu]?[\"'`]")
_quotes = re.compile(r"[rbfuRBFU]{0,2}(\"{3}|'{3}|[\"'`])")
_name = re.compile(r"[A-Za-z_$][\w.$-]*\Z")
_reference = re.compile(r"\$(?:\{([A-Za-z_]\w*)\}|([A-Za-z_]\w*))\Z")
_plain, _dotted = re.compile(r"[^\W\d]\w*+"), re.compile(r"[^\W\d][\w.]*+")
_digit, _stretch = re.compile(r"\d"), re.compile(r"[a-z]+|[A-Z]+|\d+|[\W_]+")
_run = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
_address = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+://(?![^\s/@]+@)")
#: An authorization scheme and its credentials, which count alone.
_scheme = re.compile(r"(?:basic|bearer|token|digest)[ \t]+(?=\S{8,}\Z)", re.I)
_bare_scheme = re.compile(r"(?:basic|bearer)[ \t]+", re.I)
_element = re.compile(r"<([A-Za-z][\w.:-]*)(?:\s[^<>]*+)?>([^<>]*+)</\1\s*>")
_tag = re.compile(r"<[A-Za-z][\w.:-]*\s[^<>]*+>")
_attribute = re.compile(r"""(?<!\S)([\w.:-]+)=(?:"([^"]*+)"|'([^']*+)')""")
_words = re.compile(r"(?:[ \t]+[^\s\"'`#,;(){}\[\]<>=]+)*")
#: Functions that take a secret as their argument, as against those that look one up or check it.
_setter = re.compile(r"(?:set|with|use|add|put)[A-Z_]", re.A)
#: What may stand on a line of a configuration before the name.
_before = frozenset(["export", "set", "ENV", "env", "-"])
_layout = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----|\n[ \t]+")


def entropy(s: str | Counter) -> float:
    counts = [n for n in Counter(s).values() if n > 0]
    total = sum(counts)
    return -sum(n / total * math.log2(n / total) for n in counts)


def _spaced(literal: str) -> bool:
    return " " in literal and " " in _layout.sub("", literal)


def score(name: str, literal: str | Counter, spaced: bool = False) -> float:
    """By the target's name and the literal's look (or its characters and whether blanks part them): 4 or more is reported."""
    low = name.lower().replace("-", "_")
    by_name = max((v for k, v in SENSITIVE.items() if k in low), default=0)
    counts = literal if isinstance(literal, Counter) else Counter(literal)
    if not by_name or sum(counts.values()) < 8:
        return 0.0
    spaced = (spaced or isinstance(literal, str) and _spaced(literal)) and "passphrase" not in low
    return by_name + (entropy(counts) >= 3) + any(c.isdigit() for c, k in counts.items() if k > 0) - 2 * spaced


class Value:
    """What a name is bound to: its own stretches of the text, other values, and the characters of all of them."""

    __slots__ = ("counts", "spaced", "parts", "links", "told")

    def __init__(self, parts: list, links: list, counts: Counter, spaced: bool) -> None:
        self.parts, self.links, self.counts, self.spaced, self.told = parts, links, counts, spaced, False

    def report(self, out: list) -> None:
        """Adds the stretches of this value and of those it is made of, each once."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.told:
                v.told = True
                out += v.parts
                todo += v.links


class Runs:
    """Unquoted runs and PEM blocks of a text, asked for in ascending places. Several operators may stand in one run; its
    end is sought once and its characters are counted once."""

    def __init__(self, t: str) -> None:
        self.t, self.end, self.counted, self.counts, self.closes, self.opens = t, 0, 0, None, 0, 0

    def ends(self, c: int) -> int:
        """The run's end, before marks that close a sentence; c where there is none."""
        if c >= self.end:
            m = _run.match(self.t, c)
            self.end, self.counts = m.end() if m else c, None
            while self.end > c and self.t[self.end - 1] in ".:!?":
                self.end -= 1
        return max(c, self.end)

    def tally(self, c: int) -> Counter:
        """The characters from c to the end of the run that ends() found."""
        if self.counts is None:
            self.counts = Counter(self.t[c : self.end])
        else:
            self.counts.subtract(self.t[self.counted : c])
        self.counted = c
        return self.counts

    def block(self, c: int) -> int:
        """The end of the PEM block whose first line ends at c, or 0 where another begins before it closes."""
        if 0 <= self.closes < c:
            self.closes = self.t.find("-----END ", c)
        if 0 <= self.opens < c:
            self.opens = self.t.find("-----BEGIN ", c)
        if 0 <= self.opens < self.closes:
            return 0
        e = self.t.find("-----", self.closes + 9) if self.closes >= 0 else -1
        return e + 5 if e >= 0 else 0


def base_assign(t: str, at: int, done: int) -> tuple[int, int, int] | None:
    """Start and end of the base match whose operator is at `at`, and where its literal starts."""
    a = at
    while a > done and t[a - 1] == " ":
        a -= 1
    for quote in (1, 0):  # the quote belongs to the pattern only where a name stands before it
        b = a - quote
        if b > done and (not quote or t[b] in "\"'") and (m := _named.search(t, max(done, b - 8), b)):
            break
    else:
        return None
    n, c = len(t), at + 1
    while c < n and t[c] == " ":
        c += 1
    if c < n and t[c] in "\"'":
        c += 1
    e = c
    while e < n and t[e] in LITERAL:
        e += 1
    return (m.start(), e, c) if e > c else None


Part = tuple[int, int]  # a stretch of the text


class Scopes:
    """Names and the stretches that are bound to them, by the indentation and the braces that are open."""

    def __init__(self) -> None:
        self.open, self.live, self.made, self.braces, self.known = [(-1, 0)], {0}, 0, 0, {}

    def _push(self, indent: int) -> None:
        self.made += 1
        self.open.append((indent, self.made))
        self.live.add(self.made)

    def _pop(self) -> None:
        self.live.discard(self.open.pop()[1])

    def line(self, indent: int) -> None:
        """A line that is indented so far begins; braces (indent -2) hold what is inside them, however it is indented."""
        while self.open[-1][0] > indent:
            self._pop()
        if self.open[-1][0] < indent:
            self._push(indent)

    def brace(self, opens: bool) -> None:
        if opens:
            self._push(-2)
            self.braces += 1
        elif self.braces:  # an unmatched one closes nothing
            self.braces -= 1
            while self.open[-1][0] != -2:
                self._pop()
            self._pop()

    def bind(self, name: str, value: Value) -> None:
        self.known.setdefault(name, []).append((self.open[-1][1], value))

    def of(self, name: str) -> Value | None:
        bound = self.known.get(name, [])
        while bound and bound[-1][0] not in self.live:
            bound.pop()
        return bound[-1][1] if bound else None


class Parser:
    """Reads the pairs of a text in order; out: the literals to report."""

    def __init__(self, t: str) -> None:
        self.t, self.runs, self.scopes, self.out, self.done, self.note = t, Runs(t), Scopes(), [], 0, ""

    def read(self, a: int, b: int, inner: bool = False) -> None:
        """The stretch a to b; inner: of a string that is no secret itself, which may hold pairs of its own."""
        t = self.t
        tokens = [(m.lastgroup, m.start(), m.end()) for m in _token.finditer(t, a, b)]
        if not inner:
            self.scopes.line(len(t[:200]) - len(t[:200].lstrip(" \t")))
        for i, (kind, x, y) in enumerate(tokens):
            if x < self.done:
                continue
            if kind == "line":
                if self.note == "line":
                    self.note = ""
                if not inner and t[y : y + 1] not in ("", "\n"):
                    self.scopes.line(y - x - 1)
            elif kind == "note":
                self.note = "block" if t[x:y] in ("/*", "<!--") else self.note or "line"
            elif kind == "end":
                self.note = ""
            elif kind == "mark" and not inner and t[x] in "{}":
                self.scopes.brace(t[x] == "{")
            elif kind == "mark" and t[x] == "(":
                self.call(tokens, i)
            elif kind == "op" and t[x:y] in ASSIGNING and (name := self.target(tokens, i)):
                self.pair(name, tokens, i + 1, inner)
            elif kind == "str" and y - x > 12 and not inner and _operator.search(t, x, y):
                if not (i and tokens[i - 1][0] == "op" and self.reported(x, y)):
                    note, self.note = self.note, "line"  # what is quoted binds nothing
                    self.read(x + len(_quotes.match(t, x)[0]), y - 1, True)
                    self.note = note

    def reported(self, x: int, y: int) -> bool:
        return bool(self.out) and x <= self.out[-1][0] and self.out[-1][1] <= y

    def inside(self, x: int, y: int) -> Part:
        """The stretch between a string's quotes."""
        m = _quotes.match(self.t, x)
        return m.end(), y - len(m[1])

    def target(self, tokens: list, i: int) -> str | None:
        """The name before the operator that is token i."""
        t, k = self.t, i - 1
        if k < 0 or not _blank(t, tokens[k][2], tokens[i][1]):
            return None
        kind, x, y = tokens[k]
        if kind == "mark" and t[x] == "]" and k > 1:
            k -= 1
            kind, x, y = tokens[k]
        if kind == "str":
            a, b = self.inside(x, y)
            return t[a:b] if _sensitive.search(t, a, b) or _name.match(t, a, b) else None
        if kind != "word" or not _name.match(t, x, y):
            return None
        if t[tokens[i][1] : tokens[i][2]] == "=" and k > 1 and tokens[k - 1][0] == "op" and t[tokens[k - 1][1] : tokens[k - 1][2]] == ":":
            return self.target(tokens, k - 1) or t[x:y]  # name: type = value
        return t[x:y]

    def call(self, tokens: list, i: int) -> None:
        """Of a call whose bracket is token i: its only string argument where the function's name is that of a setter or of
        the secret itself, and the second of two where the first is a sensitive name."""
        t, args = self.t, tokens[i + 1 : i + 5]
        if not args or args[0][0] != "str":
            return
        marks = [t[x:y] for kind, x, y in args if kind == "mark"]
        if len(args) > 3 and [a[0] for a in args[:3]] == ["str", "mark", "str"] and marks[0] == ",":
            a, b = self.inside(*args[0][1:])
            if _sensitive.search(t, a, b) and _name.match(t, a, b):
                self.told(t[a:b], self.literal([self.inside(*args[2][1:])]))
        elif i and tokens[i - 1][0] == "word" and marks and marks[0] in "),":
            function = t[tokens[i - 1][1] : tokens[i - 1][2]].rpartition(".")[2]
            if _setter.match(function) or _sensitive.fullmatch(function):
                self.told(function, self.literal([self.inside(*args[0][1:])]))

    def told(self, name: str, value: Value, scheme: int = 0) -> None:
        """Reports a value if it scores with the name; `pwd` may also be the folder at hand."""
        first = value.parts[0] if value.parts else None
        if first and name.lower() in ("pwd", "oldpwd") and self.t[first[0]] in "/~":
            return
        if first and len(value.parts) == 1 and not value.links and (m := _scheme.match(self.t, *first)):
            value, scheme = self.literal([(m.end(), first[1])]), 2
        if score(name, value.counts, value.spaced) + scheme >= LEAST and not (first and _address.match(self.t, first[0])):
            value.report(self.out)
            self.done = max([self.done, *(b for _, b in value.parts)])

    def leads(self, tokens: list, k: int) -> bool:
        """Whether a name and its operator (token k - 1) begin a line of a configuration: the name stands first on it, and
        the operator is `:`, or `=` without blanks."""
        t, j = self.t, k - 3
        if j >= 0 and tokens[j][0] == "word" and t[tokens[j][1] : tokens[j][2]] in _before:
            j -= 1
        if j >= 0 and tokens[j][0] != "line" or k < 2 or tokens[k - 2][0] not in ("word", "str"):
            return False
        x, y = tokens[k - 1][1:]
        return t[x:y] == ":" or t[x:y] == "=" and tokens[k - 2][2] == x and t[y : y + 1] not in (" ", "\t", "")

    def stops(self, e: int) -> bool:
        """Whether nothing but a comment follows on the line."""
        t = self.t
        while e < len(t) and t[e] in " \t":
            e += 1
        return e == len(t) or t[e] in "\n\r#" or t[e] == ";" and t[e - 1] in " \t"

    def pair(self, name: str, tokens: list, k: int, inner: bool = False) -> None:
        t, n, value, bracket = self.t, len(tokens), None, False
        at = tokens[k - 1][2]
        while k < n and (tokens[k][0] == "mark" and t[tokens[k][1]] in "(|>" or tokens[k][0] == "line" and (bracket or k + 1 < n and tokens[k + 1][0] == "pem")):
            bracket |= t[tokens[k][1]] == "("
            at, k = tokens[k][2], k + 1
        if k < n and tokens[k][0] == "pem" and t[at : tokens[k][1]].strip("\"' \t") == "":
            a, e = tokens[k][1], self.runs.block(tokens[k][2])
            value = self.literal([(a, e)]) if e else None
        elif k < n and tokens[k][0] == "str" and _blank(t, at, tokens[k][1]):
            value = self.joined(tokens, k, bracket)
        else:
            while at < len(t) and t[at] in " \t":
                at += 1
            e = self.runs.ends(at)
            leads = not inner and self.leads(tokens, k)
            m = _bare_scheme.match(t, at)
            if m and (stop := self.runs.ends(m.end())) - m.end() >= 8:
                return self.told(name, Value([(m.end(), stop)], [], self.runs.tally(m.end()).copy(), False), 2)
            if leads and "passphrase" in name.lower() and (stop := self.rest(e)) > e and self.stops(stop):
                value = self.literal([(at, stop)])
            elif self.is_name(at, e, leads and self.stops(e), name):
                value = self.joined(tokens, k, bracket)
            elif e - at >= 8:
                value = Value([(at, e)], [], self.runs.tally(at).copy(), False)
        if value is None:
            return
        if not self.note:
            self.scopes.bind(name, value)
        self.told(name, value)

    def rest(self, e: int) -> int:
        """Where the words from e on end, before a comment or the line's end."""
        m = _words.match(self.t, e)
        return m.end() if m else e

    def is_name(self, a: int, e: int, config: bool, name: str) -> bool:
        """Of an unquoted run: a reference, an identifier that does not look random (it does with digits where it is long
        or changes between small letters, capitals and digits all the time), or a dotted name that is bound or has no digit. On a line of a
        configuration a run is a literal where it has a digit or its target is in capitals, unless it is bound."""
        t = self.t
        m = _plain.match(t, a, e)
        if m and m.end() == e:
            if config and (_digit.search(m[0]) or name.isupper()):
                return self.scopes.of(m[0]) is not None
            return e - a < 8 or not _digit.search(m[0]) or e - a < 16 and 10 * len(_stretch.findall(m[0])) < 6 * (e - a)
        m = _dotted.match(t, a, e)
        return bool(_reference.match(t, a, e) or m and m.end() == e and (not _digit.search(m[0]) or self.scopes.of(m[0])))

    def literal(self, parts: list[Part]) -> Value:
        texts = [self.t[a:b] for a, b in parts]
        return Value(parts, [], sum(map(Counter, texts), Counter()), any(map(_spaced, texts)))

    def joined(self, tokens: list, k: int, bracket: bool) -> Value | None:
        """The strings and bound names from token k on that stand together or are joined."""
        t, parts, links = self.t, [], []
        while k < len(tokens):
            kind, x, y = tokens[k]
            if kind == "str":
                a, b = self.inside(x, y)
                m = _reference.match(t, a, b)
                if m:
                    links.append(self.scopes.of(m[1] or m[2]))
                else:
                    parts.append((a, b))
            elif kind == "word":
                m = _reference.match(t, x, y)
                links.append(self.scopes.of((m[1] or m[2]) if m else t[x:y].rstrip(".-")))
            else:
                break
            k += 1
            j = k
            while j < len(tokens) and (tokens[j][0] in ("join", "skip") or tokens[j][0] == "mark" and t[tokens[j][1]] == "." or tokens[j][0] == "line" and (bracket or j > k or j + 1 < len(tokens) and tokens[j + 1][0] == "join")):
                j += 1
            if j == k and not (k < len(tokens) and tokens[k][0] == "str" and _blank(t, y, tokens[k][1])):
                break
            k = j
        links = [v for v in links if v is not None]
        if not parts and not links:
            return None
        if not parts and len(links) == 1:
            return links[0]
        own = self.literal(parts)
        for v in links:
            for c, n in v.counts.items():
                own.counts[c] = min(own.counts[c] + n, 1 << 40)
        own.links, own.spaced = links, own.spaced or any(v.spaced for v in links)
        return own


def _blank(t: str, a: int, b: int) -> bool:
    return a == b or not t[a:b].strip(" \t")


def _worth(t: str) -> bool:
    """Whether a sensitive name stands before an operator on its line, or with a string in a call; without one no pair scores."""
    if _called.search(t):
        return True
    last = 0
    for m in _operator.finditer(t):
        if _sensitive.search(t, max(last, t.rfind("\n", last, m.start())), m.start()):
            return True
        last = m.end()
    return False


def _marked(t: str) -> list[tuple[int, int]]:
    """Literals in markup: the text of an element with a sensitive name, and the `value` of one whose name is an attribute."""
    out = []
    for m in _element.finditer(t):
        if _sensitive.search(m[1]):
            a, b = m.span(2)
            while a < b and t[a].isspace():
                a += 1
            while a < b and t[b - 1].isspace():
                b -= 1
            if score(m[1], t[a:b]) >= LEAST and not _address.match(t, a):
                out.append((a, b))
    for m in _tag.finditer(t):
        if _sensitive.search(m[0]):
            at = {x[1].lower(): x for x in _attribute.finditer(t, m.start(), m.end())}
            name, value = next((at[k] for k in ("name", "key", "id") if k in at), None), at.get("value")
            if name and value:
                a, b = value.span(2 if value[2] is not None else 3)
                if score(name[2] or name[3] or "", t[a:b]) >= LEAST and not _address.match(t, a):
                    out.append((a, b))
    return out


def find(t: str) -> list[Span]:
    out: list[Span] = [("access", *m.span()) for m in _access.finditer(t)]
    out += [("hex", *m.span()) for m in _hex.finditer(t)]
    done = 0
    for m in _operator.finditer(t):
        if m.start() >= done and (x := base_assign(t, m.start(), done)):
            done = x[1]
            if x[1] - x[2] >= 8:
                out.append(("assign", x[0], x[1]))
    literals = set(_marked(t)) if "<" in t and _sensitive.search(t) else set()
    if _worth(t):
        p = Parser(t)
        p.read(0, len(t))
        literals |= set(p.out)
    return out + [("literal", a, b) for a, b in sorted(literals) if b > a]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    return found(docs, find, BASE, KINDS, text)
