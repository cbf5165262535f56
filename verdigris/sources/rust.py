"""Source files as items: a lexer that finds functions, constants, statics, types and what encloses them.

It masks comments, strings and characters, matches brackets, and recognises items by their keywords. What it cannot tell
becomes an opaque item, the safe direction: a change there selects everything.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.storage import work_dir, written

_masked = re.compile(r"""//[^\n]*|/\*|(?<![A-Za-z0-9_])[bc]?r(\#*)"|[bc]?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'""", re.S)
_comment = re.compile(r"/\*|\*/")
_token = re.compile(r"r\#[A-Za-z_]\w*|[A-Za-z_]\w*|[{}()\[\];#!<>=,*]|::|\d\w*|\S", re.A)
_OPEN, _CLOSE = "{([", "})]"
_NAMED = {"struct", "enum", "union"}
_LEAD = {"pub", "default", "async", "unsafe", "extern", "const", "crate"}

Item = tuple[str, str, int, int, list[str]]


def masked(src: str) -> str:
    """src with comments, strings and characters blanked; lines stay where they are."""
    out, at = [], 0
    while m := _masked.search(src, at):
        a, b = m.span()
        if m[0] == "/*":
            depth = 1
            while depth and (c := _comment.search(src, b)):
                depth += 1 if c[0] == "/*" else -1
                b = c.end()
            b = len(src) if depth else b
        elif m[1] is not None:
            end = src.find('"' + m[1], b)
            b = len(src) if end < 0 else end + 1 + len(m[1])
        out += [src[at:a], re.sub(r"[^\n]", " ", src[a:b])]
        at = b
    return "".join([*out, src[at:]])


class _Parser:
    def __init__(self, src: str):
        text = masked(src)
        found = list(_token.finditer(text))
        self.words = [m[0] for m in found]
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.lines, k = [], 0
        for m in found:
            while k + 1 < len(starts) and starts[k + 1] <= m.start():
                k += 1
            self.lines.append(k + 1)
        self.match: dict[int, int] = {}
        stack = []
        for i, w in enumerate(self.words):
            if w in _OPEN:
                stack.append(i)
            elif w in _CLOSE:
                if not stack or _OPEN.index(self.words[stack[-1]]) != _CLOSE.index(w):
                    raise ValueError("brackets do not match")
                self.match[stack.pop()] = i
        if stack:
            raise ValueError("brackets do not match")
        self.items: list[tuple[int, Item]] = []  # each with its first word's number
        self.aliases: list[tuple[int, tuple[str, str]]] = []
        self.inner: list[tuple[int, int, str]] = []

    def word(self, i: int) -> str:
        return self.words[i] if i < len(self.words) else ""

    def put(self, name: str, kind: str, a: int, b: int) -> None:
        names = {w for w in self.words[a : b + 1] if w[0].isalpha() or w[0] == "_"}
        self.items.append((a, (name, kind, self.lines[a], self.lines[b], sorted(names))))

    def end(self, i: int, to: int, blocks: bool) -> tuple[int, int | None]:
        """The last word of an item, and its body's opening brace: a semicolon outside brackets, or with blocks a brace."""
        while i < to:
            if self.words[i] == ";":
                return i, None
            if self.words[i] in _OPEN:
                if blocks and self.words[i] == "{":
                    return self.match[i], i
                i = self.match[i]
            i += 1
        return to - 1, None

    def uses(self, a: int, b: int) -> None:
        self.aliases += [(i, (self.words[i + 1], self.words[i - 1])) for i in range(a, b) if self.words[i] == "as" and i > a and self.word(i + 1) != "_"]

    def run(self, i: int, to: int, inside: str = "") -> None:
        """Items among words i to to; inside: `impl` or `trait` where only members count."""
        while i < to:
            a = i
            while self.word(i) == "#":
                j = i + 1 + (self.word(i + 1) == "!")
                i = self.match.get(j, j) + 1
            if i >= to:
                return
            j = i
            while self.word(j) in _LEAD and not (self.word(j) == "const" and self.word(j + 1) not in ("fn", "unsafe", "async", "extern")) and not (self.word(j) == "extern" and self.word(j + 1) == "crate"):
                j += 1
                if self.word(j) == "(":
                    j = self.match[j] + 1
            key, name = self.word(j), self.word(j + 1)
            if key == "fn":
                b, body = self.end(j, to, True)
                if not inside or inside == "impl" or body is not None:
                    self.put(name, "fn", a, b)
            elif key in ("const", "static", "type") and (name == "mut" or name[:1].isalpha() or name[:1] == "_"):
                b, _ = self.end(j, to, False)
                if inside != "trait" and not (inside and key == "static"):
                    self.put(self.word(j + 2) if name == "mut" else name, "type_alias" if key == "type" else key, a, b)
            elif key == "mod":
                b, body = self.end(j, to, True)
                if body is not None:
                    self.inner.append((body + 1, b, ""))
                else:
                    self.put("", "opaque", a, b)
            elif key in ("trait", "impl") or (key == "auto" and name == "trait"):
                b, body = self.end(j, to, True)
                head = [w for w in self.words[j + 1 : body if body is not None else b] if w[0].isalpha() or w[0] == "_"]
                self.put(name if key == "trait" else self.impl_name(j + 1, body if body is not None else b), "opaque", a, b)
                if body is not None and head:
                    self.inner.append((body + 1, b, key if key == "impl" else "trait"))
            elif key in _NAMED and (name[:1].isalpha() or name[:1] == "_"):
                b, _ = self.end(j, to, True)
                if self.word(b) == ")" and self.word(b + 1) == ";":
                    b += 1
                self.put(name, "opaque", a, b)
            else:
                b, _ = self.end(j, to, key != "use")
                if key == "use":
                    self.uses(j + 1, b)
                elif self.word(b) in _CLOSE and self.word(b + 1) == ";":
                    b += 1
                if not inside:
                    self.put("", "opaque", a, b)
            i = max(b, i) + 1

    def impl_name(self, a: int, b: int) -> str:
        """The last segment of the self type's path, without its parameters."""
        if self.word(a) == "<":
            depth = 0
            while a < b:
                depth += {"<": 1, ">": -1}.get(self.words[a], 0)
                a += 1
                if not depth:
                    break
        for i in range(b - 1, a, -1):
            if self.words[i] == "for":
                a = i + 1
                break
        name = ""
        for i in range(a, b):
            w = self.words[i]
            if w in ("<", "where", "{"):
                break
            if w[0].isalpha() or w[0] == "_":
                name = w
        return name


def parse(src: str) -> tuple[list[Item], list[tuple[str, str]]]:
    """Items (name, kind, first line, last line, identifiers) and use-aliases (alias, original); none if brackets do not
    match."""
    try:
        p = _Parser(src)
    except ValueError:
        return [], []
    todo = [(0, len(p.words), "")]
    while todo:  # modules, traits and implementations inside others come to the list, not to the stack
        p.inner = []
        p.run(*todo.pop())
        todo += reversed(p.inner)
    p.items.sort(key=lambda x: x[0])
    return [x[1] for x in p.items], [x[1] for x in sorted(p.aliases, key=lambda x: x[0])]


#: Tasks to a core that parse source files.
PARSERS = 4


def items_and_aliases(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sources (file, src): items with their place in the file (pos), numbered, and aliases (alias,
    original, file). A file is parsed once; both come from that pass."""
    schema = "file string, pos int, name string, kind string, start int, `end` int, refs array<string>, alias string, original string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, src in zip(b["file"], b["src"], strict=True):
                items, aliases = parse(src or "")
                rows += [(file, k, *x, None, None) for k, x in enumerate(items)]
                rows += [(file, None, None, None, None, None, None, *x) for x in aliases]
            out = pd.DataFrame(rows, columns=["file", "pos", "name", "kind", "start", "end", "refs", "alias", "original"])
            yield out.astype({"pos": "Int32", "start": "Int32", "end": "Int32"})

    tasks = PARSERS * sources.sparkSession.sparkContext.defaultParallelism
    dealt = sources.select("file", "src").repartition(tasks, "file", "src")  # a table of many small files may be read by a task or two
    parsed = dealt.mapInPandas(run, schema).withColumn("item_id", F.monotonically_increasing_id())
    both = written(parsed, work_dir(sources.sparkSession, "items"))  # numbers are given once, as rows are written
    return both.where("pos is not null").select("item_id", "pos", "name", "kind", "file", "start", "end", "refs"), both.where("alias is not null").select("alias", "original", "file")


def read_sources(spark: SparkSession, path: str, suffix: str = ".rs") -> DataFrame:
    """file (relative to path), src of an exported tree; files without the suffix are not opened."""
    tree = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    rel = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    base = "/" + path.split(":", 1)[-1].strip("/") + "/"
    return tree.select(F.substr(rel, F.lit(len(base) + 1)).alias("file"), F.decode("content", "UTF-8").alias("src"))


#: Folders that a crate's digest leaves out, at any depth, besides those that begin with a dot.
SKIPPED_FOLDERS = ("target",)
#: Folders to a task, about.
FOLDERS = 64


def tree_files(spark: SparkSession, root: str) -> DataFrame:
    """rel, digest of every file below a folder that all machines mount (Spark's file sources skip dot-files, which count
    here). Folders are listed level by level, each level's by tasks of its own, which also read and hash the files in them;
    the driver sees no list. A link's digest is that of its target's name; a file that cannot be read has zeros."""
    home, k, found = work_dir(spark, "tree"), 0, []
    level = spark.createDataFrame([("",)], "folder string")
    while not level.isEmpty():
        seen = level.repartition(max(1, min(level.count() // FOLDERS, 4096))).mapInPandas(lambda b: _listed(root, b), "rel string, digest string, folder string")
        found.append(f"{home}/{k}")
        seen = written(seen, found[-1])
        level, k = seen.where("folder is not null").select("folder"), k + 1
    return spark.read.schema(seen.schema).parquet(*found).where("rel is not null").select("rel", "digest")


def _listed(root: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The files of folders with their digests, and the folders in them."""
    for b in batches:
        for folder in b["folder"]:
            rows = []
            try:
                entries = sorted(os.scandir(f"{root}/{folder}"), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                rel = f"{folder}/{e.name}".lstrip("/")
                if e.is_symlink() and not (e.is_dir() and _skipped(e.name)):
                    rows.append((rel, hashlib.sha256(b"symlink:" + os.readlink(e.path).encode()).hexdigest(), None))
                elif e.is_dir():
                    rows += [] if _skipped(e.name) else [(None, None, rel)]
                elif not e.is_symlink():
                    rows.append((rel, _file_digest(e.path), None))
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["rel", "digest", "folder"])
                    rows = []
            yield pd.DataFrame(rows, columns=["rel", "digest", "folder"], dtype=object)


def _skipped(name: str) -> bool:
    return name.startswith(".") or name in SKIPPED_FOLDERS


def _file_digest(path: str) -> str:
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except OSError:
        return "0" * 64
