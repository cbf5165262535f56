"""A content-addressed store of token ids.

Texts become ids with a public tokenizer, each document closed by an end id. A rolling hash over the ids cuts each
document into chunks where its content says so, so that copies and near copies share chunks. Files, all Parquet under
one folder: `chunks` (digest, n, ids: little-endian, `width` bytes each), every different chunk once; `recipes` (part,
doc_id, start, n_tokens, digests, lens, root), in ascending doc_id order, parts are consecutive; `manifest` (part, docs,
tokens, root), and over all parts one root, in `root` (parts, docs, tokens, root). A document's root is the Merkle root
of its chunks' digests and lengths, a part's that of its documents' ids, starts, lengths and roots. Readers recompute digests and roots, compare the parts
with the manifest and the manifest with the overall root, and raise where files disagree or are missing.

For tokenizers like word_bpe_49k, whose tokens hold no white space and never join letters with signs, texts are cut into
pieces first and each different piece is encoded once; that gives exactly the ids of the whole text.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first; rows with one doc_id are ordered by
root, and equal rows stay apart; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm.shared import remove, work_dir, written
from verdigris.llm.text import LOWER, U, bounds, eights, flat, mix, same_bytes, slices, word_hashes

END = 1
LEAST, MASK_BITS, MOST, ROLL = 64, 8, 2048, 16
#: Pieces (and their bytes) whose ids a worker remembers, and chunks whose digests a task does; beyond, they start anew and
#: only repeat work.
WORDS, POOL, SEEN = 800_000, 1 << 26, 300_000


#: What a piece of text is made of: 1 ASCII letters and digits, 2 ASCII signs that are in no contraction or special token.
_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(128) if chr(c).isalnum()]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = 2
# The normalizers and the pattern of tokenizers that are known to treat pieces alone.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_latin = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, int]:
    """The character that byte-level models use for each byte: itself where it prints, others from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """ids of whole texts. Tokenizers that treat the pieces of a text alone (see _by_pieces) encode each different piece
    once and keep its ids; all others encode text by text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.by_pieces = self._by_pieces()
        self.letters = _byte_letters()
        self._clear()

    def _by_pieces(self) -> bool:
        """White space is dropped, letters are lowered, and the pattern never joins a letter or digit with a sign, nor
        looks past the piece; so a text may be cut at white space and between ASCII letters or digits and safe signs."""
        j = json.loads(self.tokenizer.to_str())
        steps = (j.get("normalizer") or {}).get("normalizers") or []
        cut = (j.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kept = all(not t[k] for t in j.get("added_tokens") or [] for k in ("lstrip", "rstrip", "normalized", "single_word"))
        return kept and [x["type"] for x in steps] == _NORMALIZERS and cut[0].get("pattern") == {"Regex": _PATTERN} and cut[-1]["type"] == "ByteLevel" and not cut[-1]["add_prefix_space"]

    def _clear(self) -> None:
        """By hash, sorted: where each piece's ids and its own bytes lie in the pools, and how many they are."""
        self.known, (self.at, self.size, self.byte, self.length) = np.zeros(0, U), np.zeros((4, 0), np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bytes, self.filled = np.zeros(1 << 16, np.uint8), 0
        self.folded = np.zeros(0, U)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """A piece of Latin letters is one token sequence of the model; other pieces take the tokenizer's whole way."""
        out: list = [None] * len(pieces)
        hard = []
        for i, p in enumerate(pieces):
            if _latin.fullmatch(p):
                low = p.lower()
                out[i] = [t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.letters))]
            else:
                hard.append(i)
        for i, e in zip(hard, self.tokenizer.encode_batch_fast([pieces[i] for i in hard], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        ids = self._ids([p.decode() for p in pieces])
        size, length = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids, pieces))
        new = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.filled + len(raw) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.pool[self.used : self.used + len(new)] = new
        self.bytes[self.filled : self.filled + len(raw)] = raw
        rows = (self.used + size.cumsum() - size, size, self.filled + length.cumsum() - length, length)
        self.used += len(new)
        self.filled += len(raw)
        self.folded = eights(LOWER[self.bytes[: self.filled]])
        to = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, to, hashes)
        self.at, self.size, self.byte, self.length = (np.insert(x, to, y.astype(np.int32)) for x, y in zip((self.at, self.size, self.byte, self.length), rows, strict=True))

    def _find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the sorted hashes stand among the known ones, and which are unknown."""
        where = np.searchsorted(self.known, u)
        hit = np.zeros(len(u), bool)
        inside = where < len(self.known)
        hit[inside] = self.known[where[inside]] == u[inside]
        return where, np.flatnonzero(~hit)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        stops = np.concatenate([[0], np.cumsum([len(x) + 1 for x in own])]).astype(np.int64)
        return np.fromiter((i for x in own for i in (*x, END)), np.uint32, int(stops[-1])), stops

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end ids, and where each text's begin (one more at the end). Pieces are looked up by their
        hashes and then held against the bytes that were encoded; where any differ, all these texts are encoded whole."""
        if not self.by_pieces:
            return self._whole(texts)
        data, offsets = flat(texts)
        starts, ends, first = bounds(data, offsets, _KIND)
        h, odd = word_hashes(data, starts, ends), np.zeros(0, np.int64)
        if (data == 60).any():  # special tokens hold a < and are told from their capitals
            n = np.concatenate([[0], np.cumsum(data == 60)])
            odd = np.flatnonzero(n[ends] > n[starts])
            h[odd] = mix(word_hashes(data, starts[odd], ends[odd], fold=False) + U(END))
        u = np.sort(h)
        u = u[np.concatenate([[True], u[1:] != u[:-1]])] if len(u) else u
        at = np.searchsorted(u, h)
        where, new = self._find(u)
        if len(new):
            if len(self.known) + len(new) > WORDS or self.filled > POOL:
                self._clear()
                where, new = self._find(u)
            one, raw = np.zeros(len(u), np.int64), data.tobytes()
            one[at] = np.arange(len(h))
            self._learn(u[new], [raw[starts[i] : ends[i]] for i in one[new]])
            where, _ = self._find(u)
        k, length = where[at], ends - starts
        same = (self.length[k] == length).all() and same_bytes(eights(LOWER[data]), starts, self.folded, self.byte[k], length).all()
        if not same or len(odd) and not same_bytes(eights(data), starts[odd], eights(self.bytes[: self.filled]), self.byte[k[odd]], length[odd]).all():
            return self._whole(texts)
        size = self.size[k].astype(np.int64)
        to = np.zeros(len(h) + 1, np.int64)
        np.cumsum(size, out=to[1:])
        ids = self.pool[np.repeat(self.at[k] - to[:-1], size) + np.arange(to[-1])]
        stops = to[first]
        return np.insert(ids, stops[1:], np.uint32(END)), stops + np.arange(len(stops))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process: its pieces serve all the tasks that run there."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(ids: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each document the ends of its chunks. A place ends a chunk if the rolling hash of the last ROLL ids has
    MASK_BITS zeros on top; chunks shorter than LEAST go on, longer than MOST end. Only the document's own ids count:
    LEAST is larger than ROLL."""
    h, step, m = mix(ids.astype(U) + U(0x1234567)), 1, U(0x5851F42D4C957F2D)
    while step < ROLL:
        g = h.copy()
        g[step:] += h[:-step] * m
        h, m, step = g, U(int(m) * int(m) % 2**64), step * 2
    marks = np.flatnonzero(h >> U(64 - MASK_BITS) == 0) + 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, last = [], a
        for p in marks[np.searchsorted(marks, a + LEAST) : np.searchsorted(marks, b)].tolist():
            while p - last > MOST:
                last += MOST
                ends.append(last)
            if p - last >= LEAST:
                ends.append(p)
                last = p
        while b - last > MOST:
            last += MOST
            ends.append(last)
        out.append(np.array([*ends, b], np.int64))
    return out


def digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


class Merkle:
    """The root of leaves that come one by one; keeps one node for each height."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node = (0, digest(b"\0" + leaf))
        while self.nodes and self.nodes[-1][0] == node[0]:
            node = (node[0] + 1, digest(b"\1" + self.nodes.pop()[1] + node[1]))
        self.nodes.append(node)

    def root(self) -> bytes:
        out = b""
        for _, node in reversed(self.nodes):
            out = digest(b"\1" + node + out) if out else node
        return out


def merkle(leaves: Iterable[bytes]) -> bytes:
    m = Merkle()
    for x in leaves:
        m.add(x)
    return m.root()


def recipe_root(digests: list[bytes], lens: list[int]) -> bytes:
    return merkle(d + n.to_bytes(4, "little") for d, n in zip(digests, lens, strict=True))


def document_leaf(doc_id: int | None, start: int, n_tokens: int, root: bytes) -> bytes:
    return struct.pack("<?qqq", doc_id is not None, doc_id or 0, start, n_tokens) + root


_STAGED = "doc_id long, n_tokens long, digests array<binary>, lens array<int>, root binary, bodies array<binary>"


def _encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(tokenizer), set()
        kind = np.dtype("<u2") if own.width == 2 else np.dtype("<u4")
        for b in slices(batches):
            ids, offsets = own.encode(b.column("text"))
            raw, rows = ids.astype(kind).tobytes(), []
            for a, ends in zip(offsets[:-1].tolist(), cuts(ids, offsets), strict=True):
                ends, names, bodies = ends.tolist(), [], []
                for x, y in zip([a, *ends[:-1]], ends, strict=True):
                    body = raw[x * own.width : y * own.width]
                    names.append(d := digest(body))
                    bodies.append(None if d in seen else body)
                    seen.add(d)
                if len(seen) > SEEN:
                    seen = set()
                sizes = [y - x for x, y in zip([a, *ends[:-1]], ends, strict=True)]
                rows.append((ends[-1] - a, names, sizes, recipe_root(names, sizes), bodies))
            n, names, lens, roots, bodies = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.list_(pa.binary())), pa.array(lens, pa.list_(pa.int32())), pa.array(roots, pa.binary()), pa.array(bodies, pa.list_(pa.binary()))], names=["doc_id", "n_tokens", "digests", "lens", "root", "bodies"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, _STAGED)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of neighbours with one digest the first."""
    last = None
    for b in batches:
        if b.num_rows:
            d = b.column("digest").to_pylist()
            keep = [i for i, x in enumerate(d) if x != (d[i - 1] if i else last)]
            last = d[-1]
            yield b.take(pa.array(keep, pa.int64()))


def write(docs: DataFrame, path: str, tokenizer: str) -> str:
    """Encodes docs (doc_id, text) with the tokenizer file and writes the store to path; the root over all parts."""
    spark = docs.sparkSession
    staged = written(_encoded(docs, tokenizer), f"{path}/staged")
    bodies = staged.select(F.explode(F.arrays_zip("digests", "lens", "bodies")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.lens").alias("n"), F.col("c.bodies").alias("ids")).where("ids is not null")
    chunks = bodies.repartition(F.col("digest")).sortWithinPartitions("digest").mapInArrow(_first_of_each, "digest binary, n int, ids binary")
    chunks.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    ranged = staged.drop("bodies").repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, f"{path}/ranged")
    sums = sorted(ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row a part
    base, at = {}, 0
    for r in sums:
        base[r["part"]] = at
        at += r["n"]
    given = spark.createDataFrame(list(base.items()), "part int, base long")
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    recipes = ranged.withColumn("inner", inner).join(F.broadcast(given) if len(base) <= 100_000 else given, "part")
    recipes = recipes.select("part", "doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "digests", "lens", "root")
    recipes = written(recipes.repartitionByRange("start").sortWithinPartitions("start"), f"{path}/recipes")
    for x in ("staged", "ranged"):
        remove(spark, f"{path}/{x}")
    parts = _gathered(written(_parts(recipes).drop("start"), f"{path}/manifest"))
    whole = (len(parts), sum(p[1] for p in parts), sum(p[2] for p in parts), merkle([p[3] for p in parts]))
    written(spark.createDataFrame([whole], _ROOT), f"{path}/root")
    return whole[3].hex()


_ROOT = "parts long, docs long, tokens long, root binary"
_MANIFEST = "part int, docs long, tokens long, root binary"
_RECIPES = "part int, doc_id long, start long, n_tokens long, digests array<binary>, lens array<int>, root binary"
_CHUNKS = "digest binary, n int, ids binary"


def _gathered(parts: DataFrame) -> list[tuple]:
    """A row a part, in order: part, docs, tokens, root, and start where it is there."""
    return sorted((*(r[c] for c in ("part", "docs", "tokens")), bytes(r["root"]), *r[4:]) for r in parts.collect())


def _verified(spark: SparkSession, path: str, root: str | None) -> DataFrame:
    """The recipes, after their parts agree with the manifest, and that with the store's root and with `root` if given."""
    whole = spark.read.schema(_ROOT).parquet(f"{path}/root").collect()
    manifest = _gathered(spark.read.schema(_MANIFEST).parquet(f"{path}/manifest"))
    own = (len(manifest), sum(p[1] for p in manifest), sum(p[2] for p in manifest), merkle([p[3] for p in manifest]))
    if [(*tuple(r)[:3], bytes(r["root"])) for r in whole] != [own] or root is not None and own[3].hex() != root:
        raise ValueError("the manifest does not match the root over all parts")
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    found, at = _gathered(_parts(recipes).select("part", "docs", "tokens", "root", "start")), 0
    if [p[:4] for p in found] != manifest:
        named = sorted({p[0] for p in {*manifest} ^ {p[:4] for p in found}})
        raise ValueError(f"the recipes of {len(named)} parts do not match the manifest, first of part {named[0]}")
    for part, _, tokens, _, start in found:
        if start != at:
            raise ValueError(f"part {part} does not start where the one before it ends")
        at += tokens
    return recipes


def _parts(recipes: DataFrame) -> DataFrame:
    """part, docs, tokens, root, start: the root over the documents in order, which follow each other without gaps."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, m = [], Merkle()
        for b in batches:
            for part, doc, start, n, root in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "start", "n_tokens", "root")), strict=True):
                if not rows or rows[-1][0] != part:
                    if rows:
                        rows[-1][3] = m.root()
                    rows.append([part, 0, 0, b"", start])
                    m = Merkle()
                if start != rows[-1][4] + rows[-1][2]:
                    raise ValueError(f"in part {part} a document that starts at {start} does not follow the one before it")
                rows[-1][1] += 1
                rows[-1][2] += n
                m.add(document_leaf(doc, start, n, root))
        if rows:
            rows[-1][3] = m.root()
            p, d, t, r, a = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(r, pa.binary()), pa.array(a, pa.int64())], names=["part", "docs", "tokens", "root", "start"])

    slim = recipes.select("part", "doc_id", "start", "n_tokens", "root").repartition(F.col("part")).sortWithinPartitions("part", "start")
    return slim.mapInArrow(fold, "part int, docs long, tokens long, root binary, start long")


def _checked_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, n, crc: of the ids as 4-byte numbers."""
    for b in batches:
        crcs = []
        for d, n, body in zip(*(b.column(c).to_pylist() for c in ("digest", "n", "ids")), strict=True):
            if digest(body) != d:
                raise ValueError(f"chunk {d.hex()} does not match its digest")
            crcs.append(crc32(body if len(body) == 4 * n else np.frombuffer(body, "<u2").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of each recipe how many ids follow it in the document."""
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, start, n, names, lens, root in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "digests", "lens", "root")), strict=True):
            if recipe_root(names, lens) != root or sum(lens) != n:
                raise ValueError(f"the recipe of document {doc} does not match its root")
            after = n
            for d, x in zip(names, lens, strict=True):
                after -= x
                for k, v in enumerate((doc, start, d, x, after)):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "start", "digest", "len", "after"])


_POLY = U(0xEDB88320)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of polynomials over GF(2), reflected, modulo that of CRC-32."""
    out, b = np.zeros(len(b), U), b.copy()
    for k in range(31, -1, -1):
        out ^= b * ((a >> U(k)) & U(1))
        b = (b >> U(1)) ^ (_POLY * (b & U(1)))
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds to that of the whole where n_bytes follow it."""
    out, power, k = crc.astype(U), np.full(1, 1 << 30, U), 0
    n = n_bytes.astype(np.int64) * 8
    while (n >> k).any():
        rows = np.flatnonzero((n >> k) & 1)
        if len(rows):
            out[rows] = _product(np.broadcast_to(power, len(rows)), out[rows])
        power, k = _product(power, power), k + 1
    return out


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            share = shifted(b.column("crc").to_numpy(), 4 * b.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("len"), pa.array(share.astype(np.int64))], names=["doc_id", "start", "len", "share"])


def _with_chunks(uses: DataFrame, chunks: DataFrame, value: str) -> DataFrame:
    """uses with `value` of their chunks; raises where a chunk is missing or of another length."""
    both = uses.join(chunks, "digest", "left")
    return both.withColumn(value, F.when(F.col("n") == F.col("len"), F.col(value)).otherwise(F.raise_error(F.lit("a recipe names a chunk that is missing or of another length"))))


_USES = "doc_id long, start long, digest binary, len int, after long"


def read(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the store's files, which must have the given root. Each
    stored chunk is read, verified and summed once; a document's checksum follows from its chunks' by the algebra of
    CRC-32, so no ids are shuffled."""
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks").mapInArrow(_checked_chunks, "digest binary, n int, crc long")
    uses = _verified(spark, path, root).mapInArrow(_uses, _USES)
    shares = _with_chunks(uses, chunks, "crc").select("doc_id", "start", "len", "after", "crc").mapInArrow(_shares, "doc_id long, start long, len int, share long")
    return shares.groupBy("start").agg(F.max("doc_id").alias("doc_id"), F.sum("len").alias("n_tokens"), F.bit_xor("share").alias("ids_crc32")).select("doc_id", "start", "n_tokens", "ids_crc32")


def rebuilt(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """doc_id, start, ids (array<int>) of each document, put together from its chunks, with the checks of read()."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for d, n, body in zip(*(b.column(c).to_pylist() for c in ("digest", "n", "ids")), strict=True):
                if digest(body) != d:
                    raise ValueError(f"chunk {d.hex()} does not match its digest")
                ids.append(np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(map(len, ids), pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["digest", "n", "ids"])

    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks").mapInArrow(numbers, "digest binary, n int, ids array<int>")
    parts = _with_chunks(_verified(spark, path, root).mapInArrow(_uses, _USES), chunks, "ids").select("doc_id", "start", (-F.col("after")).alias("k"), "ids")
    return parts.groupBy("doc_id", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def stored(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = work_dir(docs.sparkSession, "store")
    return read(docs.sparkSession, path, write(docs, path, tokenizer))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as they lie in a store: doc_id, start, n_tokens, ids_crc32."""
    return stored(docs, default_tokenizer())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
