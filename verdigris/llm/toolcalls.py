"""Tool calls of chats: calls joined with their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join by conversation and call id; results are reduced to the earliest of each id first,
so neither repeated results nor a very long conversation makes a large group. Calls are ordered by (turn, step): a call
that depends only on calls of earlier turns keeps its own turn and step 0; one that depends on a call of the same or a
later turn is placed after it, with that call's turn and the next step. Only calls in a tangle need more than their turns:
a tangle is a stretch of a conversation's turns that such dependencies cover without a gap. Each is peeled by one task
(Kahn), which holds the ids and dependencies of that stretch alone, however long its conversation is.

Defined cases: null ids join nothing (a call with a null id is unanswered, a result with one is an orphan); of calls with
one id the first by (turn, name, arguments) counts, the others have status `repeated`, keep their own columns and have no
place in the order; orphans are results whose id no call has; dependencies on unknown ids and on the call itself are
ignored; what is in a cycle, or depends on such a call of its tangle, is marked `cyclic` and keeps its turn and step 0; a
null turn is the first; arguments that are no JSON, no object, nested deeper than DEPTH, or with numbers that doubles or
DIGITS digits cannot hold are faults; halves of surrogate pairs are written as escapes; a schema with an
unknown keyword or type is refused at once; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.schema import checked
from verdigris.llm.schema import fault as schema_fault
from verdigris.llm.shared import work_dir, written
from verdigris.llm.text import slices

_FIRST = -(2**63)  # the turn that stands for a null one
#: Unless told otherwise: what arguments may nest, and digits of an integer. Turns of a conversation that one task looks
#: through for tangles.
DEPTH, DIGITS, TURNS = 200, 4000, 4096
_half = re.compile("[\ud800-\udfff]")
_nesting = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[{]|[\]}]', re.S)


class Fault(ValueError):
    """Arguments that are not taken as JSON."""


def canonical(value: object) -> str:
    """Keys sorted by code point, no blanks, numbers that are whole without a point, valid as UTF-8."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x

    return escaped(json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def escaped(text: str) -> str:
    return _half.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _refuse(name: str):
    raise Fault("$: not JSON")


def _float(text: str) -> float:
    if math.isinf(x := float(text)):
        raise Fault("$: number")
    return x


def _int(text: str, digits: int) -> int:
    if len(text.lstrip("-")) > digits:
        raise Fault("$: number")
    return int(text)


def _depth(text: str) -> int:
    """How deep the text nests; brackets in strings do not count."""
    most = now = 0
    for m in _nesting.finditer(text):
        if m[0] in "[{":
            now += 1
            most = max(most, now)
        elif m[0] in "]}":
            now -= 1
    return most


def parsed(text: str | None, depth: int = DEPTH, digits: int = DIGITS) -> object:
    """Raises Fault for what is not JSON, nests deeper or has longer integers."""
    if text is None:
        raise Fault("$: not JSON")
    if text.count("[") + text.count("{") > depth and _depth(text) > depth:
        raise Fault("$: depth")
    try:
        return json.loads(text, parse_constant=_refuse, parse_float=_float, parse_int=lambda x: _int(x, digits))
    except json.JSONDecodeError:
        raise Fault("$: not JSON") from None


def fault(value: object, schema: dict | bool, at: str = "$") -> str | None:
    """The first way in which value breaks the schema."""
    return schema_fault(value, schema, canonical, at)


def calls_in(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that messages (conv_id, turn, role, text) hold as JSON: {"tool_calls": [{"id", "name",
    "arguments", "after"}]} of any role, and {"tool_call_id", "content"} of the role tool."""
    m = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    calls = m.select("conv_id", "turn", F.explode(F.from_json("text", "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>")["tool_calls"]).alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    got = m.where("role = 'tool'").withColumn("r", F.from_json("text", "tool_call_id string, content string"))
    return calls, got.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))


def peeled(turns: dict[str, int], after: dict[str, list[str]]) -> dict[str, tuple[int, int, bool]]:
    """Turn, step and whether cyclic of each call of one conversation: calls whose dependencies are placed are placed."""
    on = {c: {d for d in after.get(c) or () if d in turns and d != c} for c in turns}
    users: dict[str, list[str]] = {}
    for c, ds in on.items():
        for d in ds:
            users.setdefault(d, []).append(c)
    left, rank = {c: len(ds) for c, ds in on.items()}, {c: (t, 0) for c, t in turns.items()}
    ready = [c for c, n in left.items() if not n]
    placed = set()
    while ready:
        c = ready.pop()
        placed.add(c)
        for u in users.get(c, ()):
            rank[u] = max(rank[u], (rank[c][0], rank[c][1] + 1))
            left[u] -= 1
            if not left[u]:
                ready.append(u)
    return {c: (*rank[c], False) if c in placed else (t, 0, True) for c, t in turns.items()}


_PEELED = "conv_id long, call_id string, order_turn long, order_step int, cyclic boolean"


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tangles whose rows stand together; a tangle may span batches."""

    def out(conv: int, turns: dict, after: dict) -> pa.RecordBatch:
        r = [(conv, c, None if t == _FIRST else t, k, x) for c, (t, k, x) in peeled(turns, after).items()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*r, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["conv_id", "call_id", "order_turn", "order_step", "cyclic"])

    last, turns, after = None, {}, {}
    for b in batches:
        for conv, tangle, call, turn, on in zip(*(b.column(c).to_pylist() for c in ("conv_id", "tangle", "call_id", "at", "after")), strict=True):
            if turns and (conv, tangle) != last:
                yield out(last[0], turns, after)
                turns, after = {}, {}
            last, turns[call], after[call] = (conv, tangle), turn, on
    if turns:
        yield out(last[0], turns, after)


def tangles(spans: DataFrame) -> DataFrame:
    """conv_id, at, tangle (its first turn): the turns that spans (conv_id, at, reach: the last turn that a dependency of
    this turn's calls points to, null if none points to this turn or later ones) cover. One row a turn is given; a
    conversation is looked through in pieces of TURNS turns, and then piece by piece."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside, across = Window.partitionBy("conv_id", "piece").orderBy("at"), Window.partitionBy("conv_id").orderBy("piece")
    s = spans.withColumn("piece", F.floor(F.col("at") / TURNS))
    ends = s.groupBy("conv_id", "piece").agg(F.max("reach").alias("reach")).select("conv_id", "piece", F.max("reach").over(before(across)).alias("earlier"))
    s = s.join(ends, ["conv_id", "piece"]).withColumn("open", F.greatest("earlier", F.max("reach").over(before(inside))))
    s = s.withColumn("first", F.when(F.col("reach").isNotNull() & ~F.coalesce(F.col("open") >= F.col("at"), F.lit(False)), F.col("at")))
    s = s.withColumn("covered", F.col("reach").isNotNull() | F.coalesce(F.col("open") >= F.col("at"), F.lit(False)))
    firsts = s.groupBy("conv_id", "piece").agg(F.max("first").alias("first")).select("conv_id", "piece", F.max("first").over(before(across)).alias("started"))
    s = s.join(firsts, ["conv_id", "piece"]).withColumn("tangle", F.greatest("started", F.max("first").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    return s.where("covered").select("conv_id", "at", "tangle")


def ordered(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, order_turn, order_step, cyclic of first calls (conv_id, turn, call_id, after)."""
    spark = calls.sparkSession
    calls = calls.withColumn("at", F.coalesce("turn", F.lit(_FIRST)))
    edges = calls.select("conv_id", "call_id", "at", F.explode("after").alias("on")).where("`on` <> call_id")
    back = edges.join(calls.select("conv_id", F.col("call_id").alias("on"), F.col("at").alias("its")), ["conv_id", "on"]).where("its >= at")
    back = written(back.groupBy("conv_id", "at").agg(F.max("its").alias("reach")), work_dir(spark, "backward"))
    plain = lambda c: c.select("conv_id", "call_id", F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"), F.lit(False).alias("cyclic"))
    if back.isEmpty():
        return plain(calls)
    turns = calls.join(back.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "at").distinct().join(back, ["conv_id", "at"], "left")
    inside = written(tangles(turns), work_dir(spark, "tangles"))
    hard = calls.join(inside, ["conv_id", "at"]).select("conv_id", "tangle", "call_id", "at", "after").repartition("conv_id", "tangle").sortWithinPartitions("conv_id", "tangle")
    return plain(calls.join(inside, ["conv_id", "at"], "left_anti")).unionByName(hard.mapInArrow(_peel, _PEELED))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict | bool], depth: int = DEPTH, digits: int = DIGITS) -> DataFrame:
    """Calls (conv_id, turn, call_id, name, arguments as JSON text, after) and results (conv_id, turn, call_id, content):
    conv_id, turn, call_id, name, status (linked, early, unanswered, repeated, orphan), result_turn, n_results,
    order_turn, order_step, cyclic, fault (null if valid), json. `early`: the result stands before its call. depth and
    digits: how deep arguments may nest, and how many digits an integer may have (a runtime's own limits are about 900
    levels and 4,300 digits)."""
    spark, schemas = calls.sparkSession, {k: checked(v) for k, v in schemas.items()}
    calls = calls.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "call_id", "name", "arguments", "after")
    named = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id", F.struct("turn", "name", "arguments", "after").alias("c")).agg(F.count(F.lit(1)).alias("copies"))
    named = written(named, work_dir(spark, "calls"))
    first = named.groupBy("conv_id", "call_id").agg(F.min("c").alias("c"), F.sum("copies").alias("n"))
    plain = written(first.select("conv_id", "call_id", "c.*", "n"), work_dir(spark, "first"))
    got = results.where("conv_id is not null and call_id is not null").groupBy(F.col("conv_id").cast("bigint").alias("conv_id"), "call_id")
    got = got.agg(F.min(F.struct(F.col("turn").cast("bigint").alias("turn"), "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    both = plain.join(got, ["conv_id", "call_id"], "full").join(ordered(plain.select("conv_id", "call_id", "turn", "after")), ["conv_id", "call_id"], "left")
    status = F.when(F.col("n").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").when(F.col("r.turn") < F.col("turn"), "early").otherwise("linked")
    shape = ("conv_id", "turn", "call_id", "name", "arguments", "status", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"), "order_turn", "order_step", "cyclic")
    rows = both.withColumn("status", status).select(*shape)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("name", "string"), ("arguments", "string"))]
    tail = [F.lit(None).cast("bigint").alias("result_turn"), F.lit(None).cast("string").alias("content"), F.lit(0).cast("bigint").alias("n_results"), F.lit(None).cast("bigint").alias("order_turn"), F.lit(None).cast("int").alias("order_step"), F.lit(False).alias("cyclic")]
    of = plain.where("n > 1").select("conv_id", "call_id", F.struct("turn", "name", "arguments", "after").alias("own"))
    more = named.join(of, ["conv_id", "call_id"]).withColumn("copies", F.col("copies") - F.col("c").eqNullSafe(F.col("own")).cast("int")).where("copies > 0")
    more = more.select("conv_id", "call_id", "c", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("k"))
    repeated = more.select("conv_id", "c.turn", "call_id", "c.name", "c.arguments", F.lit("repeated").alias("status"), *tail)
    lost = calls.where("conv_id is null or call_id is null").select("conv_id", "turn", "call_id", "name", "arguments", F.lit("unanswered").alias("status"), *tail[:3], F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"), tail[5])
    stray = results.where("conv_id is null or call_id is null").select(F.col("conv_id").cast("bigint"), none[0], "call_id", *none[1:], F.lit("orphan").alias("status"), F.col("turn").cast("bigint").alias("result_turn"), "content", F.lit(1).cast("bigint").alias("n_results"), *tail[3:])

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(slices([x], "arguments") for x in batches):
            faults, texts = [], []
            for r in b.select(["call_id", "name", "arguments", "status", "result_turn", "content"]).to_pylist():
                wrong, value = None, None
                if r["status"] != "orphan":
                    try:
                        value = parsed(r["arguments"], depth, digits)
                        wrong = fault(value, schemas[r["name"]]) if r["name"] in schemas else "$: no schema"
                        wrong = wrong or (None if isinstance(value, dict) else "$: type")
                    except Fault as e:
                        wrong, value = str(e), r["arguments"]
                result = {"content": r["content"], "turn": r["result_turn"]} if r["status"] in ("linked", "early", "orphan") else None
                faults.append(wrong and escaped(wrong))
                texts.append(canonical({"arguments": value, "id": r["call_id"], "name": r["name"], "result": result}))
            keep = [c for c in b.schema.names if c not in ("arguments", "content")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(faults, pa.string()), pa.array(texts, pa.string())], names=[*keep, "fault", "json"])

    schema = "conv_id long, turn long, call_id string, name string, status string, result_turn long, n_results long, order_turn long, order_step int, cyclic boolean, fault string, json string"
    return rows.unionByName(repeated).unionByName(lost).unionByName(stray).mapInArrow(serialize, schema)


#: What the query over plain chats takes as calls: each user turn asks for an answer, and has a note taken of it.
ANSWER = {
    "answer": {"type": "object", "required": ["text", "words"], "properties": {"text": {"type": "string", "maxLength": 200}, "words": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "note": {"type": "object", "required": ["even", "length"], "properties": {"even": {"enum": [True, None]}, "length": {"type": "integer", "maximum": 150}}},
}


def exchanges(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain chats (conv_id, turn, role, text) as calls and results. A user's turn t with w words is two calls: `answer`,
    conv:t, after conv:(t - 2) and, if 5 divides w, after its note; `note`, conv:t:note, after conv:t if 3 divides w, and
    after conv:(t + 2) if 7 and not 5 does. An assistant's turn t answers conv:(t - 1), a user's turn t the note of t - 2."""
    at = lambda d, more="": F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + d).cast("string"), *([F.lit(more)] if more else []))
    asks = chats.where("role = 'user'").withColumn("w", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ \\x09-\\x0D]+")))
    some = lambda *pairs: F.array_compact(F.array(*(F.when(c, v) for c, v in pairs)))
    w = lambda n: F.col("w") % n == 0
    answers = asks.select("conv_id", "turn", at(0).alias("call_id"), F.lit("answer").alias("name"), F.to_json(F.struct("text", F.col("w").alias("words"))).alias("arguments"), some((F.lit(True), at(-2)), (w(5), at(0, "note"))).alias("after"))
    about = F.to_json(F.struct(w(2).alias("even"), F.length("text").alias("length")))
    notes = asks.select("conv_id", "turn", at(0, "note").alias("call_id"), F.lit("note").alias("name"), about.alias("arguments"), some((w(3), at(0)), (w(7) & ~w(5), at(2))).alias("after"))
    replies = chats.where("role = 'assistant'").select("conv_id", "turn", at(-1).alias("call_id"), F.col("text").alias("content"))
    return answers.unionByName(notes), replies.unionByName(chats.where("role = 'user'").select("conv_id", "turn", at(-2, "note").alias("call_id"), F.col("text").alias("content")))
