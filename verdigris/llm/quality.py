"""Host-level quality rules, with DataFrame functions only.

Each document is measured once; rule failures are summed by host; each host's failure rate is shrunk towards all hosts
by a beta prior fitted to them (method of moments). The host's verdict on a rule joins back to its documents as a limit on
how far they may be from the rule (a document's severity: its measure over the rule's bound, so that it fails the rule
above 1). The limit is the EVIDENCE-th power of the odds of failing among all documents over the host's shrunk odds, within
LIMITS: a host that fails a rule seldom keeps documents that fail it slightly, a host that fails it often loses some that
come near it, and gross failures go everywhere. The base rules reject everywhere.

Defined cases: a null or blank text has no words and fails the base rule; null hosts form one host; repeated rows
count as often as they occur; hosts whose rates do not differ have the plain rule as their limit (1); an empty table gives
an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.shared import work_dir, written

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rules on which hosts have a verdict; the base rules reject by themselves.
RULES = ("symbols", "lines", "length")
EVIDENCE, LIMITS = 4, (0.8, 2.0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row even where body uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\x09-\\x0D]+"))


def _covered(grams: Column) -> Column:
    """Places that 3-place windows cover whose hash occurs twice or more: sort (hash, place), keep equal neighbours,
    and let each kept window, by place, add what the one before it did not cover."""

    def kept(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda i, j: s[i]["h"] == s[j]["h"]
        at = F.transform(F.sequence(F.lit(0), last), lambda k: F.when(((k > 0) & same(F.greatest(k - 1, F.lit(0)), k)) | ((k < last) & same(F.least(k + 1, last), k)), s[k]["i"]))
        return F.aggregate(
            F.sort_array(F.filter(at, lambda p: p.isNotNull())),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    numbered = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), _let(F.sort_array(numbered), kept)).otherwise(F.lit(0).cast("bigint"))


def n_repeat_words(w: Column) -> Column:
    grams = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.xxhash64(a[i], a[i + 1], a[i + 2]))
    return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(_let(_let(w, grams), _covered))


def measures(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """docs' columns as the struct `row`, its host and the counts that rules use."""
    t = F.coalesce(F.col("row")[text], F.lit(""))
    less = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    m = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    m = m.select("row", F.col("row")[host].cast("string").alias("host"), words(t).alias("w"), lines.alias("l"), (F.length(t) - less(BLANK)).cast("bigint").alias("word_chars"), less(SYMBOLS).cast("bigint").alias("n_symbols"))
    m = m.select("row", "host", F.size("w").cast("bigint").alias("n_words"), "word_chars", "n_symbols", F.size("l").cast("bigint").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"), n_repeat_words(F.col("w")).alias("n_repeat_words"))
    n = F.col("n_words")
    return m.withColumns({
        "base_failed": (n < 50) | (100 * F.col("n_repeat_words") > 50 * n),
        "symbols_failed": 100 * F.col("n_symbols") > 30 * n,
        "lines_failed": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "length_failed": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    })


def severities() -> dict[str, Column]:
    """Of a measured document and each rule: above 1 exactly where it fails the rule."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": 100 * F.col("n_symbols") / (30 * n),
        "lines": 100 * F.col("n_dup_lines") / (50 * F.greatest("n_lines", F.lit(1))),
        "length": F.greatest(2 * F.col("n_words") / chars, F.col("word_chars") / (15 * n)),
    }


def host_verdicts(measured: DataFrame, evidence: int = EVIDENCE, limits: tuple[float, float] = LIMITS) -> DataFrame:
    """host, docs, for each rule its failures, its rate over all documents, its shrunk rate, and the limit on severities."""
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *(F.count_if(f"{r}_failed").alias(f"{r}_failures") for r in RULES))
    sums = hosts.agg(F.sum("docs").alias("n"), *(F.sum(f"{r}_failures").alias(f"{r}_f") for r in RULES), *(F.sum(F.col(f"{r}_failures") * F.col(f"{r}_failures") / F.col("docs")).alias(f"{r}_q") for r in RULES)).first()
    rates = {}
    for r in RULES:
        n, f, q = sums["n"] or 1, sums[f"{r}_f"] or 0, sums[f"{r}_q"] or 0.0
        mean = f / n
        spread = q / n - mean * mean
        strength = max(1.0, mean * (1 - mean) / spread - 1) if spread > 1e-12 else None
        rate = (F.col(f"{r}_failures") + mean * strength) / (F.col("docs") + strength) if strength else F.lit(mean)
        limit = F.lit(1.0)
        if strength:
            odds = mean / (1 - mean) / (rate / (1 - rate))
            for k in range(evidence):
                limit = odds if k == 0 else limit * odds
            limit = F.least(F.lit(limits[1]), F.greatest(F.lit(limits[0]), limit))
        rates |= {f"{r}_mean": F.lit(mean), f"{r}_rate": rate, f"{r}_limit": limit}
    return hosts.withColumns(rates)


def judged(docs: DataFrame, text: str = "text", host: str = "source", evidence: int = EVIDENCE, limits: tuple[float, float] = LIMITS, carry: list[str] | None = None) -> DataFrame:
    """For each document: row (the columns of docs, or those in carry), its measures, base_failed, for each rule whether
    it failed and its host's limit, kept."""
    slim = measures(docs, text, host)
    if carry is not None:
        slim = slim.withColumn("row", F.struct(*(F.col("row")[c].alias(c) for c in carry)))
    m = written(slim, work_dir(docs.sparkSession, "measures"))
    v = host_verdicts(m, evidence, limits).select(F.col("host").alias("of"), *(f"{r}_limit" for r in RULES))
    v = written(v, work_dir(docs.sparkSession, "verdicts"))  # its size is known then, and rows stay where they are while it is small
    kept = ~F.col("base_failed")
    for r, severity in severities().items():
        kept = kept & (severity <= F.col(f"{r}_limit"))
    return m.join(v, F.col("host").eqNullSafe(F.col("of")), "left").withColumn("kept", kept)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the rules and their hosts' verdicts reject."""
    return judged(docs).where("kept").select("row.*")
