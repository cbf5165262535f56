"""Divergence between sources: how far apart the sources of a language are in their terms, and which terms set each apart.

Each term that enough documents of a language have becomes a wide vector: its share in every source of the language, at
the source's index. Higher-order functions emit what the term adds to each pair of sources, and sums are taken before
rows are exchanged. A pair in neither of whose sources a term occurs gets the same from every such term, so these are
added for all terms at once, and a term only emits its pairs with a source that has it: work is in proportion to its occurrences by source
times the number of sources. All arithmetic is in integers.

Shares are 1 + floor(SCALE * (count + 2) / (total + 2 * terms)); two shares diverge by floor((p - q)**2 / (p + q)).

Bounds: a vector is as long as its language has sources, as the method asks; the result has the square of that anyway.
The table of languages (a row each, with their sources and totals) is joined on salted keys, so that no task gets all
terms of a language; it is broadcast only where Spark finds it small.

Defined cases: null texts, languages and sources are empty strings, which are a language and a source of their own; a
group without terms has shares like any other; a language without kept terms has divergences of 0; one with a single
source has no pairs; repeated rows count as often as they occur; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.shared import work_dir, written
from verdigris.llm.terms import runs, strings
from verdigris.llm.text import LOWER, flat, slices

SCALE, LEAST_DOCS, TOP, SALTS, SLICE = 1_000_000_000, 10, 10, 64, 16 << 20
LETTER = np.ones(256, bool)
LETTER[:128] = False
LETTER[65:91] = LETTER[97:123] = True


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = pc.fill_null(column, "").dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (rows with it), added up within a slice of texts."""
    for b in slices(batches, size=SLICE):
        data, offsets = flat(b.column("text"))
        starts, ends, row = runs(LETTER[data], offsets)
        if not len(starts):
            continue
        d = strings(LOWER[data[LETTER[data]]], ends - starts).dictionary_encode()
        size = len(d.dictionary)
        pairs, n = np.unique(row * size + d.indices.to_numpy(), return_counts=True)
        (lang, langs), (source, sources) = _codes(b.column("lang")), _codes(b.column("source"))
        group = (lang * len(sources) + source)[pairs // size]
        keys, of = np.unique(group * size + pairs % size, return_inverse=True)
        group = keys // size
        out = [langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources))), d.dictionary.take(pa.array(keys % size)).cast(pa.string())]
        out += [pa.array(np.bincount(of, weights=n).astype(np.int64)), pa.array(np.bincount(of))]
        yield pa.RecordBatch.from_arrays(out, names=["lang", "source", "term", "n", "docs"])


def _share(count: str, total: str, terms: str) -> str:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact while the divisor is below 9 * 10**15: where the product
    would pass a long, by long division to base 1,000."""
    d, r = f"nullif({total} + 2 * {terms}, 0)", f"({count} + 2)"
    plain, q = f"({r} * {SCALE}L div {d})", []
    for _ in range(3):
        q.append(f"({r} * 1000L div {d})")
        r = f"({r} * 1000L % {d})"
    return f"(1 + if({count} < 9000000000L, {plain}, {q[0]} * 1000000L + {q[1]} * 1000L + {q[2]}))"


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def term_vectors(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, term, n, counts: a map from source to occurrences), and the languages (lang, terms, total,
    names: source and total of each, by source; zeros: their shares of a term that they do not have)."""
    spark = docs.sparkSession
    given = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in ("lang", "source", "text")))
    t = given.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = t.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    kept = written(kept.where(F.col("docs") >= least_docs), work_dir(spark, "terms"))
    groups = given.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = kept.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("names"), F.sum("total").alias("total"))
    langs = langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    langs = langs.withColumn("zeros", F.expr(f"transform(names, x -> {_share('0L', 'x.total', 'terms')})"))
    return kept, written(langs, work_dir(spark, "langs"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: item is each other source of the language, value the sum of the
    divergences of all its kept terms. Part `term`: item is a term that the source has more of than its language as a
    whole, value their divergence, the first `top` only. Ranks run from 1 in a group and part, by value from the greatest."""
    kept, langs = term_vectors(docs, least_docs)
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("total", "all")
    wide = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    p = F.expr(f"transform(names, x -> {_share('coalesce(counts[x.source], 0L)', 'x.total', 'terms')})")
    wide = wide.select("lang", "salt", "term", "counts", p.alias("p"), F.expr(_share("n", "`all`", "terms")).alias("q"))
    wide = written(wide, work_dir(docs.sparkSession, "wide"))

    some = wide.join(salted.select("lang", "salt", "zeros"), ["lang", "salt"]).select("lang", "p", "zeros", F.posexplode("p").alias("i", "pi")).where("pi <> zeros[i]")
    more = some.select("lang", "i", F.expr(f"transform(p, (x, j) -> if(j > i or (j < i and x = zeros[j]), {_apart('pi', 'x')}, null))").alias("v"))
    more = more.select("lang", "i", F.posexplode("v").alias("j", "v")).where("v is not null")
    more = more.groupBy("lang", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("met"))
    base = langs.select("lang", "terms", "zeros", F.posexplode("zeros").alias("a", "za")).select("lang", "terms", "a", "za", F.posexplode("zeros").alias("b", "zb")).where("a < b")
    value = F.expr(f"if(terms = 0, 0L, coalesce(v, 0L) + (terms - coalesce(met, 0L)) * {_apart('za', 'zb')})")
    sums = base.join(more, ["lang", "a", "b"], "left").select("lang", "a", "b", value.alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("to")), F.struct(F.col("b").alias("of"), F.col("a").alias("to")))).alias("x"), "value").select("lang", "x.*", "value")
    names = langs.select("lang", F.posexplode("names").alias("k", "x")).select("lang", "k", F.col("x.source").alias("name"))
    left, right = (names.select("lang", F.col("k").alias(k), F.col("name").alias(n)) for k, n in (("of", "source"), ("to", "item")))
    pairs = both.join(left, ["lang", "of"]).join(right, ["lang", "to"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    own = wide.join(salted.select("lang", "salt", "names.source"), ["lang", "salt"]).select("lang", "term", "q", F.explode(F.expr("filter(transform(source, (s, k) -> struct(s as source, p[k] as p)), x -> x.p > q and counts[x.source] is not null)")).alias("x"))
    terms = own.select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_apart("x.p", "q")).alias("value"))

    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(w)) for x in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
