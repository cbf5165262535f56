"""Source divergence against a plain count in exact integers, and the vectors' salts, zeros and ties."""

import re
from collections import Counter, defaultdict

from verdigris.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows, least=10, top=10):
    groups, docs, n = set(), Counter(), Counter()
    for lang, source, text in rows:
        g = (lang or "", source or "")
        groups.add(g)
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        n.update((g, t) for t in found)
        docs.update((g[0], t) for t in set(found))
    kept = defaultdict(list)
    for (lang, t), k in docs.items():
        if k >= least:
            kept[lang].append(t)
    out = []
    for lang in {g[0] for g in groups}:
        terms, sources = kept[lang], sorted(s for x, s in groups if x == lang)
        total = {s: sum(n[(lang, s), t] for t in terms) for s in sources}
        share = lambda count, of: 1 + 10**9 * (count + 2) // (of + 2 * len(terms))
        p = {s: [share(n[(lang, s), t], total[s]) for t in terms] for s in sources}
        q = [share(sum(n[(lang, s), t] for s in sources), sum(total.values())) for t in terms]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(map(f, p[s], p[o])), o) for o in sources if o != s]
            found = [(-f(a, b), t) for t, a, b in zip(terms, p[s], q, strict=True) if n[(lang, s), t] and a > b]
            out += [(lang, s, part, item, -v, k + 1) for part, x in (("pair", sorted(pairs)), ("term", sorted(found)[:top])) for k, (v, item) in enumerate(x)]
    return sorted(out)


def test_against_a_plain_count(spark, docs, empty, rows):
    given = [(r["lang"], r["source"], r["text"]) for r in docs.select("lang", "source", "text").collect()]
    for least, top in ((10, 10), (2, 3), (1, 1000)):
        assert sorted(rows(divergence.audit(docs, least, top))) == brute(given, least, top), least
    assert divergence.audit(empty).count() == 0


def test_groups_of_every_kind(spark, rows):
    made = [("en", f"s{k % 3}", "the THE The a-b 123 caf\u00e9 CAF\u00c9") for k in range(30)] + [("en", "bare", None), ("en", None, "1 2 3"), (None, "s1", "the"), ("xx", "alone", "word " * 5), ("de", "a", ""), ("de", "b", None)]
    made += [("en", "rare", f"only{'abcdefghij'[k]}s the \U0001f600 \x7f x\x00y") for k in range(10)] + [("en", f"many{k}", "the" if k % 2 else "a the the") for k in range(40)]
    df = spark.createDataFrame([(*x, 1, "n") for x in made], "lang string, source string, text string, p int, counts string")
    got = sorted(rows(divergence.audit(df, 10)))
    assert got == brute(made, 10)
    assert ("de", "a", "pair", "b", 0, 1) in got and not [r for r in got if r[0] in ("xx", "") and r[2] == "pair"]


def test_shares_beyond_a_long(spark):
    """Counts whose product with the scale passes 2**63 are divided exactly."""
    cases = [(0, 1, 1), (9_300_000_000, 9_300_000_001, 7), (1 << 50, (1 << 51) + 3, 12345), (5, 10**15, 10**9)]
    df = spark.createDataFrame(cases, "count long, total long, terms long")
    got = [tuple(r) for r in df.selectExpr("count", "total", "terms", divergence._share("count", "total", "terms")).collect()]
    assert got == [(c, n, v, 1 + 10**9 * (c + 2) // (n + 2 * v)) for c, n, v in cases]
