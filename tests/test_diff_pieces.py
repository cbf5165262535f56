"""Diffs in pieces against a parser that goes line by line."""

import random
import re

from pyspark.sql import functions as F

from verdigris.sources import diff


def plain(text):
    old_left = new_left = 0
    old = new = None
    named = False
    for line in text.split("\n"):
        if line.startswith("@@ "):
            m = re.match(r"@@ (?:[^-\s]\S* )*-(\d+)(?:,(\d+))?(?:\s+[+]\d+(?:,(\d+))?)?(?=\s|$)", line, re.ASCII)
            ok = m is not None and int(m[1]) < 2**31
            old_left = (int(m[2]) if m[2] else 1) if ok else 0
            new_left = (int(m[3]) if m and m[3] else 1) if re.match(r"@@ [^+]*[+]\d+(?=[\s,])", line) else 0
            file = (new if new is not None else old) if named else None
            if ok and file is not None:
                yield file, int(m[1]), old_left
            continue
        if line.startswith("diff "):
            old_left = new_left = 0
        strip = lambda x: None if (x := x[4:].split("\t")[0].strip(" ")) == "/dev/null" else re.sub("^[ab]/", "", x)
        if line.startswith("--- ") and old_left <= 0:
            old, new, named = strip(line), None, False
        elif line.startswith("+++ ") and new_left <= 0:
            new, named = strip(line), True
        old_left -= line[:1] in ("-", " ", "")
        new_left -= line[:1] in ("+", " ", "")


def made(r, n):
    kinds = ["--- a/f{0}", "+++ b/g{0}\tx", "+++ /dev/null", "--- /dev/null", "@@ -{0},{1} +{2},{1} @@ fn", "@@ -{0} +{2} @@", "@@ bad @@", "diff --git a b", " ctx", "-gone", "+new", "", "--- x", "+++ y", "\\ No newline", "@@ -99999999999 +1 @@", "\u00e9t\u00e9"]
    return "\n".join(r.choice(kinds).format(r.randrange(50), r.randrange(6), r.randrange(50)) for _ in range(n))


def test_pieces_agree_with_a_parser_by_line(spark):
    r = random.Random(11)
    texts = [made(r, r.randrange(0, 200)) for _ in range(60)] + ["", "\n", None, "+++ b/x\n" + "@@ -1 +1 @@\n" * 3, "--- a/q\n+++ /dev/null\n" + " pad\n" * 100 + "@@ -7,2 +0,0 @@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted((k, *x) for k, t in enumerate(texts) for x in plain(t or ""))
    for piece in (1, 40, 333, 1 << 20):
        assert sorted(map(tuple, diff.hunks(df, piece=piece).collect())) == want, piece
    apart = spark.createDataFrame([(0, "++"), (1, "+ b/x\n@@ -3 +3 @@")], "doc_id long, text string").coalesce(1)
    assert diff.hunks(apart).count() == 0, "a header does not begin in one text and end in the next"
    named = df.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("body"))
    assert diff.hunks(named, "id", "body", 50).count() == len(want)


def test_one_long_diff_is_dealt_out(spark):
    """A single diff of a million lines: its pieces lie in many partitions, and its hunks are whole."""
    body = F.expr("concat('--- a/x', id, '\n+++ b/x', id, '\n@@ -', id, ',3 +1,3 @@\n a\n--- b\n+++ c\n d\n+e\n')")
    one = spark.range(125_000).agg(F.array_join(F.sort_array(F.collect_list(F.struct("id", body.alias("t")))).getField("t"), "").alias("text")).select(F.lit(1).alias("doc_id"), "text")
    got = diff.hunks(one, piece=1 << 18)
    assert got.agg(F.count("*"), F.sum("old_start"), F.sum("old_count"), F.count_if(F.col("file") == F.concat(F.lit("x"), "old_start"))).first() == (125_000, 125_000 * 124_999 // 2, 375_000, 125_000)
