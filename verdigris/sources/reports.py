"""Reports of test tools: outcome XML, coverage exports, run histories, package metadata, test lists."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris import schemas
from verdigris.operators.ranges import united

# Children of a testcase that make it failed, or flaky.
FAILED = ("failure", "error")
RETRIED = ("flakyFailure", "flakyError", "rerun", "rerunFailure")
#: A coverage region over more lines is not believed.
MAX_SPAN = 1_000_000


def _cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """suite, name, time, failed, retried of each testcase, at any depth."""
    for b in batches:
        for text in b.column(0).to_pylist():
            out: list[list] = []
            suites, case = [""], []

            def start(tag: str, at: dict, out=out, suites=suites, case=case) -> None:
                if tag == "testsuite":
                    suites.append(at.get("name") or suites[-1])
                elif tag == "testcase":
                    case.append([suites[-1], at.get("name", ""), at.get("time"), False, False])
                elif case and tag in FAILED:
                    case[-1][3] = True
                elif case and tag in RETRIED:
                    case[-1][4] = True

            def end(tag: str, out=out, suites=suites, case=case) -> None:
                if tag == "testsuite":
                    suites.pop()
                elif tag == "testcase":
                    out.append(case.pop())

            parser = expat.ParserCreate()
            parser.StartElementHandler, parser.EndElementHandler = start, end
            parser.Parse(text or "", True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=["suite", "name", "time", "failed", "retried"])


def outcomes(reports: DataFrame, text: str = "text") -> DataFrame:
    """id, passed, flaky, duration_ms of each testcase of XML texts, however deep its suite lies in others. The id is
    suite::name with the innermost suite around it that has a name, or the name alone. A failure outweighs retries; a
    skipped case passes. Malformed XML raises. Depth has no bound in XML but has one in a schema, hence the parser."""
    c = reports.select(text).mapInArrow(_cases, "suite string, name string, time string, failed boolean, retried boolean")
    return c.select(
        F.when(F.col("suite") == "", F.col("name")).otherwise(F.concat_ws("::", "suite", "name")).alias("id"),
        (~F.col("failed")).alias("passed"),
        (F.col("retried") & ~F.col("failed")).alias("flaky"),
        F.round(F.expr("try_cast(time as double)") * 1000).cast("bigint").alias("duration_ms"),
    )


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return outcomes(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def covered_ranges(exports: DataFrame, keys: list[str], text: str = "text", max_span: int | None = None, lenient: bool = True) -> DataFrame:
    """keys, file, first, last: the lines that coverage exports (JSON texts) count as run, as the fewest ranges for each
    key; a region of any length is a row. A region is [first line, column, last line, column, count, file, expanded file,
    kind, ...]; regions of another kind, without a count, from macro expansions, or malformed are left out. With max_span
    a region over more lines is left out too; without lenient its whole export is, so that its tests count as uncovered."""
    parsed = exports.select(*keys, F.from_json(text, schemas.COVERAGE_EXPORT)["data"].alias("data"))
    parsed = parsed.select(*keys, F.flatten(F.transform(F.coalesce("data", F.array()), lambda d: F.coalesce(d["functions"], F.array()))).alias("functions"))
    at = lambda r, i: F.get(r, F.lit(i))

    def counted(r: Column) -> Column:
        cells = F.forall(F.slice(r, 1, 8), lambda x: x.isNotNull())
        return (F.size(r) >= 8) & cells & (at(r, 7) == 0) & (at(r, 4) > 0) & (at(r, 6) == 0) & (at(r, 2) >= at(r, 0))

    long = lambda r: counted(r) & (at(r, 2) - at(r, 0) > max_span) if max_span is not None else F.lit(False)
    if not lenient:
        parsed = parsed.where(~F.exists("functions", lambda f: F.exists(F.coalesce(f["regions"], F.array()), lambda r: F.coalesce(long(r), F.lit(False)))))
    f = parsed.select(*keys, F.explode("functions").alias("f")).select(*keys, F.col("f.filenames").alias("names"), F.explode("f.regions").alias("r"))
    f = f.where(F.coalesce(counted(F.col("r")) & ~long(F.col("r")), F.lit(False)))
    file = F.get("names", at(F.col("r"), 5).try_cast("int"))
    f = f.select(*keys, file.alias("file"), at(F.col("r"), 0).cast("bigint").alias("first"), at(F.col("r"), 2).cast("bigint").alias("last")).where("file is not null")
    return united(f, [*keys, "file"])


def covered_lines(exports: DataFrame, keys: list[str], text: str = "text", lenient: bool = True) -> DataFrame:
    """keys, file, line: covered_ranges() line by line, without regions over more than MAX_SPAN lines."""
    return covered_ranges(exports, keys, text, MAX_SPAN, lenient).select(*keys, "file", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("line"))


def relative(coverage: DataFrame, root: str) -> DataFrame:
    """coverage with files relative to root, without files outside it."""
    base = root.rstrip("/") + "/"
    return coverage.where(F.col("file").startswith(base)).withColumn("file", F.substr("file", F.lit(len(base) + 1)))


def relative_path(path: Column, root: str) -> Column:
    """path without root, with forward slashes."""
    base = root.rstrip("/") + "/"
    return F.translate(F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path), "\\", "/")


def runs(texts: DataFrame, text: str = "text") -> DataFrame:
    """id, passes, fails of run-history texts: one JSON array, or one JSON object a line; blank lines are skipped. What
    is malformed, or lacks a field, raises. Repeated ids stay separate."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s]+|[\s]+$", ""))
    row = "struct<id:string,passes:bigint,fails:bigint>"
    rows = F.when(t.startswith("["), F.from_json(t, f"array<{row}>", {"mode": "FAILFAST"})).otherwise(F.transform(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, row, {"mode": "FAILFAST"})))
    r = texts.select(F.explode(rows).alias("r")).select("r.*")
    whole = F.col("id").isNotNull() & F.col("passes").isNotNull() & F.col("fails").isNotNull() & (F.col("passes") >= 0) & (F.col("fails") >= 0)
    wrong = F.raise_error(F.concat(F.lit("a run lacks id, passes or fails: "), F.to_json(F.struct("id", "passes", "fails")))).cast("string")
    return r.withColumn("id", F.when(whole, F.col("id")).otherwise(wrong))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return runs(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def metadata(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """members (name, manifest_dir) and edges (crate, dep) of package metadata (JSON): packages that are workspace
    members; dependencies of any kind on other members, by name, once each."""
    m = texts.select(F.from_json(text, schemas.METADATA, {"mode": "FAILFAST"}).alias("m"))
    ids = F.col("m.workspace_members")
    p = m.select(ids.alias("ids"), F.explode("m.packages").alias("p")).where(F.array_contains("ids", F.col("p.id"))).select("p.*")
    members = p.select("name", F.regexp_replace("manifest_path", "/[^/]*$", "").alias("manifest_dir")).distinct()
    edges = p.select(F.col("name").alias("crate"), F.explode("dependencies").alias("d")).select("crate", F.col("d.name").alias("dep"))
    return members, edges.join(members.select(F.col("name").alias("dep")).distinct(), "dep", "left_semi").select("crate", "dep").distinct()


def test_names(lines: DataFrame, line: str = "line") -> DataFrame:
    """test: of a runner's listing, in which tests end in `: test`."""
    return lines.where(F.col(line).endswith(": test")).select(F.regexp_replace(line, ": test$", "").alias("test"))


def test_binaries(lines: DataFrame, line: str = "line") -> DataFrame:
    """executable: of the test artifacts among a build's JSON messages; other lines are skipped."""
    v = lines.select(F.from_json(line, "reason string, profile struct<test:boolean>, executable string").alias("v"))
    return v.where("v.reason = 'compiler-artifact' and v.profile.test and v.executable is not null").select("v.executable")


def is_object_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{1,64}$"), F.lit(False))
