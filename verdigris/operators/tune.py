"""Build advice: toolchain versions, linker defaults, and a configuration text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The one host, and the first version, whose toolchain links with the fast linker by default.
FAST_LINKER = ("x86_64-unknown-linux-gnu", (1, 90, 0))
LEAST_MEMBERS = 4


def release(verbose: Column) -> Column:
    """struct<major, minor, patch> of the line `release: x.y[.z]...` in a compiler's verbose version; null without one.
    Structs compare like tuples."""
    part = lambda i: F.nullif(F.regexp_extract(verbose, r"(?m)^\s*release:\s*(\d+)\.(\d+)(?:\.(\d+))?", i), F.lit(""))
    return F.when(part(1).isNotNull(), F.struct(part(1).cast("int").alias("major"), part(2).cast("int").alias("minor"), F.coalesce(part(3), F.lit("0")).cast("int").alias("patch")))


def host(verbose: Column) -> Column:
    return F.nullif(F.regexp_extract(verbose, r"(?m)^\s*host:\s*(\S+)", 1), F.lit(""))


def fast_linker_default(host: Column, version: Column) -> Column:
    at_least = F.struct(*(F.lit(v).alias(n) for n, v in zip(("major", "minor", "patch"), FAST_LINKER[1], strict=True)))
    return (host == FAST_LINKER[0]) & (version >= at_least)


def hack_advice(members: DataFrame) -> DataFrame:
    """One row, advise: there are at least LEAST_MEMBERS members, and none is a workspace-hack crate."""
    hack = F.col("name").rlike("(^|-)workspace-hack$")
    return members.agg(((F.count(F.lit(1)) >= LEAST_MEMBERS) & ~F.coalesce(F.bool_or(hack), F.lit(False))).alias("advise"))


# Keys and values of the configuration, which are the build tool's own.
DEBUG = ("[profile.dev]", 'debug = "line-tables-only"')
UNPACKED = 'split-debuginfo = "unpacked"'
LINKER = ('linker = "clang"', 'rustflags = ["-C", "link-arg=-fuse-ld=mold"]')
NOTE = "# The default linker is fast here; this helps only where linking dominates."


def build_config(host: Column, system: Column, version: Column, has_mold: Column, has_clang: Column) -> Column:
    """A build configuration: line tables as the only debug information; kept beside the binary where the system can; on
    Linux with both tools, clang linking through mold, with a note where the toolchain's own linker is fast already.
    version: as of release(), or null."""
    links = (system == "linux") & has_mold & has_clang
    fast = F.coalesce(fast_linker_default(host, version), F.lit(False))
    note = F.when(links & fast, F.lit(NOTE + "\n")).otherwise("")
    target = F.when(links, F.concat(F.lit("[target."), host, F.lit("]\n" + "\n".join(LINKER) + "\n"))).otherwise("")
    return F.concat(F.lit("\n".join(DEBUG) + "\n"), F.when(system.isin("linux", "macos"), UNPACKED + "\n").otherwise(""), note, target)
