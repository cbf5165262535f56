"""Folders that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def base_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local-mode session (tests) gets a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="verdigris-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under base_dir(); what is written there lasts until the session's owner removes it."""
    return f"{base_dir(spark)}/verdigris/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """df, written to path as Parquet and read again: later steps restart from these files if executors are lost."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, path: str, column: str, n: int) -> tuple[DataFrame, str]:
    """df, written to path in n buckets by column, and the name of the table: joins and groups by the column need no
    exchange of these rows again. Whoever asked drops the table; its files stay with the other work files."""
    spark, name = df.sparkSession, f"verdigris_{uuid.uuid4().hex[:12]}"
    df.repartition(n, column).write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, column).saveAsTable(name)
    return spark.table(name), name


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def put_text(spark: SparkSession, path: str, text: str, after: int | None = None) -> None:
    """Writes a small file as the next of a sequence path.1, path.2, ... (as the one after number `after`, where given):
    aside first, then renamed to a name that was not there, so that readers see whole files and never none. Of two that
    write at once one fails. Older ones but the last are removed."""
    fs, p = _fs(spark, path)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    n = _numbers(fs, p)
    after = max(n, default=0) if after is None else after
    aside, to = path_of(f"{path}.aside-{uuid.uuid4().hex[:8]}"), path_of(f"{path}.{after + 1}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(to) or not fs.rename(aside, to):
        fs.delete(aside, False)
        raise OSError(f"{to} was written by another")
    for k in sorted(n)[:-1]:
        fs.delete(path_of(f"{path}.{k}"), False)


def _numbers(fs, p) -> list[int]:
    """The numbers of the sequence's files."""
    if not fs.exists(p.getParent()):
        return []
    name = p.getName() + "."
    found = [s.getPath().getName() for s in fs.listStatus(p.getParent())]
    return [int(x[len(name) :]) for x in found if x.startswith(name) and x[len(name) :].isdigit()]


def get_text(spark: SparkSession, path: str) -> str | None:
    """The newest file of the sequence; None without one."""
    return get_numbered(spark, path)[1]


def get_numbered(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The number and text of the newest file of the sequence; 0 and None without one."""
    n = _numbers(*_fs(spark, path))
    return (max(n), spark.read.text(f"{path}.{max(n)}", wholetext=True).first()[0]) if n else (0, None)
