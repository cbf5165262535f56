"""The persistent store: greens, history and coverage as logs of segments, and a numbered manifest of them.

An append writes its own rows as a segment and then the next manifest, so what is written is in proportion to what is new,
and readers see the segments of one manifest. A manifest is only written after the one that its writer read; a writer that
comes second reads the new one and adds its segment to that, so both land. FANOUT segments of a level, one behind the
other, are merged into one of the next, so a row is written again once a level. A missing store is empty.

History segments are partial histories, which merge in any order. Of greens and coverage the newest segment with a crate
or a test has all that holds for it; a green without fingerprint is one that was cleared.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris import schemas
from verdigris.operators import history
from verdigris.storage import get_numbered, put_text, remove

TABLES = {"greens": schemas.GREENS, "history": schemas.HISTORY, "coverage": schemas.COVERAGE}
#: Of each table as its segments hold it, and what identifies the rows that replace older ones.
SEGMENTS, KEYS = TABLES | {"history": history.PARTIAL}, {"greens": "crate", "coverage": "test_id"}
FANOUT, TRIES = 8, 50


def path_for(root: str, tool: str = "verdigris") -> str:
    return f"{root.rstrip('/')}/target/{tool}/store"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> tuple[int, dict]:
        """Its number, and by table the segments (name, level), oldest first; under `streams` the last batch of each."""
        n, text = get_numbered(self.spark, f"{self.path}/CURRENT.json")
        return n, json.loads(text) if text else {}

    def version(self) -> dict[str, int]:
        """By table how many segments were ever added."""
        return self.manifest()[1].get("versions", {})

    def _read(self, table: str, segments: list) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], SEGMENTS[table] + ", segment int")
        parts = [self.spark.read.schema(SEGMENTS[table]).parquet(f"{self.path}/{table}/{name}").withColumn("segment", F.lit(k)) for k, (name, _) in enumerate(segments)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _merged(self, table: str, segments: list) -> DataFrame:
        rows = self._read(table, segments)
        if table == "history":
            return rows.drop("segment") if len(segments) < 2 else history.together(rows)
        if len(segments) < 2:
            return rows.drop("segment")
        newest = rows.groupBy(F.col(KEYS[table]).alias("__key")).agg(F.max("segment").alias("__newest"))
        return rows.join(newest, F.col(KEYS[table]).eqNullSafe(F.col("__key")) & (F.col("segment") == F.col("__newest"))).drop("__key", "__newest", "segment")

    def load(self, table: str, manifest: dict | None = None) -> DataFrame:
        """The table as of the newest manifest, or the one given."""
        rows = self._merged(table, (self.manifest()[1] if manifest is None else manifest).get(table, []))
        return history.finished(rows) if table == "history" else rows.where("fingerprint is not null") if table == "greens" else rows

    def _write(self, table: str, df: DataFrame) -> str:
        name = f"s-{uuid.uuid4().hex[:16]}"
        shape = self.spark.createDataFrame([], SEGMENTS[table]).schema
        df.select(*(df[f.name].cast(f.dataType) for f in shape)).write.parquet(f"{self.path}/{table}/{name}")
        return name

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Puts change(manifest) after the manifest that it was made from, again from the next where another came first.
        A change of None is none to make."""
        for _ in range(TRIES):
            n, now = self.manifest()
            new = change(now)
            if new is None:
                return False
            try:
                put_text(self.spark, f"{self.path}/CURRENT.json", json.dumps(new, sort_keys=True), after=n)
            except OSError:
                continue
            return True
        raise OSError(f"{self.path}: others wrote {TRIES} times")

    def append(self, batch: tuple[str, int] | None = None, **tables: DataFrame) -> bool:
        """Adds to the named tables together: a PARTIAL history, changes of greens, new coverage. With a batch, the name of
        a stream and its number, nothing is added where that batch, or a later one, was added before."""
        known = lambda m: batch is not None and m.get("streams", {}).get(batch[0], -1) >= batch[1]
        if known(self.manifest()[1]):
            return False
        added = {t: self._write(t, df) for t, df in tables.items()}

        def change(m: dict) -> dict | None:
            if known(m):
                return None
            m = m | {t: [*m.get(t, []), (name, 0)] for t, name in added.items()}
            m["versions"] = m.get("versions", {}) | {t: m.get("versions", {}).get(t, 0) + 1 for t in added}
            return m | {"streams": m.get("streams", {}) | {batch[0]: batch[1]}} if batch else m

        done = self._commit(change)
        for t in added:
            self.compact(t)
        return done

    def save(self, **tables: DataFrame) -> None:
        """Replaces the named tables together."""
        added = {t: self._write(t, history.as_partial(df) if t == "history" else df) for t, df in tables.items()}
        self._commit(lambda m: m | {t: [(name, 0)] for t, name in added.items()} | {"versions": m.get("versions", {}) | {t: m.get("versions", {}).get(t, 0) + 1 for t in added}})

    def compact(self, table: str) -> None:
        """Merges the first FANOUT neighbours of one level, and so on while there are such."""
        while True:
            segments = [tuple(x) for x in self.manifest()[1].get(table, [])]
            runs = [k for k in range(len(segments) - FANOUT + 1) if len({level for _, level in segments[k : k + FANOUT]}) == 1]
            if not runs:
                return
            old = segments[runs[0] : runs[0] + FANOUT]
            new = (self._write(table, self._merged(table, old)), old[0][1] + 1)

            def change(m: dict, old: list = old, new: tuple = new) -> dict | None:
                now = [tuple(x) for x in m.get(table, [])]
                at = next((k for k in range(len(now)) if now[k : k + FANOUT] == old), None)
                return None if at is None else m | {table: [*now[:at], new, *now[at + FANOUT :]]}

            if not self._commit(change):
                return

    def clean(self) -> None:
        """Removes segments that the newest manifest does not name; nobody may read an older one, or append, meanwhile."""
        m = self.manifest()[1]
        for table in TABLES:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            names = {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()
            for name in names - {x[0] for x in m.get(table, [])}:
                remove(self.spark, f"{self.path}/{table}/{name}")
