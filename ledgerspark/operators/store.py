"""A store of versioned tables: a source is replaced as a whole or not at all, and readers see one version.

Every publish writes new folders and then one numbered file that names them, under another name first; the version with the
highest number is current. Older ones stay until then and after, so there is always one to read, and an unsafe scan or a
publish that fails on the way changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matching, rollup

TABLES = ("records", "cursors", "buckets", "projects")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _current(self) -> tuple[int, dict]:
        """The highest version's number and content: folders of tables, and marks of what has been applied."""
        fs, pattern = self._fs("version-*.json")
        found = [x.getPath().getName() for x in (fs.globStatus(pattern) or [])]
        if not found:
            return 0, {"tables": {}, "marks": {}}
        content = self.spark.read.text(f"{self.path}/{max(found)}", wholetext=True).first()[0]
        return int(max(found)[len("version-") : -len(".json")]), json.loads(content)

    def versions(self) -> dict[str, str]:
        """The folder of each table that is current."""
        return self._current()[1]["tables"]

    def marks(self) -> dict[str, int]:
        """The number of the last batch applied, by stream."""
        return self._current()[1]["marks"]

    def table(self, name: str) -> DataFrame | None:
        folder = self.versions().get(name)
        return self.spark.read.parquet(f"{self.path}/{folder}") if folder else None

    def publish(self, marks: dict[str, int] | None = None, **tables: DataFrame | None) -> None:
        """All the given tables and marks at once; None drops a table."""
        number, now = self._current()
        for name, df in tables.items():
            if df is None:
                now["tables"].pop(name, None)
                continue
            folder = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            now["tables"][name] = folder
        now["marks"] |= marks or {}
        fs, draft = self._fs(f".draft-{uuid.uuid4().hex}.json")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        _, target = self._fs(f"version-{number + 1:012d}.json")
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"version {number + 1} has been published by another writer")

    def replace_source(self, source: str, records: DataFrame, cursors: DataFrame, safe: bool = True) -> dict[str, int]:
        """The records and cursors of one source as they are now, and buckets anew if anything changed.

        Returns how many records and cursors changed; nothing happens if the scan wasn't safe."""
        if not safe:
            return {"record_changes": 0, "cursor_changes": 0}
        if not cursors.filter(~F.col("source").eqNullSafe(F.lit(source))).isEmpty():
            raise ValueError("SOURCE_SNAPSHOT_CURSOR_MISMATCH")
        changes, now = {}, {}
        for name, new, key in (("records", records, "id"), ("cursors", cursors, "path")):
            old = self.table(name)
            if old is None:
                old = new.limit(0)
            now[name] = matching.replaced_source(old, new, source)
            diff = matching.snapshot_diff(old.filter(F.col("source") == source), new.select(*old.columns), key)
            changes[name] = diff.filter("change <> 'same'").count()
        if any(changes.values()):
            self.publish(records=now["records"], cursors=now["cursors"], buckets=rollup.buckets(now["records"]))
        return {"record_changes": changes["records"], "cursor_changes": changes["cursors"]}

    def commit_scan(self, source: str, path: str, records: DataFrame, cursor: DataFrame, replace: bool = False) -> int:
        """One file's scan: its records by id and its cursor; with replace its older rows go first. Returns how many rows changed."""
        old, cursors = self.table("records"), self.table("cursors")
        old = records.limit(0) if old is None else old
        cursors = cursor.limit(0) if cursors is None else cursors
        mine = F.col("source").eqNullSafe(F.lit(source)) & F.col("source_path").eqNullSafe(F.lit(path))
        kept = old.filter(~mine) if replace else old
        diff = matching.snapshot_diff(kept.join(records.select("id"), "id", "left_semi"), records.select(*old.columns), "id")
        changed = diff.filter("change <> 'same'").count() + (old.filter(mine).count() if replace else 0)
        now = matching.upserted(kept, records.select(*old.columns))
        others = cursors.filter(~(F.col("source").eqNullSafe(F.lit(source)) & (F.col("path") == path)))
        self.publish(records=now, cursors=others.unionByName(cursor.select(*cursors.columns)), buckets=rollup.buckets(now))
        return changed

    def commit_scans(self, source: str, records: DataFrame, cursors: DataFrame, replaced: DataFrame, **more: DataFrame) -> int:
        """The scans of many files in one publish: rows of replaced files (path) go, records come by id, and the cursors of what was read.

        more: other tables to publish with them. Returns how many records changed; without a cursor nothing is published."""
        if cursors.isEmpty():
            return 0
        old, held = self.table("records"), self.table("cursors")
        old = records.limit(0) if old is None else old
        held = cursors.limit(0) if held is None else held
        mine = F.col("source").eqNullSafe(F.lit(source))
        paths = replaced.select(F.col("path").alias("source_path"), F.lit(True).alias("_gone"))
        marked = old.join(paths, "source_path", "left")
        gone = mine & F.col("_gone").isNotNull()
        kept, out = marked.filter(~gone).select(*old.columns), marked.filter(gone)
        diff = matching.snapshot_diff(kept.join(records.select("id"), "id", "left_semi"), records.select(*old.columns), "id")
        changed = diff.filter("change <> 'same'").count() + out.count()
        tables = dict(more)
        if changed:
            tables["records"] = matching.upserted(kept, records.select(*old.columns))
            tables["buckets"] = rollup.buckets(tables["records"])
        read = cursors.select("source", "path").withColumns({"_s": F.col("source"), "_p": F.col("path")}).select("_s", "_p")
        others = held.join(read, (F.col("source") == F.col("_s")) & (F.col("path") == F.col("_p")), "left_anti")
        self.publish(cursors=others.unionByName(cursors.select(*held.columns)), **tables)
        return changed

    def move_file(self, old_path: str, new_path: str, size: int | None = None) -> None:
        """A file that was moved keeps its rows under its new path; one that is shorter now than what was read of it is read anew."""

        def moved(column: str):
            return F.when(F.col(column) == old_path, new_path).otherwise(F.col(column))

        records, cursors = self.table("records"), self.table("cursors")
        tables = {}
        if records is not None:
            tables["records"] = records.withColumn("source_path", moved("source_path"))
        if cursors is not None:
            if size is not None:
                shorter = (F.col("path") == old_path) & (F.col("offset") > size)
                for name in {"offset", "pending"} & {*cursors.columns}:
                    cursors = cursors.withColumn(name, F.when(shorter, F.lit(0).cast("long")).otherwise(F.col(name)))
            tables["cursors"] = cursors.withColumn("path", moved("path"))
        if tables:
            self.publish(**tables)

    def reset(self) -> None:
        """All statistics go; projects stay."""
        self.publish(records=None, cursors=None, buckets=None)


def needs_scan(listing: DataFrame, cursors: DataFrame, version: int) -> DataFrame:
    """path, change of files that are new, gone, grown or changed, or were read by another parser version."""
    known = cursors.select("path", F.col("size").alias("_size"), F.col("modified_ms").alias("_time"), F.col("version").alias("_version"))
    joined = listing.select("path", "size", "modified_ms").join(known, "path", "full")
    change = (
        F.when(F.col("_size").isNull(), "new")
        .when(F.col("size").isNull(), "gone")
        .when(F.col("_version") != version, "version")
        .when(F.col("size") > F.col("_size"), "grown")
        .when((F.col("size") != F.col("_size")) | (F.col("modified_ms") != F.col("_time")), "changed")
    )
    return joined.select("path", change.alias("change")).filter("change is not null")
