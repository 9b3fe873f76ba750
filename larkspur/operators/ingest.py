"""Content-addressed ingest: snapshot diff, soft deletes, atomic snapshots."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict
from ..storage import cut

KEY = ["collection", "path"]
_STATE = re.compile(r"state-(\d+)\.json\Z")


def diff(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """``(collection, path, old_hash, new_hash, action)``: add, update or deactivate; unchanged files are left out.

    scanned and stored: ``collection, path, hash``; stored holds active documents only.
    """
    both = scanned.select(*KEY, F.col("hash").alias("new_hash"), F.lit(1).alias("_new")).join(stored.select(*KEY, F.col("hash").alias("old_hash"), F.lit(1).alias("_old")), KEY, "full_outer")
    action = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "deactivate").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "update")
    return both.withColumn("action", action).where("action is not null").select(*KEY, "old_hash", "new_hash", "action")


def counts(changes: DataFrame) -> DataFrame:
    """One row ``(added, updated, deactivated)``."""
    return changes.agg(*(F.count(F.when(F.col("action") == a, 1)).alias(n) for a, n in (("add", "added"), ("update", "updated"), ("deactivate", "deactivated"))))


def apply_diff(documents: DataFrame, scanned: DataFrame, now) -> DataFrame:
    """The next documents table.

    A file keeps its ``created_at`` when it changes and when it comes back after having been deactivated; a
    file that is gone stays as an inactive row.  Collections that weren't scanned stay as they are.
    """
    seen = scanned.select("collection").distinct()
    fresh = scanned.select(*KEY, F.col("title").alias("_title"), F.col("hash").alias("_hash"), F.lit(True).alias("_seen"))
    both = documents.join(fresh, KEY, "full_outer").join(seen.withColumn("_scanned", F.lit(True)), "collection", "left")
    is_new, gone = F.col("_seen").isNotNull(), F.col("_scanned").isNotNull() & F.col("_seen").isNull()
    changed = is_new & ~(F.col("hash").eqNullSafe(F.col("_hash")) & F.col("active").eqNullSafe(True))
    return both.select(
        *KEY,
        F.when(changed, F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.when(changed, F.col("_hash")).otherwise(F.col("hash")).alias("hash"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(changed, now).otherwise(F.col("modified_at")).alias("modified_at"),
        F.when(gone, False).when(is_new, True).otherwise(F.col("active")).alias("active"),
    )


def new_content(content: DataFrame, scanned: DataFrame, now) -> DataFrame:
    """Rows ``(hash, doc, created_at)`` to append: one per hash not stored yet; the first writer's time stays."""
    rows = scanned.where("hash is not null").groupBy("hash").agg(F.min("doc").alias("doc"))
    return rows.join(content.select("hash"), "hash", "left_anti").withColumn("created_at", now)


class SnapshotStore:
    """Tables of one index as immutable folders, and a numbered state file for each commit.

    A writer fills new folders and then makes the next state file in one rename that fails where the file exists: readers
    see all of an update or nothing of it, a failed writer leaves the old state, and of two writers one gets a ``Conflict``.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the last commit, 0 for none."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return 0
        found = (_STATE.match(f.getPath().getName()) for f in fs.listStatus(self._path()))
        return max((int(m[1]) for m in found if m), default=0)

    def current(self, version: int | None = None) -> dict[str, list[str]]:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs().open(self._path(f"state-{version:08d}.json"))
        try:
            return {t: [f"{self.root}/{f}" for f in folders] for t, folders in json.loads(bytes(stream.readAllBytes()).decode()).items()}
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame | None:
        paths = self.current().get(table)
        return self.spark.read.parquet(*paths) if paths else None

    def commit(
        self,
        replaced: dict[str, DataFrame] | None = None,
        appended: dict[str, DataFrame] | None = None,
        partitioned: dict[str, str] | None = None,
        derived: dict[str, Callable[[dict[str, list[str]]], DataFrame]] | None = None,
        dropped: Sequence[str] = (),
        base: int | None = None,
    ) -> None:
        """Write tables and make them visible at once; ``derived`` ones are worked out from the folders of the others.

        With ``base``, the version an update was made from, a commit in between is a Conflict; without it only one that
        comes while the folders are written.
        """
        version = self.version()
        if base is not None and base != version:
            raise Conflict(self.root)
        state = {t: f for t, f in self.current(version).items() if t not in dropped}
        for changes, keep in ((replaced or {}, False), (appended or {}, True), (derived or {}, False)):
            for table, df in changes.items():
                folder = f"{self.root}/{table}/{uuid.uuid4().hex}"
                writer = (df(state) if callable(df) else df).write
                (writer.partitionBy(partitioned[table]) if table in (partitioned or {}) else writer).parquet(folder)
                state[table] = [*(state.get(table, []) if keep else []), folder]
        self._publish(version + 1, state)

    def _publish(self, version: int, state: dict[str, list[str]]) -> None:
        jvm, fs = self.spark._jvm, self._fs()
        fs.mkdirs(self._path())
        temporary = self._path(f".state-{uuid.uuid4().hex}")
        stream = fs.create(temporary, True)
        stream.write(bytearray(json.dumps({t: [f.removeprefix(f"{self.root}/") for f in folders] for t, folders in state.items()}).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(temporary, self._path(f"state-{version:08d}.json"), options)
        except Py4JJavaError as error:
            fs.delete(temporary, False)
            raise Conflict(self.root) from error

    def compact(self, table: str, folders: int = 16) -> None:
        """Rewrite a table that has grown by at least so many folders as one."""
        if len(self.current().get(table, [])) >= folders:
            self.commit({table: self.read(table)})

    def wipe(self) -> None:
        """Forget all tables at once; the folders stay until they are cleaned up."""
        self._publish(self.version() + 1, {})

    def clean(self) -> None:
        """Delete folders that no state since the last commit names, and older states; for times without readers of those."""
        fs, version = self._fs(), self.version()
        used = {f for folders in self.current(version).values() for f in folders}
        for f in fs.listStatus(self._path()) if version else []:
            name = f.getPath().getName()
            if f.isDirectory():
                for g in fs.listStatus(f.getPath()):
                    if f"{self.root}/{name}/{g.getPath().getName()}" not in used:
                        fs.delete(g.getPath(), True)
            elif name != f"state-{version:08d}.json":
                fs.delete(f.getPath(), False)

    def size(self) -> int:
        """Bytes of the folder."""
        return self._fs().getContentSummary(self._path()).getLength() if self._fs().exists(self._path()) else 0

    def move(self, root: str) -> SnapshotStore:
        """The store under another name; paths in states are relative, so nothing is rewritten."""
        new = SnapshotStore(self.spark, root)
        fs = self._fs()
        if fs.exists(self._path()):
            fs.mkdirs(new._path().getParent())
            fs.rename(self._path(), new._path())
        return new

    def delete(self) -> None:
        self._fs().delete(self._path(), True)


def documents(store: SnapshotStore) -> DataFrame | None:
    """The documents table with the changes that batches have logged since it was written."""
    state = store.current()
    parts = [store.spark.read.parquet(*state[t]) for t in ("documents", "changes") if state.get(t)]
    if not state.get("changes"):
        return parts[0] if parts else None
    if state.get("documents"):
        parts[0] = parts[0].withColumn("seq", F.lit(0).cast("long"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    values = F.struct("title", "hash", "created_at", "modified_at", "active")
    return rows.groupBy(*KEY).agg(F.max_by(values, "seq").alias("d")).select(*KEY, "d.*")


def merge_changes(store: SnapshotStore, folders: int = 16) -> None:
    """Fold logged changes into the documents table when there are so many folders of them."""
    if len(store.current().get("changes", [])) >= folders:
        store.commit({"documents": documents(store)}, dropped=["changes"])


def update(store: SnapshotStore, scanned: DataFrame, force: bool = False) -> dict[str, int]:
    """Bring the index up to the scanned files: ``collection, path, title, hash, doc``.

    With ``force`` the stored documents and contents are replaced in the same commit.
    """
    return changed(store, scanned, force)[0]


def changed(store: SnapshotStore, scanned: DataFrame, force: bool = False) -> tuple[dict[str, int], DataFrame]:
    """``update``, and the changes as ``diff`` gives them.

    The scan and the changes are written to the shared folder first, so that files are read once, whatever uses them.
    """
    now, base = F.current_timestamp(), store.version()
    stored, content = (None, None) if force else (documents(store), store.read("content"))
    scanned = cut(scanned)
    empty = scanned.limit(0)
    stored = stored if stored is not None else empty.select(*KEY, "title", "hash", now.alias("created_at"), now.alias("modified_at"), F.lit(True).alias("active"))
    content = content if content is not None else empty.select("hash", "doc", now.alias("created_at"))
    changes = cut(diff(scanned, stored.where("active")))
    new = new_content(content, scanned, now)
    store.commit({"documents": apply_diff(stored, scanned, now)} | ({"content": new} if force else {}), {} if force else {"content": new}, dropped=["changes"], base=base)
    return counts(changes).first().asDict(), changes


def location(root: str, collection: str) -> str:
    """Folder of one collection's index."""
    return os.path.join(root, collection)
