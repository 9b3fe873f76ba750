"""Collections, their indexes and searches over them: what the command line drives."""

from __future__ import annotations

import hashlib
import logging
import os

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CollectionNotFound, EngineError
from ..operators import embedding, ingest, postings
from ..operators.expansion import SubQuery
from ..operators.models import Embedder, HashingEmbedder, OverlapScorer, QueryExpander
from ..sources.files import read_files
from ..sources.registry import Collection, Registry
from .pipeline import Outcome, SearchSession

log = logging.getLogger(__name__)


class CachedExpander:
    """An expander whose own results are kept in a store, by model and normal query; failures aren't kept."""

    def __init__(self, inner: QueryExpander, store: ingest.SnapshotStore) -> None:
        self.inner, self.store, self.model_id = inner, store, inner.model_id

    def expand_query(self, query: str) -> list[SubQuery]:
        key = hashlib.sha256(f"{self.model_id}\0{query.strip(' ').lower()}".encode()).hexdigest()
        known = self.store.read("expansions")
        row = known.where(F.col("key") == key).orderBy(F.desc("created_at")).limit(1).first() if known is not None else None
        if row is not None:
            return [SubQuery(s["kind"], s["text"]) for s in row["subs"]]
        subs = self.inner.expand_query(query)
        made = self.store.spark.createDataFrame([(key, [tuple(s) for s in subs])], "key string, subs array<struct<kind: string, text: string>>")
        self.store.commit(appended={"expansions": made.withColumn("created_at", F.current_timestamp())})
        return subs


class Engine:
    """A local ``collections.yml`` in ``home``, and an index folder per collection and the caches below ``index``.

    index is a folder of any file system that all executors share; only on one machine it defaults to ``home``.
    """

    def __init__(self, spark: SparkSession, home: str, embedder: Embedder | None = None, scorer=None, expander=None, profile: str = "generic", index: str | None = None, analyzer: str = "porter") -> None:
        if index is None and not spark.sparkContext.master.startswith("local"):
            raise EngineError("name an index folder that all executors share")
        self.spark, self.home, self.profile, self.analyzer = spark, home, profile, analyzer
        self.index_root = index or "file://" + os.path.abspath(home)
        self.registry = Registry(os.path.join(home, "collections.yml"))
        self.embedder, self.scorer = embedder or HashingEmbedder(), scorer or OverlapScorer()
        self.caches = ingest.SnapshotStore(spark, f"{self.index_root}/caches")
        self.expander = CachedExpander(expander, self.caches) if expander is not None else None

    def store(self, name: str) -> ingest.SnapshotStore:
        return ingest.SnapshotStore(self.spark, ingest.location(f"{self.index_root}/index", name))

    def postings(self, name: str) -> postings.IndexStore:
        return postings.IndexStore(ingest.SnapshotStore(self.spark, ingest.location(f"{self.index_root}/postings", name)), self.analyzer)

    def add(self, collection: Collection) -> None:
        self.registry.add(collection)

    def remove(self, name: str, purge: bool = False) -> None:
        self.registry.remove(name)
        if purge:
            self.store(name).delete()
            self.postings(name).store.delete()

    def rename(self, old: str, new: str) -> None:
        """Renames the index with the entry."""
        self.registry.rename(old, new)
        moved = self.store(old).move(ingest.location(f"{self.index_root}/index", new))
        self.postings(old).store.delete()
        documents = ingest.documents(moved)
        if documents is not None:
            moved.commit({"documents": documents.withColumn("collection", F.lit(new))}, dropped=["changes"])
            self.postings(new).replace(self._documents([new]))

    def update(self, name: str, force: bool = False) -> dict[str, int]:
        """Bring documents, contents and postings up to the files; only what changed is tokenized."""
        c = self.registry.get(name)
        found, changes = ingest.changed(self.store(name), read_files(self.spark, name, c.path, c.globs, c.excludes), force)
        index = self.postings(name)
        if force or index.index() is None:
            index.replace(self._documents([name]))
        elif any(found.values()):
            fresh = self._documents([name]).join(changes.where("action <> 'deactivate'").select("collection", "path"), ["collection", "path"], "left_semi")
            index.add(fresh, changes)
        return found

    def _documents(self, names: list[str]) -> DataFrame:
        """Active ``collection, path, title, body, hash``."""
        documents, content = self._all(names, "documents"), self._all(names, "content")
        if documents is None:
            raise EngineError("nothing is indexed")
        return documents.where("active").join(content.groupBy("hash").agg(F.min("doc").alias("body")), "hash").select("collection", "path", "title", "body", "hash")

    def embed(self, name: str, force: bool = False) -> dict[str, int]:
        """Drop orphaned vectors and embed what has none; everything with ``force``."""
        store = self.store(name)
        documents, content, stored = ingest.documents(store), store.read("content"), store.read("vectors")
        if documents is None:
            raise EngineError(f"{name} isn't indexed yet")
        if stored is None or force:
            stored = self.spark.createDataFrame([], "hash string, seq int, pos long, model string, embedding array<float>, embedded_at timestamp")
        width = len(self.embedder.embed_query("width"))
        if width < 1:
            raise EngineError("the embedder makes vectors without dimensions")
        if not stored.where(F.size("embedding") != width).isEmpty():
            # Vectors of another model's width can't be compared: all are made anew.
            stored = stored.limit(0)
        pending = embedding.unembedded(documents, stored).select("hash")
        titles = documents.where("active").groupBy("hash").agg(F.min(F.struct("path", "title")).alias("t")).select("hash", "t.title")
        new = embedding.embed(content.join(pending, "hash", "left_semi").join(titles, "hash").select("hash", "title", "doc"), self.embedder, profile=self.profile)
        kept = embedding.without(stored, embedding.orphans(documents, stored))
        before = kept.count()
        store.commit({"vectors": embedding.upserted(kept, new, ["hash", "seq"])})
        return {"documents": pending.count(), "chunks": store.read("vectors").count() - before}

    def _all(self, names: list[str], table: str) -> DataFrame | None:
        read = ingest.documents if table == "documents" else lambda store: store.read(table)
        parts = [p for p in (read(self.store(n)) for n in names) if p is not None]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def readable(self, names: list[str]) -> list[str]:
        """The collections whose index can be opened; the others are logged and passed over, unless none is left."""
        good, failed = [], []
        for name in names:
            try:
                self._all([name], "documents")
                good.append(name)
            except (AnalysisException, Py4JJavaError, ValueError) as error:
                log.warning("collection %s is passed over: %s", name, error)
                failed.append(name)
        if failed and not good:
            raise EngineError(f"no index can be read: {', '.join(failed)}")
        return good

    def session(self, names: list[str]) -> SearchSession:
        names = self.readable(names)
        docs, content, chunks = self._documents(names), self._all(names, "content"), self._all(names, "vectors")
        indexes = [i for i in (self.postings(n).index() for n in names) if i is not None]
        index = postings.Index.union(indexes) if indexes else None
        return SearchSession(docs, chunks, content, self.embedder if chunks is not None else None, self.expander, self.scorer, self.caches.read("scores"), self.analyzer, self.profile, index)

    def search(self, query: str, names: list[str] = (), limit: int = 10, mode: str = "hybrid", min_score: float | None = None) -> Outcome:
        session = self.session(self.registry.resolve(list(names), os.getcwd()))
        outcome = session.search(query, limit, mode, min_score)
        for made in session.new_scores:
            self.caches.commit(appended={"scores": made.withColumn("created_at", F.current_timestamp())})
        self.caches.compact("scores")
        return outcome

    def get(self, target: str) -> str:
        """The text of ``collection/path`` or of a ``#`` id."""
        for name in self.registry.names():
            documents, content = ingest.documents(self.store(name)), self.store(name).read("content")
            if documents is None:
                continue
            wanted = F.col("hash").startswith(target[1:]) if target.startswith("#") else F.concat_ws("/", "collection", "path") == target
            row = documents.where("active").where(wanted).join(content, "hash").select("doc").limit(1).first()
            if row:
                return row["doc"]
        raise CollectionNotFound(target)

    def status(self) -> list[dict]:
        """Name, path, whether it is indexed, and the index's size in MiB."""
        out = []
        for c in self.registry.collections:
            size = self.store(c.name).size() + self.postings(c.name).store.size()
            out.append({"name": c.name, "path": c.path, "indexed": bool(self.store(c.name).current()), "mib": round(size / 1048576, 1)})
        return out
