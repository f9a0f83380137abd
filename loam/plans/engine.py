"""The engine: index a tree, search it, keep it fresh, report its status, clear it.

An index is a folder of Parquet tables.  ``chunks`` (with their vectors), ``postings`` and
``lengths`` lie by namespace and batch: a refresh writes one batch, which holds the changed files
alone.  ``state`` has a row per file, which names the batch that holds the file now, and lies by
namespace and version; rows of other batches are dead.  When too many are, all are written anew.

The catalog is a folder per version and one file that names the valid one.  It is written last,
so a write that fails midway leaves everything as it was.  One writer holds a namespace's lock.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.config import Config
from loam.functions import text as X
from loam.operators import chunks as C
from loam.operators import filters, language, search, store, symbols, units
from loam.sources import files as sources
from loam.sources.tables import collect_bounded

Embedder = Callable[[Column], Column]
Reranker = Callable[[Column, Column], Column]
Chunker = Callable[[DataFrame, int], DataFrame]

CATALOG = "path string, namespace string, total_chunks bigint, total_files bigint, indexed_at timestamp, failed boolean, failure_reason string, version bigint"
TABLES = ("chunks", "postings", "lengths")
FEW = 10_000  # files that are read by name; more are read by a scan
STALE_SECONDS = 1800  # after which a lock is a dead writer's
DEAD_SHARE = 0.3  # of chunks, beyond which all are written anew


@dataclass
class Response:
    """The rows of a search and how they came about."""

    success: bool
    strategy: str
    results: DataFrame | None = None
    message: str = ""
    metadata: dict = field(default_factory=dict)


class Locked(RuntimeError):
    """Another writer holds the namespace."""


class Engine:
    """``embedder`` maps a text column to a vector column, ``reranker`` a query and a text to a
    relevance, and ``chunker`` cuts files; the defaults hash terms, weigh them, and cut units."""

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None, chunker: Chunker | None = None):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config or Config()
        if problems := self.config.problems():
            raise ValueError("; ".join(problems))
        self.embedder = embedder or (lambda c: search.embed(c, self.config.dim).cast("array<float>"))
        self.reranker = reranker or search.lexical_relevance
        self.chunker = chunker or units.semantic_chunks

    # --- storage ---

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _read_text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, path: str, text: str, overwrite: bool) -> bool:
        """Write a small file; false if it is there and must not be replaced."""
        fs, p = self._fs(path)
        fs.mkdirs(p.getParent())
        if not overwrite and not fs.createNewFile(p):
            return False
        stream = fs.create(p, True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        return True

    @contextmanager
    def _lock(self, namespace: str):
        """Hold a namespace's lock; one older than ``STALE_SECONDS`` or unreadable is taken over."""
        path = f"{self.folder}/locks/{namespace}"
        if not self._write_text(path, str(time.time()), overwrite=False):
            said = self._read_text(path) or ""
            fresh = re.fullmatch(r"\d+(\.\d+)?", said) and time.time() - float(said) < STALE_SECONDS
            if fresh:
                raise Locked(f"{namespace} is being written")
            self._write_text(path, str(time.time()), overwrite=True)
        try:
            yield
        finally:
            self._remove(path)

    def lock_state(self, root: str) -> str | None:
        """When the root's lock was taken, in seconds; null if it is free."""
        return self._read_text(f"{self.folder}/locks/{self.namespace(root)}")

    def _catalog(self) -> DataFrame:
        version = self._read_text(f"{self.folder}/catalog/current")
        if not version:
            return self.spark.createDataFrame([], CATALOG)
        return self.spark.read.schema(CATALOG).parquet(f"{self.folder}/catalog/v{version}")

    def _commit(self, rows: DataFrame) -> None:
        now = self._read_text(f"{self.folder}/catalog/current")
        after = int(now or 0) + 1
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/catalog/v{after}")
        self._write_text(f"{self.folder}/catalog/current", str(after), overwrite=True)
        self._remove(f"{self.folder}/catalog/v{after - 2}")  # a reader may still hold the one before

    def _entry(self, root: str):
        return self._catalog().where(F.col("path") == root.rstrip("/")).first()

    def _state(self, entry) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/state/namespace={entry['namespace']}/version={entry['version']}")

    def _of(self, name: str, entry) -> DataFrame:
        """The live rows of a table: those whose batch is the one that holds their file."""
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}/namespace={entry['namespace']}").parquet(f"{self.folder}/{name}/namespace={entry['namespace']}/batch=*")
        live = self._state(entry).select(F.col("path").alias("file_path"), "batch")
        return rows.join(live, ["file_path", "batch"], "left_semi").drop("batch")

    def namespace(self, root: str) -> str:
        return self.spark.range(1).select(X.namespace_id(F.lit(root.rstrip("/")), self.config.api_key).alias("n")).first()["n"]

    # --- indexing ---

    def build_chunks(self, files: DataFrame) -> DataFrame:
        """The chunks of files: units, oversized ones packed from their sections, with the symbols
        that lie in them, the imports up to their ends, those of the exports that they define, and
        their vectors.  Files that the filter leaves out have none."""
        # what is read more than once is written: the files that are kept, their chunks, their symbols
        kept = store.materialize(filters.keep(files).select("path", "rel_path", "content", language.detect("rel_path", "content")["language"].alias("told")))
        cut = store.materialize(self.chunker(kept.select("path", "rel_path", "content"), self.config.chunking.max_chunk_size))
        parts = C.sub_chunks(cut.select("id", "content"), self.config.chunking.max_chunk_size)
        placed = parts.join(cut.select("id", F.col("path").alias("file_path"), F.col("start_line").alias("base"), "chunk_type"), "id")
        chunks = placed.select(F.col("sub_id").alias("id"), "file_path", (F.col("base") + F.col("start_line") - 1).alias("start_line"), (F.col("base") + F.col("end_line") - 1).alias("end_line"), "chunk_type", "content")
        read = store.materialize(units.outlined(kept).select("path", "language", "nodes", F.when(F.col("nodes").isNull(), F.col("content")).alias("content")))
        exact, scanned = units.symbols_of(read), symbols.scan(C.line_rows(read.where(F.col("nodes").isNull()), ["path"]))
        shape = ["path", "name", "type", "start_line", "end_line", "scope", "exported"]
        line = F.col("line_no").cast("int")
        rough = scanned.select("path", "name", "type", line.alias("start_line"), line.alias("end_line"), F.lit("global").alias("scope"), F.lit(False).alias("exported"))
        found = store.materialize(exact.select(*shape).unionByName(rough.select(*shape)))
        within = symbols.in_chunks(chunks, found, ["exported"])
        entry = F.struct("start_line", "end_line", "name", "type", "scope")
        own = within.groupBy("id").agg(F.array_sort(F.collect_set(entry)).alias("symbols"), F.array_sort(F.collect_set(F.when(F.col("exported"), F.col("name")))).alias("exports"))
        brought = C.imports(C.line_rows(kept, ["path"])).where(F.col("module").isNotNull())
        seen = symbols.visible_imports(chunks, brought).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("line_no", "module"))).alias("imports"))
        named = kept.select(F.col("path").alias("file_path"), F.col("rel_path").alias("relative_path"), F.col("told").alias("language"))
        full = chunks.join(own, "id", "left").join(seen, "id", "left").join(named, "file_path")
        none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
        return full.select(
            "id", "content", "file_path", "relative_path", "start_line", "end_line", "language", "chunk_type", C.complexity("content").alias("complexity"),
            none("symbols", own.schema["symbols"].dataType).alias("symbols"), none("imports", seen.schema["imports"].dataType).alias("imports"), none("exports", "array<string>").alias("exports"), self.embedder(F.col("content")).alias("vector"),
        )

    def _write_batch(self, namespace: str, batch: int, files: DataFrame) -> DataFrame:
        """Write the chunks of files with what is searched of them; the files' new states."""
        at = lambda name: f"{self.folder}/{name}/namespace={namespace}/batch={batch}"
        self.build_chunks(files).write.mode("overwrite").parquet(at("chunks"))
        chunks = self.spark.read.parquet(at("chunks"))
        words, sizes = search.indexed(chunks.select(F.struct("file_path", "id").alias("key"), "content"), "key")
        words.select("key.*", "term", "tf").repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(at("postings"))
        sizes.select("key.*", "len").write.mode("overwrite").parquet(at("lengths"))
        told = files.select("path", F.col("mtime").alias("last_modified"), F.col("size").alias("bytes"), F.length("content").cast("bigint").alias("size"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
        return store.with_chunk_ids(told, chunks).withColumn("batch", F.lit(batch))

    def _publish(self, root: str, namespace: str, version: int, state: DataFrame) -> int:
        state.write.mode("overwrite").parquet(f"{self.folder}/state/namespace={namespace}/version={version}")
        counts = self.spark.read.parquet(f"{self.folder}/state/namespace={namespace}/version={version}").agg(F.sum(F.size("chunk_ids")).alias("c"), F.count("*").alias("f")).first()
        self._register(root, namespace, counts["c"] or 0, counts["f"], None, version)
        self._remove(f"{self.folder}/state/namespace={namespace}/version={version - 2}")
        return counts["c"] or 0

    def _register(self, root: str, namespace: str, chunks: int, files: int, failed: str | None, version: int) -> None:
        row = self.spark.range(1).select(
            F.lit(root.rstrip("/")).alias("path"), F.lit(namespace).alias("namespace"), F.lit(chunks).cast("bigint").alias("total_chunks"), F.lit(files).cast("bigint").alias("total_files"), F.current_timestamp().alias("indexed_at"),
            F.lit(failed is not None).alias("failed"), F.lit(failed).cast("string").alias("failure_reason"), F.lit(version).cast("bigint").alias("version"),
        )
        self._commit(self._catalog().where(F.col("path") != root.rstrip("/")).unionByName(row))

    def index_codebase(self, root: str, languages: list[str] | None = None, exclude: list[str] | None = None) -> int:
        """Index a tree anew; the number of its chunks.  A failure is registered and raised, and
        what was indexed before stays searchable."""
        namespace = self.namespace(root)
        with self._lock(namespace):
            return self._index(root, namespace, languages, exclude)

    def _index(self, root: str, namespace: str, languages: list[str] | None, exclude: list[str] | None) -> int:
        before = self._entry(root)
        version = (before["version"] if before else 0) + 1
        try:
            state = self._write_batch(namespace, version, sources.read_tree(self.spark, root, languages, exclude=exclude))
            n = self._publish(root, namespace, version, state)
        except Exception as e:
            kept = before or {"total_chunks": 0, "total_files": 0, "version": 0}
            self._register(root, namespace, kept["total_chunks"], kept["total_files"], str(e)[:500], kept["version"])
            raise
        self._drop_batches(namespace, below=version)
        return n

    def _drop_batches(self, namespace: str, below: int) -> None:
        for name in TABLES:
            fs, p = self._fs(f"{self.folder}/{name}/namespace={namespace}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                m = re.fullmatch(r"batch=(\d+)", s.getPath().getName())
                if m and int(m.group(1)) < below:
                    fs.delete(s.getPath(), True)

    def refresh(self, root: str, languages: list[str] | None = None, exclude: list[str] | None = None, since: Column | None = None) -> dict[str, int]:
        """Bring an index up to date; how many files were added, modified and deleted.

        The tree is listed, and only files whose time or size differs from what is remembered
        are read; of these, those with another content are cut and written, in one batch.
        ``since`` leaves older files as they are."""
        namespace = self.namespace(root)
        with self._lock(namespace):
            entry = self._entry(root)
            if entry is None or entry["version"] == 0:
                return {"added": self._index(root, namespace, languages, exclude)}
            known = self._state(entry)
            maybe = store.materialize(store.touched(sources.list_tree(self.spark, root, languages, exclude=exclude), known, since))
            if maybe.isEmpty():
                return {}
            there = maybe.where(F.col("change") != "deleted").select("path")
            few = there.count() <= FEW
            if few:
                names = [r["path"] for r in collect_bounded(there, FEW)]
                read = sources.read_tree(self.spark, root, languages, exclude=exclude, only=names) if names else None
            else:
                read = sources.read_tree(self.spark, root, languages, exclude=exclude)
            old_hash = known.select("path", F.col("content_hash").alias("_was"))
            gone = maybe.where(F.col("change") == "deleted").select("path")
            if read is None:
                changed = None
            else:
                hashed = read.join(there, "path", "left_semi").join(old_hash, "path", "left")
                changed = hashed.where(~F.sha2(F.coalesce("content", F.lit("")), 256).eqNullSafe(F.col("_was")))
            kinds = None if changed is None else store.materialize(changed.select("path", F.when(F.col("_was").isNull(), "added").otherwise("modified").alias("change")))
            counts = {"deleted": gone.count()} | ({r["change"]: r["count"] for r in kinds.groupBy("change").count().collect()} if kinds is not None else {})
            counts = {k: n for k, n in sorted(counts.items()) if n}
            version = entry["version"] + 1
            kept = known.join(gone, "path", "left_anti")
            if kinds is not None:
                kept = kept.join(kinds.select("path"), "path", "left_anti")
                # files only touched: remembered with their new time
                seen = read.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_bytes"))
                kept = kept.join(seen, "path", "left").withColumns({"last_modified": F.coalesce("_mtime", "last_modified"), "bytes": F.coalesce("_bytes", "bytes")}).drop("_mtime", "_bytes")
                if not kinds.isEmpty():
                    kept = kept.unionByName(self._write_batch(namespace, version, changed.drop("_was")))
            self._publish(root, namespace, version, kept)
            self._compact(root, namespace)
            return counts

    def _compact(self, root: str, namespace: str) -> None:
        """Write all live rows as one batch if too many rows are dead."""
        entry = self._entry(root)
        all_rows = self.spark.read.parquet(f"{self.folder}/lengths/namespace={namespace}").count()
        if all_rows <= 100 or all_rows - entry["total_chunks"] <= DEAD_SHARE * all_rows:
            return
        version = entry["version"] + 1
        for name in TABLES:
            rows = self._of(name, entry)
            rows = rows.repartitionByRange("term").sortWithinPartitions("term") if name == "postings" else rows
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/namespace={namespace}/batch={version}")
        self._publish(root, namespace, version, self._state(entry).withColumn("batch", F.lit(version)))
        self._drop_batches(namespace, below=version)

    def chunk_ids(self, root: str, path: str, limit: int = 1000) -> DataFrame:
        """The ids of a file's chunks."""
        return store.ids_of_file(self._of("chunks", self._entry(root)), path, limit)

    # --- retrieval ---

    def search(
        self, query: str, root: str | None = None, limit: int | None = None, strategy: str = "hybrid", where: Column | None = None, rerank: bool | None = None, fresh: bool = False, offset: int = 0,
        file_types: list[str] | None = None, attributes: list[str] | bool = True, connected: bool = False,
    ) -> Response:
        """``strategy`` is hybrid, bm25 or vector.  Without a root the first codebase is searched.

        ``where`` and ``file_types`` (extensions) filter chunks before they are ranked, ``offset``
        leaves out the first results.  ``attributes`` names the columns to show beside id and
        score, all or none; ``connected`` adds the imports, exports and related files of a hit.
        With ``fresh`` the index is refreshed first; should that fail, it is searched as it is."""
        if not query or not query.strip():
            return Response(False, strategy, message="Query is empty")
        entry = self._entry(root) if root else self._catalog().where("not failed").orderBy("indexed_at", "path").first()
        if entry is not None and fresh:
            try:
                self.refresh(entry["path"])
            except Exception as e:  # the old index still answers
                self._note = str(e)
            entry = self._entry(entry["path"])
        if entry is None or entry["version"] == 0:
            return Response(False, strategy, message=f"Not indexed: {root or 'nothing'}")
        docs = self._of("chunks", entry)
        limit = self.config.search.limit if limit is None else limit
        if file_types:
            kinds = [f".{t.lower().lstrip('.')}" for t in file_types]
            where = X.extension("file_path").isin(kinds) if where is None else where & X.extension("file_path").isin(kinds)
        if where is not None:
            docs = docs.where(where)
        asked = self.spark.createDataFrame([(0, query)], "query_id bigint, query string")
        depth = max(search.candidates(limit + offset), limit + offset) if strategy == "hybrid" else 2 * (limit + offset)
        text_hits = vector_hits = None
        if strategy in ("hybrid", "bm25"):
            index, sizes = self._of("postings", entry), self._of("lengths", entry)
            if where is not None:
                index, sizes = index.join(docs.select("id"), "id", "left_semi"), sizes.join(docs.select("id"), "id", "left_semi")
            words = [r["t"] for r in self.spark.range(1).select(F.explode(F.array_distinct(X.terms(F.lit(query)))).alias("t")).collect()]
            text_hits = search.top(search.bm25(index.where(search.any_of(words)).select("id", "term", "tf"), sizes.select("id", "len"), asked), depth)
        if strategy in ("hybrid", "vector"):
            vector = self.spark.range(1).select(self.embedder(F.lit(query)).alias("v")).first()["v"]
            vector_hits = search.top(search.vector_scores(docs.select("id", "vector"), [(0, list(vector))], dim=self.config.dim), depth, ascending=True)
        shown = docs.drop("vector")
        if strategy == "hybrid":
            fused = search.fuse(vector_hits, text_hits, self.config.search.vector_weight, self.config.search.text_weight)
            hits = search.without_overlaps(search.keep_first(shown.join(fused, "id"), ["query_id", "file_path", "start_line", "end_line"]))
        else:
            hits = shown.join(text_hits if strategy == "bm25" else vector_hits.withColumn("score", 1 - F.col("score")), "id")
        hits = hits.withColumn("similarity", F.col("score"))
        reranked = self.config.search.rerank if rerank is None else rerank
        if reranked:
            names = F.transform("symbols", lambda s: s["name"])
            hits = search.rerank(hits, F.lit(query), search.rerank_text(F.col("file_path"), F.col("start_line"), F.col("end_line"), names, F.col("content")), scorer=self.reranker)
        final = hits.orderBy("rank", "id").offset(offset).limit(limit)
        if connected:
            final = self._connected(final)
        if attributes is not True:
            final = final.select("id", "score", *[a for a in attributes or [] if a not in ("id", "score")], "rank")
        return Response(True, strategy, final.orderBy("rank"), metadata={"namespace": entry["namespace"], "limit": limit, "offset": offset, "reranked": reranked})

    @staticmethod
    def _connected(hits: DataFrame, most: int = 5) -> DataFrame:
        first = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, most)
        modules = F.transform("imports", lambda i: i["module"])
        related = F.filter(modules, lambda m: m.startswith("."))
        return hits.withColumn("connections", F.struct(first(modules).alias("imports"), first(F.col("exports")).alias("exports"), first(related).alias("related_files")))

    def search_symbols(self, names: list[str], root: str | None = None, limit: int = 10) -> Response:
        """The chunks nearest to some symbols' names."""
        return self.search(" ".join(names), root, limit, strategy="vector", rerank=False)

    # --- catalog ---

    def get_indexing_status(self, root: str | None = None) -> DataFrame:
        """The catalog's entries, all or a root's, and whether their folders are there (``present``)."""
        rows = self._catalog()
        if root is not None:
            rows = rows.where(F.col("path") == root.rstrip("/"))
        here = [(r["path"], self._exists(r["path"])) for r in collect_bounded(rows.select("path"))]
        return rows.join(self.spark.createDataFrame(here, "path string, present boolean"), "path", "left")

    def is_indexed(self, root: str) -> bool:
        entry = self._entry(root)
        return entry is not None and entry["version"] > 0 and self._exists(entry["path"])

    def by_namespace(self, namespace: str) -> DataFrame:
        return self._catalog().where(F.col("namespace") == namespace)

    def statistics(self) -> DataFrame:
        return store.statistics(self._catalog())

    def last_indexed(self, root: str):
        """The time up to which a root's files are known."""
        entry = self._entry(root)
        return entry and entry["indexed_at"]

    def update_chunk_count(self, root: str) -> int:
        """Count a root's chunks anew and remember it."""
        entry = self._entry(root)
        n = self._of("chunks", entry).count()
        self._register(root, entry["namespace"], n, entry["total_files"], entry["failure_reason"], entry["version"])
        return n

    def availability(self) -> dict[str, bool]:
        """What the engine can do with its configuration."""
        return {"vector_store": True, "embedder": self.embedder is not None, "reranker": self.config.search.rerank, "key": self.config.has_key}

    def describe(self) -> str:
        """The status of all codebases as text."""
        rows = collect_bounded(self.get_indexing_status().orderBy("path"))
        if not rows:
            return "No codebase is indexed."
        one = lambda r: f"{r['path']}: " + (f"failed: {r['failure_reason']}" if r["failed"] else f"{r['total_chunks']} chunks of {r['total_files']} files, {r['indexed_at']:%Y-%m-%d %H:%M}") + ("" if r["present"] else ", folder missing")
        return "\n".join([f"Codebases: {len(rows)}", *map(one, rows)])

    def clear_index(self, root: str | None = None) -> bool:
        """Remove a root's rows, or all; false if there are none."""
        known = self._catalog()
        gone = known if root is None else known.where(F.col("path") == root.rstrip("/"))
        names = [r["namespace"] for r in collect_bounded(gone.select("namespace"))]
        if not names:
            return False
        self._commit(store.materialize(known.join(gone.select("path"), "path", "left_anti")))
        for namespace in names:
            for name in (*TABLES, "state"):
                self._remove(f"{self.folder}/{name}/namespace={namespace}")
        return True

    def remove_orphans(self) -> list[str]:
        """Remove the tables of namespaces that no entry names; which they were."""
        fs, p = self._fs(f"{self.folder}/chunks")
        found = [s.getPath().getName().removeprefix("namespace=") for s in fs.listStatus(p)] if fs.exists(p) else []
        have = self.spark.createDataFrame([(x,) for x in found], "namespace string")
        gone = sorted(r["namespace"] for r in collect_bounded(store.orphans(have, self._catalog())))
        for namespace in gone:
            for name in (*TABLES, "state"):
                self._remove(f"{self.folder}/{name}/namespace={namespace}")
        return gone
