"""The chunk store and the catalog: latest rows, upsert, delete, change detection, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.sources.tables import materialize


def latest(rows: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The row with the largest ``version`` of each key; null keys are left out.

    A partial maximum runs before the shuffle, so repeated and old rows don't travel."""
    rest = [c for c in rows.columns if c != key]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(v) for v in version])).alias("_row"))
    return best.select(key, "_row.*").select(*rows.columns)


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_t": F.coalesce(F.col("mtime").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")), "_h": F.coalesce(F.md5("content"), F.lit(""))})


def files(rows: DataFrame) -> DataFrame:
    """The latest row of each path; of equal times the one with the larger content hash."""
    return latest(_dated(rows), "path", ["_t", "_h"]).drop("_t", "_h")


def latest_of(rows: DataFrame, *derived: Column) -> DataFrame:
    """path and what is derived from the latest row of each path.

    It is derived before the latest is found, so that no content is shuffled; superseded states,
    a small part of the rows, are looked at in vain."""
    return latest(_dated(rows).select("path", "_t", "_h", *derived), "path", ["_t", "_h"]).drop("_t", "_h")


def distinct_chunks(rows: DataFrame) -> DataFrame:
    """One row for each chunk id."""
    return latest(rows.withColumn("_h", F.md5(F.coalesce("content", F.lit("")))), "id", ["_h"]).drop("_h")


def upsert(store: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The store with the rows inserted or, where their key exists, in its place."""
    return store.withColumn("_v", F.lit(0)).unionByName(rows.withColumn("_v", F.lit(1)), allowMissingColumns=True).transform(lambda d: latest(d, key, ["_v"])).drop("_v")


def delete(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return store.join(ids.select(key), key, "left_anti")


def insert_missing(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The store with the rows whose key it lacks."""
    return store.unionByName(rows.dropDuplicates([key]).join(store.select(key), key, "left_anti"), allowMissingColumns=True)


def replace_files(store: DataFrame, chunks: DataFrame, changed: DataFrame, path: str = "file_path") -> DataFrame:
    """The store with all chunks of the changed files replaced by the new ones."""
    return store.join(changed.select(F.col("path").alias(path)), path, "left_anti").unionByName(chunks, allowMissingColumns=True)


def write_partition(rows: DataFrame, folder: str, namespace: str) -> None:
    """Write a namespace's rows in place of what was there; other namespaces stay.  No rows
    leave an empty partition, which is what they say."""
    rows.write.mode("overwrite").parquet(f"{folder}/namespace={namespace}")


def exists(store: DataFrame, namespace: str) -> bool:
    return not store.where(F.col("namespace") == namespace).isEmpty()


def ids_of_file(store: DataFrame, path: str, limit: int = 1000) -> DataFrame:
    return store.where(F.col("file_path") == path).select("id").orderBy("id").limit(limit)


def state(rows: DataFrame) -> DataFrame:
    """What is remembered of each file: path, mtime, size and content hash."""
    return rows.select("path", F.col("mtime").alias("last_modified"), F.length("content").cast("bigint").alias("size"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))


def with_chunk_ids(states: DataFrame, chunks: DataFrame) -> DataFrame:
    """The states of files with the ids of their chunks."""
    own = chunks.groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list("id")).alias("chunk_ids"))
    return states.join(own, "path", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def touched(listed: DataFrame, known: DataFrame, since: Column | None = None) -> DataFrame:
    """path and ``change`` by what a listing tells: added, deleted, or perhaps modified.

    ``listed`` has path, mtime and bytes, and no contents are read.  A file whose time and bytes
    are as remembered is as it was, and so is one not newer than ``since``."""
    both = listed.select("path", "mtime", "bytes", F.lit(True).alias("here")).alias("n").join(known.select("path", "last_modified", "bytes", F.lit(True).alias("there")).alias("k"), "path", "full_outer")
    same = F.col("n.mtime").eqNullSafe(F.col("k.last_modified")) & F.col("n.bytes").eqNullSafe(F.col("k.bytes"))
    old = F.lit(False) if since is None else F.coalesce(F.col("n.mtime") <= since, F.lit(False))
    kind = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "deleted").when(~same & ~old, "modified")
    return both.select("path", kind.alias("change")).where(F.col("change").isNotNull())


def changes(current: DataFrame, known: DataFrame, since: Column | None = None) -> DataFrame:
    """path and ``change`` (added, modified, deleted) between files and the remembered state.

    Older files are unchanged if ``since`` is given; else size and then hash decide."""
    now = state(current)
    both = now.alias("n").join(known.alias("k"), "path", "full_outer")
    newer = F.lit(True) if since is None else F.coalesce(F.col("n.last_modified") > since, F.lit(True))
    differs = newer & ((F.col("n.size") != F.col("k.size")) | (F.col("n.content_hash") != F.col("k.content_hash")))
    kind = F.when(F.col("k.content_hash").isNull(), "added").when(F.col("n.content_hash").isNull(), "deleted").when(differs, "modified")
    return both.select("path", kind.alias("change")).where(F.col("change").isNotNull())


def orphans(namespaces: DataFrame, catalog: DataFrame) -> DataFrame:
    """Namespaces that look like ours and that no catalog entry knows."""
    return namespaces.where(F.col("namespace").rlike("^mcp_[a-f0-9]{16}$")).select("namespace").distinct().join(catalog.select("namespace"), "namespace", "left_anti")


def register(catalog: DataFrame, path: str, key: str, chunks: int, failed: str | None = None) -> DataFrame:
    """The catalog with the entry of a root, successful or failed, added or replaced."""
    spark: SparkSession = catalog.sparkSession
    row = spark.range(1).select(F.lit(path).alias("path"), X.namespace_id(F.lit(path), key).alias("namespace"), F.lit(chunks).cast("bigint").alias("total_chunks"), F.current_timestamp().alias("indexed_at"), F.lit(failed is not None).alias("failed"), F.lit(failed).cast("string").alias("failure_reason"))
    return materialize(upsert(catalog, row, "path"))


def statistics(catalog: DataFrame) -> DataFrame:
    """Entries, chunks, their mean, and the first and last indexing."""
    return catalog.agg(
        F.count("*").alias("codebases"), F.count_if(~F.coalesce("failed", F.lit(False))).alias("indexed"), F.coalesce(F.sum("total_chunks"), F.lit(0)).alias("chunks"),
        F.round(F.avg("total_chunks"), 6).alias("mean_chunks"), F.min("indexed_at").alias("first_indexed"), F.max("indexed_at").alias("last_indexed"),
    )


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent: str) -> DataFrame:
    """The rows whose reference names no parent; null references name none and are no fault."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent).alias(key)).distinct(), key, "left_anti")
