"""Analytics of the API's event log, rate-limit windows, and statistics of indexing logs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All event types, and those with the lower of the two limits of uses a day.  Fixed values.
EVENT_TYPES = ("TURBOPUFFER_QUERY", "TURBOPUFFER_UPSERT", "JINA_EMBEDDINGS", "JINA_RERANK", "TURBOPUFFER_NAMESPACE_QUERY", "TURBOPUFFER_NAMESPACE_UPSERT", "TURBOPUFFER_NAMESPACE_CLEAR", "TURBOPUFFER_NAMESPACE_EXISTS", "TURBOPUFFER_HYBRID", "TURBOPUFFER_CHUNKS_IDS", "TURBOPUFFER_CHUNKS_DELETE")
SEARCHES = ("TURBOPUFFER_QUERY", "TURBOPUFFER_NAMESPACE_QUERY", "TURBOPUFFER_HYBRID")
SEARCH_LIMIT, OTHER_LIMIT, WINDOW_SECONDS = 200, 10_000, 86_400


def distinct_events(events: DataFrame) -> DataFrame:
    """The events without repeated rows; a negative duration was not measured and is null."""
    return events.withColumn("duration_ms", F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))).distinct()


def metadata(events: DataFrame) -> DataFrame:
    """id with the fields of the metadata; those of cut-off JSON are null."""
    field = lambda name, kind: F.try_variant_get(F.try_parse_json("metadata"), f"$.{name}", kind)
    return events.select("id", field("requestBodyBytes", "bigint").alias("request_bytes"), field("responseBytes", "bigint").alias("response_bytes"), field("success", "boolean").alias("success"))


def by_type(events: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status_code") >= 400)
    return events.groupBy("type").agg(F.count("*").alias("events"), failed.alias("failed"), F.count("duration_ms").alias("measured"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"), F.approx_count_distinct("api_key_id").alias("about_keys"))


def windowed(events: DataFrame, size: str, time: str = "created_at", by: str = "type") -> DataFrame:
    """Events per tumbling window and group."""
    return events.groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), by, "events")


def sessions(events: DataFrame, key: str, gap: int, time: str = "created_at") -> DataFrame:
    """Runs of a key's events with less than ``gap`` seconds between neighbours."""
    w = Window.partitionBy(key).orderBy(time)
    pause = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    marked = events.where(F.col(time).isNotNull()).withColumn("new", F.when(pause < gap * 1_000_000, 0).otherwise(1))
    return marked.withColumn("session", F.sum("new").over(w)).groupBy(key, "session").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("events"))


def limit_of(kind: Column) -> Column:
    return F.when(kind.isin(*SEARCHES), SEARCH_LIMIT).otherwise(OTHER_LIMIT)


def fixed_windows(events: DataFrame, key: list[str], limit: int | Column, seconds: int, time: str = "created_at", order: str = "id") -> DataFrame:
    """Per event whether a limiter allows it: a window opens with the first allowed event after the
    last one's end and allows ``limit`` of them; rejected ones don't count.  ``opened`` is the
    window's start in microseconds, ``remaining`` what it has left.

    Where a window opens depends on the one before, so a key's events are passed in their order,
    sorted by Spark with spilling, through a worker that holds one window of one key at a time."""
    most = limit if isinstance(limit, Column) else F.lit(limit)
    rows = events.where(F.col(time).isNotNull()).select(*key, order, time, most.cast("int").alias("limit"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"))
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "micros", order)
    n_key, span = len(key), seconds * 1_000_000
    names = [*rows.columns[:-1], "opened", "allowed", "used", "remaining"]

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, opened, used = None, 0, 0
        for b in batches:
            cols = b.columns
            keys = list(zip(*[c.to_pylist() for c in cols[:n_key]]))
            allowed, counts, starts, left = [], [], [], []
            for k, t, n in zip(keys, cols[-1].to_pylist(), cols[-2].to_pylist()):
                if k != now or t >= opened + span:
                    now, opened, used = k, t, 0
                ok = used < n
                used += ok
                allowed.append(ok)
                counts.append(used)
                starts.append(opened)
                left.append(n - used)
            yield pa.RecordBatch.from_arrays([*cols[:-1], pa.array(starts, pa.int64()), pa.array(allowed), pa.array(counts, pa.int32()), pa.array(left, pa.int32())], names=names)

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("opened", T.LongType()), T.StructField("allowed", T.BooleanType()), T.StructField("used", T.IntegerType()), T.StructField("remaining", T.IntegerType())])
    return ordered.mapInArrow(fold, schema)


def limit_status(events: DataFrame, key: list[str], limit: int | Column, seconds: int, now: Column, time: str = "created_at", order: str = "id") -> DataFrame:
    """Per key the state of its limiter at ``now`` (microseconds): limit, used, remaining, the time
    at which the open window ends and the seconds to wait for it, at least 1, if nothing remains.

    A window that has ended counts for nothing.  Events after ``now`` are not looked at."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    seen = fixed_windows(events.where(micros <= now), key, limit, seconds, time, order)
    last = seen.groupBy(*key).agg(F.max_by(F.struct("opened", "used", "limit"), F.struct("opened", "used")).alias("w")).select(*key, "w.*")
    span = seconds * 1_000_000
    is_open = now < F.col("opened") + span
    used = F.when(is_open, F.col("used")).otherwise(0)
    left = F.col("limit") - used
    ends = F.when(is_open, F.col("opened") + span)
    wait = F.when(left <= 0, F.greatest(F.lit(1), F.ceil((ends - now) / 1_000_000)).cast("bigint"))
    return last.select(*key, "limit", used.alias("used"), left.alias("remaining"), ends.alias("resets_at"), wait.alias("retry_after"))


def default_limits(keys: DataFrame, types: list[str], key: str = "id") -> DataFrame:
    """A limit for every key and event type, as a new key gets them."""
    return keys.select(F.col(key).alias("api_key_id"), F.explode(F.array(*map(F.lit, types))).alias("type")).select("api_key_id", "type", limit_of(F.col("type")).alias("limit"), F.lit(WINDOW_SECONDS).alias("window_seconds"))


def log_statistics(lines: DataFrame) -> DataFrame:
    """One row per log file (file, line_no, value): completed, failed, first and last time, most
    chunks, batches done and planned, and their rate."""
    at = F.regexp_extract("value", r"^\[([^\]]+)\]", 1)
    done = F.regexp_extract("value", r"Batch (\d+)/(\d+) completed successfully", 1)
    planned = F.regexp_extract("value", r"Batch (\d+)/(\d+) completed successfully", 2)
    chunks = F.try_to_number(F.nullif(F.regexp_extract("value", r"Uploaded (\d+) chunks to namespace", 1), F.lit("")), F.lit("999999999"))
    failed = F.col("value").rlike("No chunks generated|all files filtered out|parsing failures|Failed indexing attempt registered")
    stats = lines.groupBy("file").agg(
        F.bool_or(F.col("value").contains("Process completed with code: 0")).alias("completed"), F.bool_or(failed).alias("failed"), F.min_by(F.nullif(at, F.lit("")), F.when(at != "", F.col("line_no"))).alias("started"),
        F.max_by(F.nullif(at, F.lit("")), F.when(at != "", F.col("line_no"))).alias("ended"), F.coalesce(F.max(chunks).cast("bigint"), F.lit(0).cast("bigint")).alias("chunks"), F.count_if(done != "").alias("batches_done"),
        F.coalesce(F.max(F.when(planned != "", planned.cast("bigint"))), F.lit(0).cast("bigint")).alias("batches"),
    )
    # without the wording that counts chunks, the batches of 50 that a total makes
    stats = stats.withColumn("batches", F.when((F.col("batches") == 0) & (F.col("chunks") > 0), F.ceil(F.col("chunks") / 50)).otherwise(F.col("batches")))
    return stats.withColumn("rate", F.round(F.coalesce(F.try_divide(100.0 * F.col("batches_done"), F.col("batches")), F.lit(0.0)), 2))
