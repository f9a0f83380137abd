"""Event streams: the rate limiter as a stateful operator, usage per window with late data,
and indexing of new files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def limited(events: DataFrame, key: list[str], limit: int, seconds: int, time: str = "created_at", order: str = "id") -> DataFrame:
    """The batch limiter's decisions over a stream: key columns, ``order``, ``micros``, ``allowed`` and ``used``.

    The state of a key is its open window: two numbers.  Rows are taken in the order of their
    time within a micro-batch; a key idle for two windows is forgotten."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = events.select(*key, order, F.unix_micros(F.col(time).cast("timestamp")).alias("micros"))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join(f"`{k}` {fields[k]}" for k in [*key, order, "micros"]) + ", allowed boolean, used int"
    span = seconds * 1_000_000

    def step(group: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (None, 0)
        data = pd.concat(list(batches)).sort_values(["micros", order], kind="stable")
        allowed, counts = [], []
        for t in data["micros"]:
            if opened is None or t >= opened + span:
                opened, used = int(t), 0
            ok = used < limit
            used += ok
            allowed.append(bool(ok))
            counts.append(int(used))
        state.update((opened, int(used)))
        state.setTimeoutDuration(2 * seconds * 1000)
        yield data.assign(allowed=allowed, used=counts)[[*key, order, "micros", "allowed", "used"]]

    return rows.groupBy(*key).applyInPandasWithState(step, out, "opened bigint, used int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def usage_windows(events: DataFrame, size: str = "1 hour", late: str = "3 days", time: str = "created_at") -> DataFrame:
    """Events and failures per tumbling window and type; rows later than ``late`` are left out, and
    repeated rows within it count once."""
    dated = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicates(["id", time])
    return dated.groupBy(F.window(time, size).alias("w"), "type").agg(F.count("*").alias("events"), F.count_if(F.col("status_code") >= 400).alias("failed")).select(F.col("w.start").alias("start"), "type", "events", "failed")


def on_new_files(files: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Run ``handle`` on every micro-batch of new files, all that are there now, and stop."""
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
