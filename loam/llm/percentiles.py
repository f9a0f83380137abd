"""Percentiles of very large numeric columns by exact bisection.

``bisect`` keeps a value interval for every group and percentile.  A pass counts the rows of
each open interval below its midpoints and narrows the interval to the part that holds the
target rank; it ends when every interval holds a single value.  A pass may look at the
midpoints of several halvings at once (``halvings``), which needs fewer passes over the rows
and gives the same intervals.  The rows meet only in partial counts, so a group that holds a
third of them costs no more than any other, and no group is ever gathered.

It serves two forms:

* ``summarize`` makes a mergeable summary: per group and bucket, a count.  Buckets hold one
  value each near zero and are ``2**-bits`` wide relative to their values further out, so
  that every answer has a stated bound.  Summaries of separate days or files are combined by
  ``merge`` (a sum) and answered by ``percentiles`` without the rows.
* ``exact_percentiles`` bisects the rows' own values.

Values may be negative, whole or fractional.  Null, NaN and infinite values are not measured.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from loam.sources.tables import materialize

BITS = 7
HALVINGS = 8  # of an interval, in one pass over the rows
PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
_LONG, _BIAS = 2**63 - 1, 1100  # the exponents of doubles lie above -_BIAS


def _is_fractional(rows: DataFrame, value: str) -> bool:
    kind = rows.schema[value].dataType.typeName()
    return kind in ("double", "float", "decimal")


def _shift(c: Column, by: Column | int, way: str = "left") -> Column:
    return F.call_function(f"shift{way}", c, by if isinstance(by, Column) else F.lit(by))


# --- buckets ----------------------------------------------------------------------------


def bucket(value: Column, bits: int = BITS, fractional: bool = False) -> Column:
    """The number of a value's bucket: whole, rising with the value, negative for negative values."""
    if fractional:
        size = F.abs(value)
        e = F.floor(F.log2(size))
        e = F.when(F.pow(F.lit(2.0), e) > size, e - 1).when(F.pow(F.lit(2.0), e + 1) <= size, e + 1).otherwise(e)  # the logarithm is rounded
        e = F.greatest(e, F.lit(-1022))
        own = (e + _BIAS) * 2**bits + F.floor(size / F.pow(F.lit(2.0), e) * 2**bits) - 2**bits + 1
        return F.when(value == 0, F.lit(0)).otherwise(F.when(value < 0, -own).otherwise(own)).cast("bigint")
    size = F.abs(F.greatest(value.cast("bigint"), F.lit(-_LONG)))
    s = F.greatest(F.lit(0), F.length(F.bin(size)) - F.lit(bits + 1))
    own = s.cast("bigint") * 2**bits + _shift(size, s, "right")
    return F.when(value < 0, -own).otherwise(own)


def bounds(number: Column, bits: int = BITS, fractional: bool = False) -> tuple[Column, Column]:
    """The least and the largest value of a bucket."""
    own = F.abs(number)
    if fractional:
        e = F.floor((own - 1) / 2**bits) - _BIAS
        part = (own - 1) % 2**bits + 2**bits
        low, high = part * F.pow(F.lit(2.0), e - bits), (part + 1) * F.pow(F.lit(2.0), e - bits)
        low, high = F.when(number == 0, 0.0).otherwise(low), F.when(number == 0, 0.0).otherwise(high)
    else:
        s = F.greatest(F.lit(0), F.floor(own / 2**bits) - 1).cast("int")
        low = _shift(own - s.cast("bigint") * 2**bits, s)
        high = low + (_shift(F.lit(1).cast("bigint"), s) - 1)
    return F.when(number < 0, -high).otherwise(low), F.when(number < 0, -low).otherwise(high)


def measured(rows: DataFrame, value: str) -> DataFrame:
    """The rows whose value is a finite number; decimals become doubles."""
    if _is_fractional(rows, value):
        rows = rows.withColumn(value, F.col(value).cast("double"))
        return rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return rows.where(F.col(value).isNotNull())


def summarize(rows: DataFrame, by: list[str], value: str = "value", bits: int = BITS) -> DataFrame:
    """``by``, ``bucket`` and ``n``: how many rows of each group fall into the bucket."""
    kept = measured(rows, value)
    number = bucket(F.col(value), bits, _is_fractional(kept, value))
    return kept.groupBy(*by, number.alias("bucket")).agg(F.count("*").alias("n"))


def merge(*summaries: DataFrame) -> DataFrame:
    """The summary of all rows behind several summaries of the same groups."""
    both = reduce(DataFrame.unionByName, summaries)
    return both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n"))


# --- bisection --------------------------------------------------------------------------


def _target(n: Column, p: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * p - 1e-9)).cast("bigint")


def bisect(rows: DataFrame, by: list[str], wanted: tuple[float, ...], value: str, count: str, halvings: int = HALVINGS) -> DataFrame:
    """``by``, ``p``, ``n`` and the ``value`` of rank ``ceil(p * n)``, ``n`` being a group's sum of ``count``.

    ``rows`` is a written table of whole values, each with a count.  An interval is what values
    share in their leading bits, so that a row finds its group's open interval by equality.
    Percentiles in one interval share its count.  Null group values form a group."""
    least, most = rows.agg(F.min(value), F.max(value)).first()
    # nulls within a struct are equal, so the passes are plain equi-joins
    rows = rows.select(F.struct(*by).alias("g"), F.col(value).alias("v"), F.col(count).alias("m"))
    asked = F.explode(F.array(*[F.lit(float(p)) for p in wanted])).alias("p")
    # the first interval of a group is the whole range
    width = max(1, (least or 0).bit_length(), (most or 0).bit_length())
    shift, state = width, None
    while state is None or shift > 0:
        after = max(0, shift - halvings)
        part = _shift(F.col("v"), after, "right").alias("part")
        if state is None:
            counted = rows.groupBy("g", F.lit(0).cast("bigint").alias("at"), part).agg(F.sum("m").alias("c"))
            counted = materialize(counted)
            state = counted.groupBy("g").agg(F.sum("c").alias("n")).select("g", F.lit(0).cast("bigint").alias("at"), "n", asked).withColumn("rest", _target(F.col("n"), F.col("p")))
        else:
            opened = state.select("g", "at").distinct()
            held = rows.withColumn("at", _shift(F.col("v"), shift, "right")).join(opened, ["g", "at"])
            counted = held.groupBy("g", "at", part).agg(F.sum("m").alias("c"))
        # a part's rows below it, among the few parts of its interval
        w = Window.partitionBy("g", "at").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        parts = counted.withColumn("upto", F.sum("c").over(w))
        found = state.join(parts, ["g", "at"]).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("c") < F.col("rest")))
        state = materialize(found.select("g", F.col("part").alias("at"), "n", "p", (F.col("rest") - F.col("upto") + F.col("c")).alias("rest")))
        shift = after
    return state.select("g.*", "p", "n", F.col("at").alias("value"))


def percentiles(summary: DataFrame, by: list[str], wanted: tuple[float, ...] = PERCENTILES, bits: int = BITS, fractional: bool = False) -> DataFrame:
    """For every group and percentile p its row of rank ``ceil(p * n)``: ``low <= value of the row <= high``.

    The bisection runs over the buckets of the summary.  ``n`` is the group's rows; ``value`` is
    the middle of the bucket, off by at most ``error``.  An empty summary gives no row."""
    rows = materialize(summary.select(*by, "bucket", "n"))
    found = bisect(rows, by, wanted, "bucket", "n", halvings=6)
    low, high = bounds(F.col("value"), bits, fractional)
    placed = found.select(*by, "p", "n", low.alias("low"), high.alias("high"))
    half = (F.col("high") - F.col("low")) / 2
    return placed.withColumns({"value": F.col("low") + half, "error": half})


def exact_percentiles(rows: DataFrame, by: list[str], value: str = "value", wanted: tuple[float, ...] = PERCENTILES, halvings: int = HALVINGS) -> DataFrame:
    """``by``, ``p``, ``n`` and the exact ``value`` of rank ``ceil(p * n)``.

    ``rows`` may have a column ``m``, how often each stands.  Equal values of a group are one
    row with their number before the first pass.  Fractional values are bisected by the bits
    of their double, in an order that is theirs."""
    kept = measured(rows, value)
    fractional = _is_fractional(kept, value)
    times = F.sum("m") if "m" in rows.columns else F.count("*")
    equal = kept.groupBy(*by, (F.col(value) if fractional else F.col(value).cast("bigint")).alias("v")).agg(times.cast("bigint").alias("m"))
    if fractional:
        equal = equal.withColumn("v", _ordered(F.col("v")))
    found = bisect(materialize(equal), by, wanted, "v", "m", halvings)
    return found.withColumn("value", _restored(F.col("value"))) if fractional else found


def _flipped(bits):
    return bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)


@F.pandas_udf(LongType())
def _ordered(values: pd.Series) -> pd.Series:
    """Doubles as whole numbers in the same order; both zeros are one."""
    return pd.Series(_flipped((values.to_numpy() + 0.0).view("int64")))


@F.pandas_udf(DoubleType())
def _restored(numbers: pd.Series) -> pd.Series:
    return pd.Series(_flipped(numbers.to_numpy()).view("float64"))


# --- the event log ----------------------------------------------------------------------


def distinct_events(events: DataFrame, value: str = "duration_ms") -> DataFrame:
    """The distinct events with type, api_key_id, day and a measured value.

    Rows that repeat an event whole count once; rows without an id can't be told apart and
    count once per distinct content.  Null and negative durations were not measured.
    """
    kept = events.select("id", "type", "api_key_id", F.to_date("created_at").alias("day"), F.col(value).cast("bigint").alias("value"), "created_at")
    return kept.where(F.col("value") >= 0).distinct().select("type", "api_key_id", "day", "value")


LEVELS = ["level", "type", "api_key_id"]


def levels(pairs: DataFrame, *rest: str) -> DataFrame:
    """Every row of the pairs (type, api_key_id) three times: for its type, its key and the pair.

    ``level`` names which; the other's column is null."""
    each = [F.struct(F.lit(name).alias("level"), (F.col("type") if "t" in of else F.lit(None).cast("string")).alias("type"), (F.col("api_key_id") if "k" in of else F.lit(None).cast("int")).alias("api_key_id")) for name, of in (("type", "t"), ("key", "k"), ("pair", "tk"))]
    return pairs.select(F.explode(F.array(*each)).alias("g"), *rest).select("g.*", *rest)


def grouped(events: DataFrame, daily: bool = True, bits: int = BITS) -> DataFrame:
    """The summary of the distinct events for every type, every key and every pair of them.

    Built from one summary of the pairs per day, which is what would be stored: a level's
    summary is the sum of its parts."""
    days = summarize(distinct_events(events), ["day", "type", "api_key_id"] if daily else ["type", "api_key_id"], bits=bits)
    pairs = days.groupBy("type", "api_key_id", "bucket").agg(F.sum("n").alias("n"))
    return levels(pairs, "bucket", "n").groupBy(*LEVELS, "bucket").agg(F.sum("n").alias("n"))


def exact_by_level(events: DataFrame) -> DataFrame:
    """The exact percentiles of every type, every key and every pair of them."""
    pairs = distinct_events(events).groupBy("type", "api_key_id", "value").agg(F.count("*").alias("m"))
    return exact_percentiles(levels(pairs, "value", "m"), LEVELS)
