"""Source trees: discovery with Spark's binaryFile source, in batch and as a stream."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators import discovery


OPTIONS = {"recursiveFileLookup": "true", "ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


def _place() -> Column:
    """The path of a file, without the scheme of local ones and with its own characters."""
    return F.regexp_replace("path", r"^file:/+", "/")


def _shape(raw: DataFrame, root: str) -> DataFrame:
    return raw.select(_place().alias("path"), X.relative(_place(), root).alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def escaped(path: str) -> str:
    """A path in which no character is a wildcard."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _below(spark: SparkSession, roots: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").options(**OPTIONS).load([escaped(r) for r in roots])


def excluded(rel_path: str | Column, patterns: list[str]) -> Column:
    """Whether a path matches one of some patterns, in which ``*`` stands for all but a slash,
    ``**`` for anything and ``?`` for one character; a pattern without a slash is a name."""
    c = X.col(rel_path)
    out = F.lit(False)
    for p in patterns:
        body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.split(r"(\*\*|\*|\?)", p))
        out = out | c.rlike(("(?:^|.*/)" if "/" not in p else "^") + body + "$")
    return out


def list_tree(spark: SparkSession, root: str, languages: list[str] | None = None, most_bytes: int = discovery.MAX_BYTES, exclude: list[str] | None = None) -> DataFrame:
    """path, rel_path, mtime and bytes of the source files below a root; no content is read."""
    raw = _below(spark, [root.rstrip("/")]).where(F.col("length") <= most_bytes)
    listed = raw.select(_place().alias("path"), X.relative(_place(), root.rstrip("/")).alias("rel_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))
    return listed.where(discovery.included("rel_path", languages) & ~excluded("rel_path", exclude or []))


def read_tree(spark: SparkSession, root: str, languages: list[str] | None = None, most_bytes: int = discovery.MAX_BYTES, exclude: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """path, rel_path, size, mtime and content of the source files below a root.

    The size is filtered at the source: larger files are listed and never read.  ``only`` names
    the files to read.  Unreadable files are skipped."""
    raw = _below(spark, [root.rstrip("/")] if only is None else only)
    return _shape(raw.where(F.col("length") <= most_bytes), root.rstrip("/")).where(discovery.included("rel_path", languages) & ~excluded("rel_path", exclude or []))


def stream_tree(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """The same as a stream of new files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    return _shape(raw.where(F.col("length") <= discovery.MAX_BYTES), root.rstrip("/")).where(discovery.included("rel_path", languages))


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """file, line_no and value of the lines of indexing logs."""
    raw = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(X.lines("value")).alias("line_no", "value"))
    return raw.where(X.trim("value") != "")


def newest_log(spark: SparkSession, folder: str, name: str) -> str | None:
    """The newest log of a codebase by its file's time."""
    pattern = r"^background-indexing-(.+?)-(\d{4}-[\dTZ.:-]*)\.log$"
    found = spark.read.format("binaryFile").load(folder).select("path", "modificationTime", F.regexp_extract(X.basename("path"), pattern, 1).alias("name")).where(F.col("name") == name)
    row = found.agg(F.max_by("path", "modificationTime").alias("p")).first()
    return row["p"]


def read_database(spark: SparkSession, url: str, name: str, properties: dict | None = None) -> DataFrame:
    """A table of a relational database over JDBC."""
    return spark.read.jdbc(url, name, properties=properties or {})


def masked(headers: Column, names: tuple[str, ...] = ("authorization", "x-api-key", "x-internal-secret")) -> Column:
    """A map of request headers with the secret ones masked."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*names), F.lit("***")).otherwise(v))


def trimmed(body: Column, most: int = 2000) -> Column:
    """The beginning of a logged body, with a note of what was left out."""
    return F.when(F.length(body) > most, F.concat(F.left(body, F.lit(most)), F.lit("... ("), (F.length(body) - most).cast("string"), F.lit(" more)"))).otherwise(body)


class Log:
    """The log of one indexing run: a file of lines, each with its time in front, as ``read_logs``
    and ``newest_log`` find it."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        now = datetime.now(timezone.utc)
        self.spark, self.lines = spark, []
        self.path = f"{folder.rstrip('/')}/background-indexing-{name}-{now:%Y-%m-%dT%H-%M-%S}Z.log"

    def write(self, line: str) -> None:
        now = datetime.now(timezone.utc)
        self.lines.append(f"[{now:%Y-%m-%dT%H:%M:%S}.{now.microsecond // 1000:03d}Z] {line}\n")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        stream = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p, True)
        stream.write(bytearray("".join(self.lines), "utf-8"))
        stream.close()


def append_rows(rows: DataFrame, folder: str) -> None:
    """Append events or other rows to a Parquet table."""
    rows.write.mode("append").parquet(folder)
