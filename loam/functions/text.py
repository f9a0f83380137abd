"""Text functions as Columns: white space as the indexed languages' tools see it, lines, paths,
terms, identifiers and masks.  Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that count as white space, for regular expressions of Java and of RE2.  Fixed values.
WS = r"[ \t\n\r\f\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: str | Column) -> Column:
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+\z", "")


def lines(c: str | Column) -> Column:
    """The lines between line feeds, empty ones at the end included."""
    return F.split(col(c), "\n")


def basename(c: str | Column) -> Column:
    return F.substring_index(col(c), "/", -1)


def extension(c: str | Column) -> Column:
    """The lower-case extension with its dot, empty if there is none; a leading dot begins a name."""
    return F.lower(F.regexp_extract(basename(c), r"^.+(\.[^.]*)$", 1))


def relative(c: str | Column, base: str) -> Column:
    """A path without the folder ``base`` in front of it; other paths stay as they are."""
    path, head = F.replace(col(c), F.lit("\\"), F.lit("/")), base.replace("\\", "/").rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, len(head) + 1, 1_000_000)).otherwise(path)


def terms(c: str | Column) -> Column:
    """The lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def ratio(count: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(count, total), F.lit(0.0))


def namespace_id(path: str | Column, key: str = "") -> Column:
    return F.concat(F.lit("mcp_"), F.substring(F.md5(F.concat(col(path), F.lit(key))), 1, 16))


def chunk_id(path: Column, line: Column, content: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws(":", path, line.cast("string"), content), 256), 1, 16))


def short_id(path: str | Column, suffix: Column) -> Column:
    """Base name, hash of the path and a suffix, at most 60 characters."""
    base = F.split(basename(path), r"\.")[0]
    return F.substring(F.concat_ws("_", base, F.substring(F.md5(col(path)), 1, 8), suffix), 1, 60)


def mask(c: str | Column) -> Column:
    """A secret with only its first and last four characters; short ones wholly masked."""
    n = F.length(col(c))
    return F.when(n <= 8, F.repeat(F.lit("*"), n.cast("int"))).otherwise(F.concat(F.left(col(c), F.lit(4)), F.repeat(F.lit("*"), (n - 8).cast("int")), F.right(col(c), F.lit(4))))


TRUNCATED = "\n// ... content truncated for embedding"


def truncate(c: str | Column, limit: int = 20_000) -> Column:
    """A text within the limit of an embedder: cut after the last line end or brace if that keeps
    four fifths of it, else at the limit with a note."""
    text = col(c)
    head = F.left(text, F.lit(limit))
    back = F.reverse(head)
    near = lambda mark: F.when(F.locate(mark, back) > 0, F.lit(limit + 1) - F.locate(mark, back)).otherwise(F.lit(0))
    last = F.greatest(near("\n"), near("}"))  # 1-based
    return F.when(F.length(text) <= limit, text).when(last - 1 > limit * 0.8, F.left(text, last)).otherwise(F.concat(head, F.lit(TRUNCATED)))


def hmac_sha256(secret: str):
    """A vectorised function from keys to their keyed hash."""
    import hashlib
    import hmac

    @F.pandas_udf("string")
    def keyed(keys):
        return keys.map(lambda k: None if k is None else hmac.new(secret.encode(), k.encode(), hashlib.sha256).hexdigest())

    return keyed


def duration(ms: Column) -> Column:
    """Milliseconds in words: ms below a second, s below a minute, else minutes and seconds."""
    s = F.floor(ms / 1000)
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
