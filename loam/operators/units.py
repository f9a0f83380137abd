"""Semantic chunks and symbols of source files, from their outlines.

``outlined`` reads each file once, in Arrow batches, and adds its declarations as an array;
everything after is an expression over the row's own arrays: which declarations are units,
their merging, the chunks, the symbols with their scopes.  Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions import text as X
from loam.functions.outline import FIELDS, LANGUAGES, outline
from loam.operators import chunks as C
from loam.operators import discovery

LEAST_UNIT = 30  # characters
LARGE_CLASS = 150  # lines beyond which a class's methods are units as well
LEAST_TAIL = 20  # characters of a rest that is a chunk

_ANCESTOR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("lines", T.IntegerType())])
_TYPES = [T.StringType(), T.StringType(), *[T.IntegerType()] * 6, T.BooleanType(), T.ArrayType(_ANCESTOR), T.ArrayType(T.StringType()), T.ArrayType(T.StringType()), T.StringType()]
NODES = T.ArrayType(T.StructType([T.StructField(f, t) for f, t in zip(FIELDS, _TYPES)]))

#: Kinds of declarations that are units, and the type of their chunks.  Fixed values.
UNITS = {"class": "class", "interface": "interface", "type": "type", "function": "function", "method": "function", "namespace": "module", "enum": "mixed", "decorated": "function"}
#: Kinds of values that make a variable a symbol.  Fixed values.
MEANINGFUL = ("array", "object", "arrow", "function", "new", "call")
SYMBOL_TYPES = ["function", "class", "interface", "variable", "constant", "type", "namespace", "method", "enum"]


def readable_language(rel_path: str | Column) -> Column:
    """The language of a path's extension if its outline can be read, else null."""
    language = discovery.language_of(rel_path)
    return F.when(language.isin(*LANGUAGES), language)


def nodes(content: Column, language: Column) -> Column:
    """The outline of a source as an array of ``NODES``; null where there is none to read."""
    @F.arrow_udf(NODES)
    def read(texts, languages):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        rows = [outline(t, g) for t, g in zip(texts.to_pylist(), languages.to_pylist())]
        return pa.array([None if r is None else [dict(zip(FIELDS, n)) for n in r] for r in rows], to_arrow_type(NODES))

    return read(content, language)


def outlined(files: DataFrame) -> DataFrame:
    """The files with ``language`` (null if it can't be read) and ``nodes``."""
    placed = files.withColumn("language", readable_language("rel_path"))
    return placed.withColumn("nodes", nodes(F.col("content"), F.col("language")))


# --- units and chunks -------------------------------------------------------------------


def _is_unit(n: Column) -> Column:
    """Whether a declaration is a unit: it is long enough and stands in no class or namespace, or
    is a method of a large class, or of a class within one."""
    around = F.array_join(F.transform(n["ancestors"], lambda a: a["kind"]), "/")
    outer = F.element_at(F.filter(n["ancestors"], lambda a: a["kind"] == "class"), 1)
    free = ~F.exists(n["ancestors"], lambda a: a["kind"].isin("class", "namespace"))
    member = (n["kind"] == "method") & around.rlike(r"^(?:function/)*class(?:/class)*$") & (F.coalesce(outer["lines"], F.lit(0)) > LARGE_CLASS)
    return n["kind"].isin(*UNITS) & (n["end"] - n["start"] >= LEAST_UNIT) & (free | member)


def unit_array(declared: Column) -> Column:
    """The units among declarations, in order: s, e (characters from 0), t, first and last line."""
    kinds = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    as_unit = lambda n: F.struct(n["start"].cast("bigint").alias("s"), n["end"].cast("bigint").alias("e"), F.element_at(kinds, n["kind"]).alias("t"), n["start_line"].alias("first"), n["end_line"].alias("last"))
    return F.array_sort(F.transform(F.filter(declared, _is_unit), as_unit))


def semantic_chunks(files: DataFrame, limit: int = C.MAX_CHUNK) -> DataFrame:
    """The chunks of files: path, id, start_line, end_line, content, chunk_type, size, complexity.

    Units close to each other are merged up to ``limit``; a rest after the last one of more than
    ``LEAST_TAIL`` characters is a chunk, as is the whole of a file without units.  A file in a
    language without a reader is cut into windows of 100 lines, and one that its reader refuses
    into windows of 50, blank ones kept.  Null and blank contents have no chunks."""
    known = files.where(F.col("content").isNotNull() & (X.trim("content") != "")).select("path", "rel_path", "content")
    return chunks_of(outlined(known), limit)


def chunks_of(read: DataFrame, limit: int = C.MAX_CHUNK) -> DataFrame:
    """The same of outlined files with content."""
    lines = X.lines("content")
    piece = lambda text, first, last, kind, size, level: F.struct(text.alias("content"), first.cast("int").alias("start_line"), last.cast("int").alias("end_line"), kind.alias("chunk_type"), size.cast("int").alias("size"), level.alias("complexity"))
    cut = lambda u: F.substring(F.col("content"), (u["s"] + 1).cast("int"), (u["e"] - u["s"]).cast("int"))
    bound = lambda value, use: F.transform(F.array(value), use)[0]
    own = F.transform("units", lambda u: bound(cut(u), lambda c: piece(c, u["first"], u["last"], u["t"], F.length(c), C.complexity(c))))
    n = F.size(lines)
    after = F.element_at("units", -1)["last"]
    rest = X.trim(F.array_join(F.slice(lines, after + 1, F.greatest(n - after, F.lit(0))), "\n"))
    whole = F.array(piece(X.trim("content"), F.lit(1), n, F.lit("mixed"), F.length("content"), F.lit("low")))
    tail = bound(rest, lambda r: F.when(F.length(r) > LEAST_TAIL, F.array(piece(r, after + 1, n, F.lit("mixed"), F.length(r), F.lit("low")))).otherwise(F.array().cast("array<struct<content: string, start_line: int, end_line: int, chunk_type: string, size: int, complexity: string>>")))
    windows = lambda size, kind: F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda s: bound(F.array_join(F.slice(lines, s + 1, size), "\n"), lambda c: piece(c, s + 1, F.least(s + size, n), F.lit(kind), F.length(c), C.complexity(c))))
    unread = F.filter(windows(100, "window"), lambda w: X.trim(w["content"]) != "")
    merged = read.withColumn("units", C.merged(unit_array(F.col("nodes")), limit=limit))
    made = F.when(F.col("language").isNull(), unread).when(F.col("nodes").isNull(), windows(50, "mixed")).when(F.size("units") == 0, whole).otherwise(F.concat(own, tail))
    each = merged.select("path", F.explode(made).alias("c")).select("path", "c.*")
    short = X.short_id("path", F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")))
    return each.select("path", F.when(F.col("chunk_type") == "window", X.chunk_id(F.col("path"), F.col("start_line"), F.col("content"))).otherwise(short).alias("id"), "start_line", "end_line", "content", "chunk_type", "size", "complexity")


# --- symbols ----------------------------------------------------------------------------


def _symbol(n: Column, language: Column) -> Column:
    """A declaration as a symbol: its type, scope and visibility; null if it is none."""
    python, kind, name = language == "python", n["kind"], n["name"]
    in_function = F.exists(n["ancestors"], lambda a: a["kind"] == "function")
    in_class = F.exists(n["ancestors"], lambda a: a["kind"] == "class")
    constant = (name == F.upper(name)) & (F.length(name) > 1)
    tracked = ~name.startswith("__") & (~in_function | constant | name.startswith("_"))
    python_type = F.when(kind == "variable", F.when(tracked, F.when(in_class & ~in_function | constant, "constant").otherwise("variable"))).when(kind.isin("class", "function", "method"), kind)
    script_type = F.when(kind.isin("variable", "constant"), F.when(~in_function & (n["exported"] | n["value"].isin(*MEANINGFUL)), kind)).when(kind.isin("function", "method"), F.when(~in_function, kind)).when(kind != "decorated", kind)
    scope = F.when(n["exported"], "export").when(F.size(n["ancestors"]) > 0, "local").otherwise("global")
    return F.struct(
        name.alias("name"), F.when(python, python_type).otherwise(script_type).alias("type"), n["start_line"].alias("start_line"), n["end_line"].alias("end_line"), n["start_column"].alias("start_column"), n["end_column"].alias("end_column"),
        scope.alias("scope"), F.when(python, F.when(name.startswith("_"), "private").otherwise("public")).alias("visibility"), n["parameters"].alias("parameters"), n["decorators"].alias("decorators"), n["exported"].alias("exported"),
    )


def symbols_of(read: DataFrame) -> DataFrame:
    """path and the symbols of outlined files: name, type, lines, columns, scope (export, local or
    global), visibility (of Python), parameters, decorators, exported.

    Variables within functions are no symbols, nor are others that are neither exported nor have
    a value that says more than a literal; in Python those of modules and classes are, and
    constants and private names everywhere.  Members of something exported are exported."""
    found = F.filter(F.transform("nodes", lambda n: _symbol(n, F.col("language"))), lambda s: s["type"].isNotNull())
    return read.where(F.col("nodes").isNotNull()).select("path", F.explode(found).alias("s")).select("path", "s.*")


def symbols(files: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """The symbols of files in some languages.  Null contents and files that can't be read have none."""
    known = files.where(F.col("content").isNotNull() & readable_language("rel_path").isin(*languages))
    return symbols_of(outlined(known.select("path", "rel_path", "content")))


def totals(read: DataFrame) -> DataFrame:
    """Per language: files, those that could be read, and declarations found in them."""
    return read.groupBy("language").agg(F.count("*").alias("files"), F.count("nodes").alias("read"), F.coalesce(F.sum(F.size("nodes")), F.lit(0)).alias("declarations"))
