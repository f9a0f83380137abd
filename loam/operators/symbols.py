"""Symbols of files, and their joins with chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as X

SYMBOL_TYPES = ["function", "class", "interface", "type", "variable", "constant", "method", "enum", "namespace", "module"]
_S = X.WS


#: How lines begin that declare something, and what: the first that matches.  Fixed values.
SCAN_RULES = (
    (rf"^(?:export{_S}+)?(?:default{_S}+)?(?:abstract{_S}+)?class{_S}+(\w+)", "class"), (rf"^(?:export{_S}+)?interface{_S}+(\w+)", "interface"), (rf"^(?:export{_S}+)?(?:default{_S}+)?(?:async{_S}+)?function{_S}+(\w+)", "function"),
    (rf"^(?:async{_S}+)?def{_S}+(\w+)", "function"), (rf"^func{_S}+(?:\([^)]*\){_S}*)?(\w+)", "function"), (rf"^(?:export{_S}+)?type{_S}+(\w+){_S}*[=\w]", "type"), (rf"^(?:export{_S}+)?enum{_S}+(\w+)", "enum"), (rf"^export{_S}+(?:const|let|var){_S}+(\w+)", "variable"),
)


def scan(lines: DataFrame) -> DataFrame:
    """Symbols by the first words of their line, without a parser: ``name``, ``type``, ``line_no``."""
    t = X.trim("line")
    kind, name = F, F
    for p, k in SCAN_RULES:
        kind, name = kind.when(t.rlike(p), k), name.when(t.rlike(p), F.regexp_extract(t, p, 1))
    return lines.withColumns({"type": kind.otherwise(None), "name": name.otherwise(None)}).where(F.col("type").isNotNull()).drop("line")


def in_chunks(chunks: DataFrame, symbols: DataFrame, more: list[str] | None = None) -> DataFrame:
    """chunk id and symbol for every symbol that lies within a chunk of its file.

    An equi-join on the file with the range as a residual: neither side is broadcast by hand."""
    c, s = chunks.select("id", "file_path", F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end")), symbols.where(F.col("type").isin(SYMBOL_TYPES))
    return c.join(s, (F.col("file_path") == F.col("path")) & (F.col("start_line") >= F.col("c_start")) & (F.col("end_line") <= F.col("c_end"))).select("id", "name", "type", "start_line", "end_line", "scope", *(more or []))


def assign(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """The chunks' ids with the array of their symbols, empty where there are none."""
    entry = F.struct("start_line", "end_line", "name", "type", "scope")
    own = in_chunks(chunks, symbols).distinct().groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("symbols"))
    return chunks.select("id").join(own, "id", "left").select("id", F.coalesce("symbols", F.array().cast(own.schema["symbols"].dataType)).alias("symbols"))


def visible_imports(chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """chunk id and import for every import of the file up to the chunk's end."""
    c = chunks.select("id", "file_path", F.col("end_line").alias("c_end"))
    return c.join(imports, (F.col("file_path") == F.col("path")) & (F.col("line_no") <= F.col("c_end"))).select("id", "module", "line_no")


def exported(chunks: DataFrame) -> DataFrame:
    """chunk id and exported name for the exports that a chunk's own symbols define."""
    return chunks.select("id", F.explode(F.array_intersect("exports", F.transform("symbols", lambda s: s["name"]))).alias("name"))


def connections(chunks: DataFrame, most: int = 5) -> DataFrame:
    """Per file its first imports and exports in order, as retrieval shows them."""
    flat = chunks.where(F.col("file_path").isNotNull()).select("file_path", F.transform(F.coalesce("imports", F.array()), lambda i: i["module"]).alias("i"), F.coalesce("exports", F.array().cast("array<string>")).alias("e"))
    both = flat.groupBy("file_path").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))), 1, most).alias("imports"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("e")))), 1, most).alias("exports"))
    return both


def needed(imports: Column, modules: Column, content: Column) -> Column:
    """The imports that a piece depends on, by its dependencies or by mention."""
    return F.filter(imports, lambda i: F.array_contains(modules, i["module"]) | content.contains(i["module"]))


def in_sections(sections: Column, symbols: Column) -> Column:
    """The sections of a text, each with the symbols that begin in it and its priority with them."""
    from loam.operators.chunks import priority

    def own(s: Column) -> Column:
        return F.filter(symbols, lambda x: (x["start_line"] >= s["start_line"]) & (x["start_line"] <= s["end_line"]))

    return F.transform(sections, lambda s: s.withField("symbols", F.transform(own(s), lambda x: x["name"])).withField("priority", priority(s["type"], F.size(own(s)))))
