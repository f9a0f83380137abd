"""Queries over small literal sources whose results are written out by hand as VALUES: what needs
a parser or a fold that SQL can't say.  The same operators run over whole tables in ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import chunks as C
from loam.operators import units

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SCRIPT = """import { a } from "./a";
export class Store {
  get(id: string) { const inner = [1]; return a(id); }
}

export function open(path: string, ...rest: string[]): Store { return new Store(); }
const LIMIT = 10;
export const names = ["x", "}"];
"""
PYTHON = """import os

@cached
def load(path, *, limit=1):
    _seen = {}; TOP = 3; plain = 4
    return path

class Box:
    SIZE = 2

    def open(self):
        return load(self)

__all__ = ["load"]
"""
PLAIN = "just some words\nand no declaration at all\n"
GO = "package p\n\nfunc F() {}\n"
BROKEN = "def f(:\n    pass\n"
FILES = [("/r/store.ts", "store.ts", SCRIPT), ("/r/load.py", "load.py", PYTHON), ("/r/plain.js", "plain.js", PLAIN), ("/r/f.go", "f.go", GO), ("/r/bad.py", "bad.py", BROKEN), ("/r/none.ts", "none.ts", None)]


def golden(columns: str, *rows: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"SELECT * FROM (VALUES {', '.join(rows)}) t({columns})"
        return f

    return register


def _files(spark):
    return spark.createDataFrame(FILES, "path string, rel_path string, content string")


@golden(
    "path, start_line, end_line, chunk_type, head, size",
    "('/r/store.ts', 2, 6, 'mixed', 'class Store {', 156)", "('/r/store.ts', 7, 9, 'mixed', 'const LIMIT = 10;', 50)",
    "('/r/load.py', 3, 12, 'mixed', '@cached', 158)",
    "('/r/plain.js', 1, 3, 'mixed', 'just some words', 42)", "('/r/f.go', 1, 4, 'window', 'package p', 23)", "('/r/bad.py', 1, 3, 'mixed', 'def f(:', 17)",
)
def golden_chunks(spark, _):
    """Neighbouring units are merged, a longer rest is a chunk, files without units are whole,
    unread ones are windows."""
    made = units.semantic_chunks(_files(spark))
    return made.select("path", "start_line", "end_line", "chunk_type", F.substring_index("content", "\n", 1).alias("head"), "size")


@golden(
    "name, type, start_line, end_line, start_column, scope, parameters",
    "('Store', 'class', 2, 4, 7, 'export', '')", "('get', 'method', 3, 3, 2, 'export', 'id')", "('open', 'function', 6, 6, 7, 'export', 'path,rest')", "('names', 'constant', 8, 8, 7, 'export', '')",
)
def golden_symbols_typescript(spark, _):
    """Locals are no symbols, nor is a constant with a plain value that isn't exported."""
    found = units.symbols(_files(spark), ("typescript",))
    return found.select("name", "type", "start_line", "end_line", "start_column", "scope", F.array_join("parameters", ",").alias("parameters"))


@golden(
    "name, type, start_line, end_line, scope, visibility, parameters, decorators",
    "('load', 'function', 4, 6, 'global', 'public', 'path,limit', 'cached')", "('_seen', 'variable', 5, 5, 'local', 'private', '', '')", "('TOP', 'constant', 5, 5, 'local', 'public', '', '')",
    "('Box', 'class', 8, 12, 'global', 'public', '', '')", "('SIZE', 'constant', 9, 9, 'local', 'public', '', '')", "('open', 'method', 11, 12, 'local', 'public', 'self', '')",
)
def golden_symbols_python(spark, _):
    found = units.symbols(_files(spark), ("python",))
    return found.select("name", "type", "start_line", "end_line", "scope", "visibility", F.array_join("parameters", ",").alias("parameters"), F.array_join("decorators", ",").alias("decorators"))


@golden(
    "part, start_line, end_line, sections, head, size",
    "(0, 1, 2, 2, 'import { a } from \"./a\"', 169)", "(1, 1, 3, 2, 'import { a } from \"./a\"', 169)", "(2, 1, 4, 2, 'import { a } from \"./a\"', 199)",
)
def golden_subchunks(spark, _):
    """Four sections of 23, 120, 120 and 150 characters, at most 280 of them in a part together with
    the 24 of the import in front and a margin of 1.  No two of the last three fit together, so
    there are three parts; each begins with the import, which is important enough to be
    repeated.  Sizes: 23 and two line ends, then 23, a line end and 120, 120 or 150."""
    text = "\n".join(['import { a } from "./a"', "x" * 120, "function b() " + "y" * 107, "// " + "z" * 147])
    rows = spark.createDataFrame([("c", text)], "id string, content string")
    made = C.pack(rows, limit=280, margin=1)
    return made.select("part", "start_line", "end_line", "sections", F.substring_index("content", "\n", 1).alias("head"), F.length("content").alias("size"))
