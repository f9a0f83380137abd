"""Language, confidence and type of a file, from its path and the hints in its first lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions import text as X

#: Extensions, their language and how sure it is.  Fixed values.
EXTENSIONS = {
    ".ts": ("typescript", 1.0), ".tsx": ("typescript", 1.0), ".js": ("javascript", 1.0), ".jsx": ("javascript", 1.0), ".mjs": ("javascript", 1.0), ".cjs": ("javascript", 1.0),
    ".py": ("python", 1.0), ".pyx": ("python", 0.9), ".pyi": ("python", 1.0), ".pyw": ("python", 1.0), ".java": ("java", 1.0), ".c": ("c", 1.0), ".h": ("c", 0.8), ".cpp": ("cpp", 1.0), ".cxx": ("cpp", 1.0),
    ".cc": ("cpp", 1.0), ".hpp": ("cpp", 1.0), ".hxx": ("cpp", 1.0), ".go": ("go", 1.0), ".rs": ("rust", 1.0), ".cs": ("csharp", 1.0), ".php": ("php", 1.0), ".rb": ("ruby", 1.0), ".swift": ("swift", 1.0),
    ".kt": ("kotlin", 1.0), ".kts": ("kotlin", 1.0), ".sh": ("shell", 1.0), ".bash": ("shell", 1.0), ".zsh": ("shell", 1.0), ".sql": ("sql", 1.0), ".yml": ("yaml", 1.0), ".yaml": ("yaml", 1.0), ".json": ("json", 1.0),
    ".md": ("markdown", 1.0), ".markdown": ("markdown", 1.0), ".xml": ("xml", 1.0), ".html": ("html", 1.0), ".htm": ("html", 1.0), ".css": ("css", 1.0), ".scss": ("scss", 1.0), ".sass": ("sass", 1.0), ".less": ("less", 1.0),
}
_S = X.WS
#: Hints: language, pattern, weight; ``^`` is the start of the text.  Fixed values.
HINTS = (
    ("typescript", rf"import{_S}+.*{_S}+from{_S}+['\"]", 0.2), ("typescript", rf"export{_S}+(?:default{_S}+)?(?:class|function|const|interface)", 0.3), ("typescript", rf"interface{_S}+\w+", 0.4),
    ("typescript", rf"type{_S}+\w+{_S}*=", 0.3), ("typescript", r"<\w+.*>.*</\w+>", 0.2),
    ("python", rf"\Adef{_S}+\w+{_S}*\(", 0.3), ("python", rf"\Aclass{_S}+\w+{_S}*\(?{_S}*\w*{_S}*\)?:", 0.4), ("python", rf"import{_S}+\w+", 0.2), ("python", rf"from{_S}+\w+{_S}+import", 0.3),
    ("java", rf"public{_S}+(?:class|interface|enum){_S}+\w+", 0.4), ("java", rf"package{_S}+[\w.]+;", 0.3), ("java", r"@\w+", 0.2),
    ("cpp", rf"#include{_S}*<.*>", 0.3), ("cpp", rf"namespace{_S}+\w+", 0.4), ("cpp", rf"class{_S}+\w+{_S}*\{{", 0.3),
    ("go", rf"package{_S}+\w+", 0.3), ("go", rf"func{_S}+\w+{_S}*\(", 0.3), ("go", rf"import{_S}*\([^)]*\)", 0.2),
    ("rust", rf"fn{_S}+\w+{_S}*\(", 0.3), ("rust", rf"use{_S}+\w+(?:::\w+)*;", 0.3), ("rust", rf"struct{_S}+\w+{_S}*\{{", 0.3),
)
HINTED = ("typescript", "python", "java", "cpp", "go", "rust")  # in the order that decides ties
#: Types of files, on the lower-cased name or path, the first that matches.  Fixed values.
TYPES = (
    ("test", r"\.(?:test|spec|tests)\.[jt]sx?\z|test_.*\.py\z|_test\.py\z|_test\.go\z"),
    ("config", r"^(?:webpack|rollup|vite|babel|eslint|prettier)\.config\.[jt]s\z|^(?:tsconfig|jsconfig)\.json\z|^package\.json\z|^pom\.xml\z|^requirements\.txt\z|^poetry\.lock\z|^go\.mod\z|\.config\.[jt]s\z"),
    ("documentation", r"\.(?:md|markdown|rst|txt)\z|^readme|^changelog|^license"),
    ("data", r"\.(?:json|yaml|yml|xml|csv|toml)\z"),
)
FOLDERS = (("test", r"/test/|/__tests__/|/tests/|/spec/"), ("config", r"/config/|/configs/|/\.config/"), ("documentation", r"/docs/|/doc/|/documentation/"))


def file_type(path: str | Column) -> Column:
    p = F.lower(X.col(path))
    name = X.basename(p)
    out = F
    for kind, pattern in TYPES:
        out = out.when(name.rlike(pattern) | p.rlike(pattern), kind)
    for kind, pattern in FOLDERS:
        out = out.when(p.rlike(pattern), kind)
    return out.otherwise("source")


def hint_scores(content: str | Column) -> Column:
    """The summed weights of each hinted language over the first 50 lines, as an array of structs."""
    head = F.array_join(F.slice(X.lines(content), 1, 50), "\n")
    total = {k: sum((F.when(head.rlike(p), F.lit(w)).otherwise(0.0) for lang, p, w in HINTS if lang == k), F.lit(0.0)) for k in HINTED}
    return F.array(*[F.struct(F.round(v, 6).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("language")) for i, (k, v) in enumerate(total.items())])


def detect(path: str | Column, content: str | Column) -> Column:
    """The struct (language, confidence, file_type)."""
    ext = X.extension(path)
    listed = ", ".join(f"'{k}', named_struct('language', '{name}', 'confidence', {sure}D)" for k, (name, sure) in EXTENSIONS.items())
    known = F.try_element_at(F.expr(f"map({listed})"), ext)
    by_name = F.coalesce(known, F.struct(F.lit("text").alias("language"), F.lit(0.1).alias("confidence")))
    best = F.array_max(hint_scores(F.coalesce(X.col(content), F.lit(""))))
    sure = F.least(best["score"], F.lit(0.8))
    hinted = best["score"] > 0
    language = F.when(hinted & (sure > by_name["confidence"]), best["language"]).otherwise(by_name["language"])
    confidence = (
        F.when(hinted & (sure > by_name["confidence"]), F.least(sure, F.lit(0.9)))
        .when(hinted & (best["language"] == by_name["language"]), F.least(F.lit(1.0), by_name["confidence"] + 0.3 * sure))
        .otherwise(by_name["confidence"])
    )
    return F.struct(language.alias("language"), F.round(confidence, 6).alias("confidence"), file_type(path).alias("file_type"))


def supported(language: Column) -> Column:
    """Whether symbols of a language can be extracted."""
    return language.isin("typescript", "javascript", "python")


def known_languages() -> list[str]:
    """All languages that can be told, in order."""
    return sorted({k for k, _ in EXTENSIONS.values()})


def primary_extension(language: Column) -> Column:
    """The first extension of a language in the list above; null for others."""
    first: dict[str, str] = {}
    for e, (k, _) in EXTENSIONS.items():
        first.setdefault(k, e)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.lower(language))
