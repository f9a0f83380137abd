"""Which files of a tree are sources: extensions, ignored directories and names, depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as X

#: Extensions of the languages that are indexed.  Fixed values.
LANGUAGES = {
    "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "python": [".py", ".pyx", ".pyi"], "java": [".java"], "cpp": [".cpp", ".cxx", ".cc", ".c", ".h", ".hpp", ".hxx"],
    "go": [".go"], "rust": [".rs"], "csharp": [".cs"], "php": [".php"], "ruby": [".rb"], "swift": [".swift"], "kotlin": [".kt", ".kts"],
}
#: Directories and files that are never read.  Fixed values.
IGNORED_DIRECTORIES = "node_modules .git .svn .hg dist build out target bin obj __pycache__ .pytest_cache .mypy_cache .tox venv env .env .next .nuxt coverage .nyc_output logs tmp temp .DS_Store Thumbs.db".split()
IGNORED_FILES = ".gitignore .dockerignore .eslintignore .prettierignore package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock Pipfile.lock poetry.lock".split()
MAX_DEPTH = 20
MAX_BYTES = 500_000


def extensions(languages: list[str] | None = None) -> list[str]:
    """The extensions of some languages, unknown ones ignored; of all without a choice."""
    return sorted({e for k in (languages or LANGUAGES) for e in LANGUAGES.get(k, [])})


def language_of(path: str | Column) -> Column:
    listed = ", ".join(f"'{e}', '{k}'" for k, v in LANGUAGES.items() for e in v)
    return F.try_element_at(F.expr(f"map({listed})"), X.extension(path))


def included(rel_path: str | Column, languages: list[str] | None = None) -> Column:
    """Whether a path relative to the root is that of a source file."""
    parts = F.split(X.col(rel_path), "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), X.basename(rel_path)
    return (
        (F.size(parts) <= MAX_DEPTH + 1)
        & ~F.exists(folders, lambda d: d.isin(IGNORED_DIRECTORIES) | d.startswith("."))
        & ~name.isin(IGNORED_FILES) & ~name.startswith(".") & ~name.endswith(".min.js") & ~name.endswith(".map") & ~name.contains(".generated.") & ~name.contains(".gen.")
        & X.extension(rel_path).isin(extensions(languages))
    )


def discover(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    return files.where(included("rel_path", languages))


def modified_since(mtime: Column, since: Column) -> Column:
    """Whether a file is newer; an unknown time counts as newer."""
    return F.coalesce(mtime > since, F.lit(True))
