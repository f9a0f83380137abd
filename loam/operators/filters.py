"""The inclusion cascade: the first rule that matches tells whether a file is indexed, and why.

All rules are expressions over path and content, so a plan has one projection and no Python.
Repeated lines are counted within the row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as X

#: Patterns on the lower-cased relative path.  Fixed values.
TEST = r"\.(?:test|spec|tests)\.[jt]sx?\z|__tests__/|/tests?/|/spec/|\.stories\.[jt]sx?\z|test_.*\.py\z|_test\.py\z|conftest\.py\z|_test\.go\z|/(?:test|tests|spec|specs|__tests__)/"
GENERATED = (
    r"/dist/|/build/|/out/|/target/|/bin/|/obj/|\.generated\.|\.gen\.|_generated\.|\.min\.[jt]s\z|\.bundle\.[jt]s\z|\.map\z|\.d\.ts\z|\.pyc\z|\.pyo\z|\.class\z|\.o\z|\.obj\z|\.exe\z|\.dll\z|\.so\z|\.dylib\z|/docs?/build/|/docs?/_build/"
)
VALUABLE = r"(?:webpack|rollup|vite|next|nuxt|tailwind)\.config\.[jt]s\z|gatsby-config\.[jt]s\z"
CONFIG = (
    r"^(?:package\.json|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|composer\.lock|(?:webpack|rollup|vite|babel|jest)\.config\.[jt]s|\.editorconfig|\.gitignore|\.gitattributes|\.dockerignore|\.gitlab-ci\.yml|\.travis\.yml|appveyor\.yml|azure-pipelines\.yml)\z"
    r"|^\.eslintrc|^\.prettierrc|^\.vscode/|^\.idea/|\.iml\z|^\.github/|^\.env|^docker-compose"
)
#: Signs of low quality in the content, in order: pattern, reason, least length.  Fixed values.
INDICATORS = (
    (r"\A[^\n\r\x{2028}\x{2029}]{200,}\z", "Very long lines (likely minified)", 0),
    (r"[a-zA-Z]{50,}", "Very long identifiers (likely obfuscated)", 0),
    (r"\w{1,2}=function\(\w{1,2}\)", "Minified function patterns", 0),
    (r"This file was generated automatically", "Contains generation marker", 0),
    (r"DO NOT EDIT", "Contains do-not-edit warning", 0),
    (r"Auto-generated by .+", "Contains auto-generation marker", 0),
    (r"Generated on [0-9]{4}-[0-9]{2}-[0-9]{2}", "Contains generation timestamp", 0),
    (rf"\A{X.WS}*[\[{{]", "Starts with JSON/data structure", 10_000),
)
CODE = r"function{w}*\(|class{w}+\w+|import{w}+|export{w}+|const{w}+\w+{w}*=|let{w}+\w+{w}*=|var{w}+\w+{w}*=".replace("{w}", X.WS)
LARGE = 500_000


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(TEST)


def is_generated(path: Column) -> Column:
    return F.lower(path).rlike(GENERATED)


def comment_ratio(content: Column) -> Column:
    all_lines = X.lines(content)
    mark = lambda x: X.trim(x).rlike(r"^(?://|#|/\*|\*|<!--)")
    return F.size(F.filter(all_lines, mark)) / F.size(all_lines)


def whitespace_ratio(content: Column) -> Column:
    return X.ratio(F.regexp_count(content, F.lit(X.WS)), F.length(content))


def is_binary(content: Column) -> Column:
    """Whether it holds a NUL, or more than a tenth of its first 1000 characters are control characters."""
    head = F.left(content, F.lit(1000))
    odd = F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    return F.coalesce(content.rlike(r"\x00"), F.lit(False)) | (X.ratio(odd, F.length(head)) > 0.1)


def repeated_share(content: Column) -> Column:
    """(most, n): how often the most frequent trimmed line occurs, and how many lines aren't blank."""
    kept = F.filter(F.transform(X.lines(content), X.trim), lambda x: x != "")
    ordered = F.array_sort(kept)  # equal lines stand together: the longest run is the largest count
    empty = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"], s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.struct(F.aggregate(ordered, empty, step)["most"].alias("most"), F.size(kept).alias("n"))


def is_repetitive(content: Column) -> Column:
    utility = content.rlike("export class (?:Logger|Utils|Helper)") | (content.contains("debug(") & content.contains("info(") & content.contains("warn(") & content.contains("error("))
    share = repeated_share(content)
    return F.when(F.size(X.lines(content)) < 20, F.lit(False)).when(utility, F.lit(False)).otherwise((share["most"] > 10) & (X.ratio(share["most"], share["n"]) > 0.2))


def is_data(content: Column) -> Column:
    trimmed, all_lines = X.trim(content), X.lines(content)
    bracketed = (trimmed.startswith("{") & trimmed.endswith("}")) | (trimmed.startswith("[") & trimmed.endswith("]"))
    commas = F.regexp_count(F.array_join(F.slice(all_lines, 1, 10), "\n"), F.lit(","))
    return F.when(bracketed, ~content.rlike(CODE) & (F.length(content) > 5000)).otherwise(content.contains(",") & (F.size(all_lines) > 50) & (commas > 30))


def _result(include: bool, reason: str, confidence: float) -> Column:
    return F.struct(F.lit(include).alias("include"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))


def cascade(path: str | Column = "rel_path", content: str | Column = "content") -> Column:
    """The struct (include, reason, confidence) of a file.  Null content is ``No content``."""
    p, c = X.col(path), X.col(content)
    name = F.lower(X.basename(p))
    rules = F.when(c.isNull(), _result(False, "No content", 1.0)).when(is_test(p), _result(False, "Test file", 0.9))
    rules = rules.when(is_generated(p), _result(False, "Generated file", 0.95)).when(name.rlike(VALUABLE), _result(True, "Valuable configuration file", 0.7)).when(F.lower(p).rlike(CONFIG) | name.rlike(CONFIG), _result(False, "Configuration file", 0.85))
    rules = rules.when(F.length(c) > LARGE, _result(False, "File too large (likely data file)", 0.9))
    for pattern, reason, least in INDICATORS:
        rules = rules.when((F.length(c) >= least) & c.rlike(pattern), _result(False, reason, 0.8))
    rules = rules.when(comment_ratio(c) > 0.8, _result(False, "Mostly comments (documentation file)", 0.75)).when(whitespace_ratio(c) > 0.6, _result(False, "Mostly whitespace (formatting file)", 0.75))
    rules = rules.when(is_repetitive(c), _result(False, "Contains repeated patterns (likely generated)", 0.75)).when(is_data(c), _result(False, "Appears to be data/configuration content", 0.75))
    return rules.when(is_binary(c), _result(False, "Binary content", 1.0)).otherwise(_result(True, "Source code file", 0.8))


def classify(files: DataFrame) -> DataFrame:
    """The files with ``include``, ``reason`` and ``confidence`` (existing columns of these names are replaced)."""
    kept = files.drop("include", "reason", "confidence")
    return kept.withColumn("_result", cascade()).select(*kept.columns, "_result.*")


def keep(files: DataFrame) -> DataFrame:
    """The files to index; by size first, so that large contents aren't read on."""
    return classify(files.where(F.coalesce(F.col("size"), F.lit(0)) <= LARGE)).where("include").drop("include", "reason", "confidence")


def pattern_counts() -> dict[str, int]:
    """How many alternatives each list of patterns has."""
    return {"test": TEST.count("|") + 1, "generated": GENERATED.count("|") + 1, "valuable": VALUABLE.count("|") + 1, "config": CONFIG.count("|") + 1, "quality": len(INDICATORS)}
