"""Generated, minified, vendored and data files among sources, by belief propagation.

Every repository's directories form a tree, its files are the leaves.  A file has evidence
for each of five labels from its own text and from how many of its declarations other
files repeat; a directory has some from its name.  One sweep up and one down the tree pass
log messages between children and parents; as the graph is a tree, the beliefs are then exact.
A directory only ever sends sums of its children's messages, so a directory that holds a
third of all files costs partial sums and no gathering; on their way down, beliefs of the few
largest directories are broadcast, as are the few declarations that most files repeat.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.lexers import EXTENSIONS, scan
from loam.llm.syntax import latest
from loam.sources.tables import materialize, skew_join

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
REASONS = ("Source code file", "Generated file", "Minified", "Vendored copy", "Data file")

DISTINCT = 40  # characters of a declaration that says whose it is

#: A label of a directory (row) and of a file in it (column); of a directory and of one in it.
FILE_IN = ((0.80, 0.06, 0.05, 0.04, 0.05), (0.12, 0.76, 0.04, 0.04, 0.04), (0.12, 0.04, 0.76, 0.04, 0.04), (0.02, 0.02, 0.02, 0.92, 0.02), (0.12, 0.04, 0.04, 0.04, 0.76))
DIR_IN = tuple(tuple(0.72 if a == b else 0.07 for b in range(5)) for a in range(5))

#: Names of directories and what they tell for (label, log weight).  Fixed values.
DIRECTORY_NAMES = (
    (r"/(?:node_modules|bower_components|vendor|_vendor|vendored|third_party|thirdparty|third-party|external|externals|deps)(?:/|$)", 3, 7.5),
    (r"/[a-z][\w-]*[@-]\d+\.\d+(?:\.\d+)?(?:/|$)", 3, 4.0),
    (r"/(?:generated|gen|__generated__|autogen|pb|stubs)$", 1, 1.0),
    (r"/(?:dist|build|out|target)$", 1, 0.5),
    (r"/(?:min|minified|static|public)$", 2, 0.3),
    (r"", 0, 1.5),
)

#: What generators write at the head of their output, or at its foot.  Fixed values.
_GENERATED_HEAD = re.compile(
    r"^[\s/#*<!\"'-]*(?:code generated by|this (?:file|code|class) (?:was|is|has been) (?:auto(?:matically)?[- ]?)?generated|auto-?generated file|file auto-?generated|"
    r"<auto-?generated>|@generated\b|automatically generated|automatisch (?:erzeugt|generiert)|fichier (?:produit|généré)|généré automatiquement|generado automáticamente|"
    r"autogenerated (?:by|from)\b|this (?:file|module|class|code) (?:was|is|has been) (?:re)?(?:built|generated|produced) (?:by|from|with|automatically)\b|do not (?:edit|modify|change)\b.{0,60}\b(?:re)?(?:generated|built|produced|overwritten)\b|"
    r"archivo generado|сгенерировано|автоматически создан|自動生成|produced by the [\w.-]+ (?:compiler|generator)|generated (?:on|by|from|with)\b)",
    re.I | re.M,
)
#: What is written over a copy of a library.  Fixed values.
_VENDORED_HEAD = re.compile(r"@license\s+[\w@/.-]+@\d|^\W*upstream:\s*\w|\b[\w-]+ v?\d+\.\d+[\w.]* -- https?://|^\W*[@A-Za-z][\w./@-]* v?\d+\.\d+[\w.]*\b.{0,60}(?:\(c\)|©|\blicen[cs]e)|(?:taken|copied) (?:unchanged |verbatim )?from [\w-]+ v?\d", re.I | re.M)
_NUMBERED = re.compile(r"(?<=[A-Za-z_])(\d{3,4})(?!\d)")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_DECLARATION = re.compile(
    r"^[ \t]*+(?!(?:if|for|while|switch|return|catch|try|case|else|log)\b|\})(?:(?:export|default|async|public|private|protected|static|final|abstract)\s+)*"
    r"(?:function\b|def\b|func\b|class\b|(?:const|let)\s+\w+\s*=\s*(?:async\s*)?\([^\n]*=>|[\w<>\[\], ]+\([^\n]*\)\s*(?::[^\n]*)?\{)[^\n]*$",
    re.M,
)


def remarks(content: str, path: str | None, places: list[tuple[int, int]], broken: bool) -> str:
    """The comments of a source and, in Python, its documentation strings, but no other literals.

    A comment behind code does not begin a line.  A text whose language isn't known or whose
    lexer stopped is given whole."""
    lang = EXTENSIONS.get((path or "").rsplit(".", 1)[-1].lower())
    if lang is None or broken:
        return content
    out, last, top = [], 0, True
    for start, end in places:
        gap = content[last:start]
        last = end
        top = top and not gap.strip()
        if lang == "python" and content[start] != "#" and not (top or gap.rstrip().endswith(":")):
            top = False
            continue
        line = gap[gap.rfind("\n") + 1 :]
        out.append(("x " if line.strip() else "") + content[start:end])
    return "\n".join(out)


def evidence(path: str | None, content: str | None) -> tuple[list[float], list[str]]:
    """The log weights of the five labels from a file's own text, and its longer declaration lines."""
    if not content or not content.strip():
        return [2.0, 0.0, 0.0, 0.0, 0.0], []
    weight = [2.0, -3.0, -3.0, 0.0, -3.0]  # what the text itself would show is unlikely without its signs
    lang = EXTENSIONS.get((path or "").rsplit(".", 1)[-1].lower(), "javascript")
    places: list[tuple[int, int]] = []
    skeleton, errors = scan(content, lang, places)
    said = remarks(content, path, places, bool(errors))
    numbers = {int(x) for x in _NUMBERED.findall(skeleton)}
    first = 1 if 1 in numbers else 0
    run = 0
    while first + run in numbers:
        run += 1
    if run >= 5:  # members numbered throughout
        weight[1] += min(12.0, 6.0 + run)
    if _GENERATED_HEAD.search(said):
        weight[1] += 8.0
    blank = len(skeleton) - len("".join(skeleton.split()))
    dense = blank / max(1, len(skeleton))
    words = len(_WORD.findall(skeleton)) / len(content)
    if words < 0.008 and len(content) >= 300:
        weight[4] += 11.0
    elif dense < 0.06 and len(skeleton) >= 200:
        weight[2] += 11.0
    elif dense < 0.10 and len(skeleton) >= 200:
        weight[2] += 3.0
    if _VENDORED_HEAD.search(said):
        weight[3] += 5.0
    lines = {x.strip() for x in _DECLARATION.findall(content)}
    return weight, [x for x in lines if len(x) >= DISTINCT]


def file_evidence(files: DataFrame) -> DataFrame:
    """namespace, path, folder, the five weights, n (declarations) and known, written once.

    A file is a copy if other files repeat at least six in ten of its declarations, and often
    enough: the logarithms of how many files have each sum to 3, as with three in two files each
    or one in eight."""
    chosen = files.select("path", "rel_path", "namespace", "mtime", F.xxhash64("content").alias("content_hash"), "content")

    def weigh(batches: Iterator) -> Iterator:
        import pandas as pd
        import xxhash

        for b in batches:
            made = [evidence(p, c) for p, c in zip(b["path"], b["content"])]
            marks = [[xxhash.xxh3_64_intdigest(x) - 2**63 for x in d] for _, d in made]
            yield b.assign(known=b["content"].notna(), w=pd.Series([w for w, _ in made], dtype=object, index=b.index), marks=pd.Series(marks, dtype=object, index=b.index)).drop(columns="content")

    own = chosen.mapInPandas(weigh, "path string, rel_path string, namespace string, mtime timestamp_ntz, content_hash bigint, known boolean, w array<double>, marks array<bigint>")
    one = materialize(latest(own, ["namespace", "rel_path", "known", "w", "marks"]))
    each = one.select("path", F.explode("marks").alias("mark"))
    repeated = materialize(each.groupBy("mark").agg(F.count("*").alias("files")).where(F.col("files") > 1))
    shared = skew_join(each, repeated, "mark", "files").groupBy("path").agg(F.count("*").alias("shared"), F.sum(F.least(F.log2("files"), F.lit(4.0))).alias("strength"))
    n, s, strength = F.size("marks"), F.coalesce("shared", F.lit(0)), F.coalesce("strength", F.lit(0.0))
    copy = F.when((strength >= 3) & (s >= 0.6 * n), F.lit(6.0) + F.least(F.lit(3.0), strength / 2)).otherwise(0.0)
    folder = F.concat(F.coalesce("namespace", F.lit("")), F.lit(":/"), F.regexp_replace(F.coalesce("rel_path", "path"), r"/?[^/]*$", ""))
    return materialize(one.join(shared, "path", "left").select("path", "known", F.regexp_replace(folder, "/+", "/").alias("folder"), *[(F.col("w")[i] + (copy if i == 3 else 0.0)).alias(f"e{i}") for i in range(5)]))


def _passed(psi: tuple, value: list[Column]) -> list[Column]:
    """The message through a compatibility: for each label of the receiver log sum psi * exp(value)."""
    top = F.greatest(*value)
    return [top + F.log(sum((F.exp(v - top) * psi[i][j] for j, v in enumerate(value)), F.lit(0.0))) for i in range(5)]


def _transposed(psi: tuple) -> tuple:
    return tuple(zip(*psi))


def _columns(prefix: str, values: list[Column]) -> list[Column]:
    return [v.alias(f"{prefix}{i}") for i, v in enumerate(values)]


def _name_weight(label: int) -> Column:
    return sum((F.when(F.col("folder").rlike(p), F.lit(w)).otherwise(0.0) for p, i, w in DIRECTORY_NAMES if i == label), F.lit(0.0))


def beliefs(weighed: DataFrame) -> DataFrame:
    """path, known, label and margin (log odds against the second label) from file evidence."""
    e = [F.col(f"e{i}") for i in range(5)]
    sent = weighed.select("path", "known", "folder", *e, *_columns("m", _passed(FILE_IN, e)))
    sums = sent.groupBy("folder").agg(F.count("*").alias("files"), *[F.sum(f"m{i}").alias(f"s{i}") for i in range(5)])
    segments = F.split("folder", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.array_join(F.slice(segments, 1, k), "/"))
    every = sums.select(F.explode(chain).alias("folder")).distinct()
    nodes = every.join(sums, "folder", "left").select(
        "folder", F.coalesce("files", F.lit(0)).alias("files"), F.size(segments).alias("depth"), F.regexp_replace("folder", r"/[^/]*$", "").alias("parent"), *[(F.coalesce(f"s{i}", F.lit(0.0)) + _name_weight(i)).alias(f"s{i}") for i in range(5)]
    )
    nodes = materialize(nodes)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    up: dict[int, DataFrame] = {}
    below = None
    total = [F.col(f"t{i}") for i in range(5)]
    for k in range(deepest, 0, -1):
        level = nodes.where(F.col("depth") == k)
        if below is None:
            level = level.select("folder", "parent", *[F.col(f"s{i}").alias(f"t{i}") for i in range(5)])
        else:
            gathered = below.groupBy(F.col("parent").alias("folder")).agg(*[F.sum(f"u{i}").alias(f"c{i}") for i in range(5)])
            level = level.join(gathered, "folder", "left").select("folder", "parent", *[(F.col(f"s{i}") + F.coalesce(f"c{i}", F.lit(0.0))).alias(f"t{i}") for i in range(5)])
        below = up[k] = materialize(level.select("folder", "parent", *total, *_columns("u", _passed(DIR_IN, total))))
    belief, above = [], None
    for k in range(1, deepest + 1):
        if above is None:
            at = up[k].select("folder", *[F.col(f"t{i}").alias(f"b{i}") for i in range(5)])
        else:
            rest = [F.col(f"b{i}") - F.col(f"u{i}") for i in range(5)]
            down = _passed(_transposed(DIR_IN), rest)
            at = up[k].join(above.withColumnRenamed("folder", "parent"), "parent").select("folder", *[(F.col(f"t{i}") + down[i]).alias(f"b{i}") for i in range(5)])
        above = materialize(at)
        belief.append(above)
    if not belief:
        return weighed.select("path", "known", F.lit(LABELS[0]).alias("label"), F.lit(0.0).alias("margin"))
    folders = belief[0]
    for b in belief[1:]:
        folders = folders.unionByName(b)
    heard = _passed(_transposed(FILE_IN), [F.col(f"b{i}") - F.col(f"m{i}") for i in range(5)])
    scored = F.array_sort(F.array(*[F.struct((-(e[i] + heard[i])).alias("s"), F.lit(i).alias("i")) for i in range(5)]))
    holding = materialize(folders.join(nodes.where(F.col("files") > 0).select("folder", "files"), "folder"))
    done = skew_join(sent, holding, "folder", "files").select("path", "known", scored.alias("x"))
    return done.select("path", "known", F.element_at(F.array(*map(F.lit, LABELS)), F.col("x")[0]["i"] + 1).alias("label"), (F.col("x")[1]["s"] - F.col("x")[0]["s"]).alias("margin"))


def classify(files: DataFrame) -> DataFrame:
    """path, include, reason, confidence and label of every file's latest row.

    Only handwritten files are included.  Null content is not included, reason ``No content``
    and no label; blank content is a source file.  A null path names no file.
    """
    found = beliefs(file_evidence(files))
    reason = F.element_at(F.create_map(*[F.lit(x) for pair in zip(LABELS, REASONS) for x in pair]), F.col("label"))
    return found.select(
        "path", (F.col("known") & (F.col("label") == LABELS[0])).alias("include"), F.when(F.col("known"), reason).otherwise("No content").alias("reason"),
        F.when(F.col("known"), 1 / (1 + F.exp(-F.col("margin")))).otherwise(1.0).alias("confidence"), F.when(F.col("known"), F.col("label")).alias("label"),
    )


def odds(psi: tuple) -> float:
    """The most that one message through a compatibility can add to the log odds of two labels."""
    return max(math.log(r[i] / r[j]) for r in _transposed(psi) for i in range(5) for j in range(5))
