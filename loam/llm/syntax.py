"""Source files that do not parse.

No operator may stand before a closing delimiter, the end of a statement or of the file.
``parse_errors`` runs the lexer of the file's language with its pushdown stack and then
looks at the skeleton for what the language's grammar can't continue with:

* Python: a second pushdown stack follows the indentation and what each block began with; a
  block must follow its head, heads end in a colon, ``else`` and the like need their partner, and
  two operands or an operator without one can't stand side by side.  What stack and lexer
  report is then confirmed or cleared by the compiler, which is asked about nothing else.
* Go: a package clause must come first; only import, func, type, var and const may begin a
  top-level declaration; a line can't end in a semicolon after a closed block, and words of
  other languages can't stand where a statement begins.
* Java: only package, import and type declarations may stand outside of a type; ``:=``,
  untyped functions and unterminated statements don't exist.
* JavaScript: no two operands without an operator on one line; no type annotations, access
  modifiers, interfaces or other additions of TypeScript.
* TypeScript: no two operands without an operator on one line, but for declarations.
"""

from __future__ import annotations

import ast
import keyword
import re
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.lexers import EXTENSIONS, scan

#: Words of JavaScript that may stand directly before an operand or a name.
_BEFORE_JS = frozenset(
    "var let const function class return typeof new delete void throw case in of instanceof await yield async static get set else do "
    "import export default from extends as break continue try finally".split()
)
#: Words that may stand directly after an operand.
_AFTER_JS = frozenset("in of instanceof as from extends".split())
_BEFORE_TS = _BEFORE_JS | frozenset(
    "interface type enum namespace module declare abstract public private protected readonly override keyof unique infer is asserts satisfies implements out accessor global".split()
)
_AFTER_TS = _AFTER_JS | frozenset("is satisfies implements asserts".split())
_TYPE_WORDS = frozenset("unknown any const string number boolean".split())

_NEIGHBOURS = re.compile(r'(?<![\w$])([\w$]++|""|\])[ \t]++(?=([\w$"#][\w$]*))')
_JS_TYPE = re.compile(r"(?:const|let|var)[ \t]+[\w$]+[ \t]*:|<[\w$]+(?:\[\])?(?:,[ \t]*[\w$]+(?:\[\])?)*>\(")
_JS_TYPED = re.compile(r"\)[ \t]*:[ \t]*[\w${\[][^\n?]*(?:\{|=>)[ \t\r]*$|^[ \t]*[\w$]+\??:[ \t]*(?:string|number|boolean|any|unknown|void|Map<|Array<|Promise<|\{)[^\n]*,?[ \t\r]*$", re.M)
_JS_PARAMETERS = re.compile(r"(?:function[ \t]*\*?[ \t]*[\w$]*|const[ \t]+[\w$]+[ \t]*=[ \t]*(?:async[ \t]*)?|^[ \t]*(?:async[ \t]+|static[ \t]+)*+(?!(?:if|for|while|switch|catch|return|with)\b)[\w$#]++)[ \t]*\(([^()]*)\)[^\n]*\{[ \t\r]*$", re.M)
_JS_ANNOTATED = re.compile(r"(?:^|,)\s*[\w$]+\??\s*:")
_HEADS = re.compile(r"^[ \t]*+(?:(?:package|func|def|elif|defer|chan)[ \t]+[\w$(]|(?:if|for|while|switch)[ \t]*\{|# |import \()", re.M)

_JAVA_TOP = re.compile(r"\s*(?:(?:package|import)\b[^;{}]*;|;|(?:@[\w.]+(?:\s*\([^()]*\))?\s*|(?:public|private|protected|abstract|final|static|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+\w+[^{};]*\{\})")
_JAVA_FOREIGN = re.compile(r":=|(?m:^[ \t]*(?:func|def|elif|defer|go|const|let|function|export|type)[ \t]+[\w$(])|===|\b(?:if|for|while)[ \t]+[\w$!][^\n]*\{[ \t\r]*$|(?m:^[ \t]*switch[ \t]*\{)|(?m:\([ \t]*\w+[ \t]*:[ \t]*\w)|`")
_GO_TOP = re.compile(r"(?:import|func|type|var|const)\b")
_GO_FOREIGN = re.compile(r"(?m:^[ \t]*(?:public|private|protected|class|function|export|def|let|while|try|throw|elif|async|from|@\w+)\b[ \t({]*)|=>|->|===|(?m:\}[ \t]*;[ \t\r]*$)|(?m:^[ \t]*(?:if|while|switch|for)[ \t]*\([^\n]*\)[ \t]*\{[ \t\r]*$)|(?m:^\s*#[ \t])")


#: An operator that lacks its right operand, or its left one.
_DANGLING = re.compile(r"(?:(?<![=!<>])=(?!>)|[+\-*/%&|^!<>=]=|&&|\|\||\?\?|%|\^|(?<!\+)\+(?!\+)|(?<!-)-(?!-))\s*+(?:[;)\]}]|\Z)|[=+/%&|^-][ \t]++=(?![=>])")
_NO_NAME = re.compile(r"(?<![\w$.])(?:const|let|var)[ \t]*+=(?![=>])")

# --- Python -----------------------------------------------------------------------------

_GROUP = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_JOINED = re.compile(r"\\\r?\n")
_PY_WORDS = frozenset([*keyword.kwlist, "match", "case", "type"])
_PY_VALUES = frozenset(("None", "True", "False"))
_PY_ENDS = frozenset("return yield pass break continue raise else try finally except lambda case print match type".split()) | _PY_VALUES
_PY_OPERANDS = re.compile(r"([\w.]++|\"\"|\(\))[ \t]++(?=([\w\"(]\w*))")
_PY_ODD = re.compile(r"[?$`]|!(?!=)|&&|\|\||\+\+$|:=\s*$|=[ \t]+=(?!=)|=>|(?<![\w)\]}\"])\.(?![\w.])|;;|//=?\s*$|[=+\-*/%&|^<>~@]\s*(?:[:;,]|$)|\b(?:and|or|not|in|is|if|import|from|as|del|global|nonlocal|assert|elif|while|for|with|def|class|await|else|lambda|case)\s*$|(?<![.])\.\s*$|^\s*assert\b.*,\s*$|^\s*(?:match|case)[ \t]+[\w\"(][^:=]*$|[\w)\"][ \t]+if\b(?!.*(?:\belse\b|:[ \t\r]*$))", re.M)
_PY_HEAD = re.compile(r"(?:async[ \t]+)?(if|elif|else|for|while|try|except|finally|with|def|class)\b")
#: What an else or the like may follow.
_PARTNER = {"else": ("if", "elif", "for", "while", "except"), "elif": ("if", "elif"), "except": ("try", "except"), "finally": ("try", "except", "else")}


def _python(s: str) -> str | None:
    """What the stack of blocks can't accept in the skeleton of a Python source."""
    s = _JOINED.sub(" ", s)
    if (m := _PY_ODD.search(_inner(s))) and " if" not in m.group():  # a comprehension has no else
        return f"'{m.group().strip()[:20]}' within brackets"
    while (t := _GROUP.sub("\x01", s)) != s:
        s = t
    s = s.replace("\x01", "()")
    indents, kinds, opened = [0], [""], None
    for line in s.split("\n"):
        text = line.strip()
        if not text:
            continue
        width = len(line) - len(line.lstrip())
        if "\t" in line[:width]:
            width = len(line[:width].expandtabs())
        if opened:
            if width <= indents[-1]:
                return f"no block after '{opened}'"
            indents.append(width)
            kinds.append("")
            opened = None
        elif width > indents[-1]:
            return "unexpected indent"
        else:
            while width < indents[-1]:
                if kinds[-1] == "try":
                    return "'try' without 'except' or 'finally'"
                indents.pop()
                kinds.pop()
            if width != indents[-1]:
                return "unindent to no outer level"
        head = _PY_HEAD.match(text)
        word = head.group(1) if head else ""
        if kinds[-1] == "try" and word not in ("except", "finally") or word in _PARTNER and kinds[-1] not in _PARTNER[word]:
            return f"'{word or kinds[-1]}' without its partner"
        kinds[-1] = word
        if text[-1] == ":":
            opened = text.split(None, 1)[0]
            if not word and not re.match(r"(?:match|case)\b|async\s", text):
                return f"':' after '{text[:20]}'"
        elif word and ":" not in text:
            return f"no ':' after '{word}'"
        if m := _PY_ODD.search(text):
            return f"'{m.group().strip()[:20]}' is out of place"
        for a, b in _PY_OPERANDS.findall(text):
            if (a not in _PY_WORDS or a in _PY_VALUES) and (b not in _PY_WORDS or b in _PY_VALUES) and not (b[0] == "(" and a[0] not in "(\"") and not (a == b == '""'):
                if not (a == '""' and b[0] == '"') and not re.fullmatch(r"[rbfuRBFU]{1,2}", b):
                    return f"'{b[:20]}' after '{a[:20]}'"
    if opened:
        return f"no block after '{opened}'"
    return "'try' without 'except' or 'finally'" if "try" in kinds else None


def _inner(s: str) -> str:
    """The insides of the innermost brackets, one a line."""
    return "\n".join(x[1:-1].replace("\n", " ").strip(" ,*:") for x in _GROUP.findall(s))


# --- the other languages ----------------------------------------------------------------


def _outside(skeleton: str) -> str:
    """The skeleton with the insides of its outermost blocks removed."""
    depth, at, out = 0, 0, []
    for m in re.finditer(r"\{|\}", skeleton):
        if m.group() == "{":
            if not depth:
                out.append(skeleton[at : m.end()])
            depth += 1
        else:
            depth -= 1
            if not depth:
                at = m.start()
    return "".join(out) + skeleton[at:]


def _go(s: str) -> str | None:
    head = re.match(r"\s*package[ \t]+(\w+)[ \t\r]*(?:[\n;]|\Z)", s)
    if not head:
        return "no package clause"
    if m := _GO_FOREIGN.search(s):
        return f"'{m.group().strip()[:20]}' is no Go"
    top = re.sub(r"\([^()]*\)", "()", _outside(s[head.end() :]))
    for line in top.split("\n"):
        text = line.strip()
        if text and not (_GO_TOP.match(text) or text[0] in ")}"):
            return f"'{text[:20]}' outside of a declaration"
    return None


def _java(s: str) -> str | None:
    if m := _JAVA_FOREIGN.search(s):
        return f"'{m.group().strip()[:20]}' is no Java"
    top, at = _outside(s), 0
    while m := _JAVA_TOP.match(top, at):
        at = m.end()
    if rest := top[at:].strip():
        return f"'{rest[:20]}' outside of a type"
    return None


def _javascript(s: str, typed: bool) -> str | None:
    before, after = (_BEFORE_TS, _AFTER_TS) if typed else (_BEFORE_JS, _AFTER_JS)
    for a, b in set(_NEIGHBOURS.findall(s)):
        if a not in before and b not in after and (a, b) != ("for", "await"):
            return f"'{b[:20]}' after '{a[:20]}'"
        if not typed and a == "as" and b in _TYPE_WORDS:
            return f"'as {b}' is no JavaScript"
    if ":=" in s:
        return "':=' is no operator"
    if m := _HEADS.search(s):
        return f"'{m.group().strip()[:20]}' can't begin a statement"
    if not typed and (m := _JS_TYPE.search(s)):
        return f"type annotation '{m.group()[:20]}'"
    if not typed:
        if m := _JS_TYPED.search(s):
            return f"type annotation '{m.group().strip()[:20]}'"
        for m in _JS_PARAMETERS.finditer(s):
            if _JS_ANNOTATED.search(m.group(1)):
                return "type annotation of a parameter"
    first = s.lstrip()
    if first[:1] == "{" and re.match(r'\{\s*""\s*:', first):
        return "data instead of statements"
    return None


def parse_errors(path: str | None, content: str | None) -> list[str] | None:
    """The errors of a file in the language of its extension, at most a few; empty if it is valid.

    Null content has none to state (null).  Blank content is valid.  An unknown extension
    has no grammar to break and is valid.
    """
    if content is None:
        return None
    lang = EXTENSIONS.get((path or "").rsplit(".", 1)[-1].lower())
    if lang is None or not content.strip():
        return []
    if content[0] == "\ufeff":
        content = content[1:]
    skeleton, errors = scan(content, lang)
    return shape_errors(content, skeleton, errors, lang)


def shape_errors(content: str, skeleton: str, errors: list[str], lang: str) -> list[str]:
    """The lexer's errors or, beyond them, what the skeleton tells; in Python if the compiler agrees."""
    if lang == "python":
        if not errors and (said := _python(skeleton)):
            errors = [said]
        return confirmed(content, errors) if errors else []
    if errors:
        return errors
    said = _go(skeleton) if lang == "go" else _java(skeleton) if lang == "java" else _javascript(skeleton, lang == "typescript")
    if not said and (m := _DANGLING.search(skeleton) or lang in ("javascript", "typescript") and _NO_NAME.search(skeleton)):
        said = f"'{m.group().strip()[:20]}' lacks an operand"
    return [said] if said else []


def confirmed(content: str, said: list[str]) -> list[str]:
    """What lexer and stack said of a Python source, unless the compiler accepts it all the same."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(content, "file", "exec", ast.PyCF_ONLY_AST)
    except (SyntaxError, ValueError) as e:
        return [*said, str(getattr(e, "msg", e))]
    except (RecursionError, MemoryError):
        return said
    return []


def latest(rows: DataFrame, values: list[str]) -> DataFrame:
    """path and ``values`` of the row with the latest mtime of each path; rows without a time are
    the oldest, and of several the one whose content hash is largest holds.

    ``rows`` has ``path``, ``mtime`` and ``content_hash``: it is made from the files first, so that
    no file content is shuffled to find the latest."""
    at = F.struct(F.coalesce(F.col("mtime").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), F.coalesce("content_hash", F.lit(0)).alias("h"))
    return rows.where(F.col("path").isNotNull()).groupBy("path").agg(F.max_by(F.struct(*values), at).alias("v")).select("path", "v.*")


def check(files: DataFrame) -> DataFrame:
    """path, namespace, language (of the extension if null) and parse_errors of every file's latest row.

    A null path names no file and is left out.  Null content has null errors; blank content
    has none.  Repeated rows count once; further columns are ignored.
    """
    chosen = files.select("path", "namespace", "language", "mtime", F.xxhash64("content").alias("content_hash"), "content")

    def errors(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            own = [parse_errors(p, c) for p, c in zip(b["path"], b["content"])]
            lang = [x or EXTENSIONS.get((p or "").rsplit(".", 1)[-1].lower()) for p, x in zip(b["path"], b["language"])]
            yield b.drop(columns="content").assign(language=lang, parse_errors=pd.Series(own, dtype=object, index=b.index))

    made = chosen.mapInPandas(errors, "path string, namespace string, language string, mtime timestamp_ntz, content_hash bigint, parse_errors array<string>")
    return latest(made, ["namespace", "language", "parse_errors"])


def rates(checked: DataFrame) -> DataFrame:
    """Per namespace and language: files with content, invalid ones and their rate."""
    known = checked.where(F.col("parse_errors").isNotNull())
    bad = F.count_if(F.size("parse_errors") > 0)
    return known.groupBy("namespace", "language").agg(F.count("*").alias("files"), bad.alias("invalid"), (bad / F.count("*")).alias("rate"))
