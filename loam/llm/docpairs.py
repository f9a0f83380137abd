"""Functions paired with their documentation.

Each language has a parsing-expression grammar for a documented declaration.  The lexer
finds the places at which one can begin (a documentation comment, or ``def`` in Python),
outside of literals and other comments; the grammar parses from there, keeping source
offsets, and its action emits the name, parameters, return type and documentation.
Pairs whose documentation says nothing are dropped, and files that are not valid in their
language give none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.lexers import EXTENSIONS, TOKENS, scan
from loam.llm.peg import Run, capture, choice, many, maybe, rule, seq, term
from loam.llm.syntax import latest, shape_errors

# --- grammars ---------------------------------------------------------------------------

_STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`'
S = r"\s*+"  # spacing
_WORD = r"[^\W\d]\w*"

_inside = rule("inside")
_inside.is_ = many(choice(r"[^()\[\]{}\"'`/]++", _STRING, r"//[^\n]*|/\*(?s:.*?)\*/|/", seq(r"\(", _inside, r"\)"), seq(r"\[", _inside, r"\]"), seq(r"\{", _inside, r"\}")))
_params = seq(r"\(", capture("parameters", _inside), r"\)")
_generic = rule("generic")
_generic.is_ = seq("<", many(choice(r"[^<>(){}\"']++", "=>", _generic, _STRING, seq(r"\(", _inside, r"\)"), seq(r"\{", _inside, r"\}"))), ">")

# JavaScript and TypeScript
_NAME = r"[#\w$]+"
_type = rule("type")
_primary = seq(
    many(r"(?:keyof|readonly|typeof|unique|infer|asserts)\s+"),
    choice(seq(r"\{", _inside, r"\}"), seq(r"\[", _inside, r"\]"), seq(r"\(", _inside, r"\)", maybe(seq(S, "=>", S, _type))), _STRING, seq(r"[\w$.]+", maybe(_generic), maybe(seq(r"\s+is\s+", _type)))),
    many(choice(r"\[\]", seq(r"\[", _inside, r"\]"))),
)
_type.is_ = seq(r"\s*[|&]?\s*", _primary, many(seq(r"\s*[|&]\s*", _primary)))
_returns = maybe(seq(r"\s*:\s*", capture("returns", _type)))
_NO_NAME = r"(?!(?:if|for|while|switch|catch|return|with|function|super|new|throw|typeof|await|do|else|case)\b)"
_JS_BETWEEN = many(choice(r"\s+", seq(r"@[\w$.]+", maybe(seq(r"\(", _inside, r"\)"))), r"//[ \t]*(?:@ts-|eslint|prettier|tslint|istanbul|c8|v8|biome|jshint|#__|@)[^\n]*", r"/\*[ \t]*(?:eslint|prettier|istanbul|c8|v8|#__|@__)(?s:.*?)\*/"))
_js_function = seq(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*", capture("name", _NAME), S, maybe(_generic), S, _params, _returns)
_js_arrow = seq(
    r"(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+", capture("name", _NAME), maybe(seq(r"\s*:\s*", _type)), r"\s*=\s*(?:async\b\s*)?",
    choice(seq(r"function\s*\*?\s*(?:[\w$]+)?\s*", _params, _returns), seq(maybe(_generic), S, _params, _returns, r"\s*=>"), seq(capture("parameters", r"[\w$]+"), r"\s*=>")),
)
_MODIFIERS = r"(?:(?:public|private|protected|static|readonly|override|abstract|declare|accessor)\s+)*+"
_js_method = seq(_MODIFIERS + r"(?:async\s+(?!\())?\*?\s*(?:(?:get|set)\s+(?![(=]))?" + _NO_NAME, capture("name", _NAME), r"\??\s*", maybe(_generic), _params, _returns, r"\s*[{;]")
_js_field = seq(_MODIFIERS + _NO_NAME, capture("name", _NAME), maybe(seq(r"\s*:\s*", _type)), r"\s*=\s*(?:async\b\s*)?", choice(seq(maybe(_generic), _params, _returns, r"\s*=>"), seq(capture("parameters", r"[\w$]+"), r"\s*=>")))
_javascript = seq(_JS_BETWEEN, choice(_js_function, _js_arrow, _js_method, _js_field))

# Java
_JAVA_BETWEEN = many(choice(r"\s+", seq(r"@(?!interface\b)[\w.]+", S, maybe(seq(r"\(", _inside, r"\)"))), r"//[ \t]*(?:CHECKSTYLE|NOSONAR|NOPMD|@formatter|noinspection|spotless|SUPPRESS)[^\n]*", r"(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\b"))
_java_type = seq(r"(?!(?:class|interface|enum|record|return|new|throw|else|package|import)\b)[\w.]+", maybe(seq(S, _generic)), many(r"\s*\[\s*\]"), maybe(r"\.\.\."))
_java = seq(
    _JAVA_BETWEEN, maybe(_generic), S,
    choice(seq(capture("returns", _java_type), r"\s+", capture("name", _WORD), S, _params), seq(capture("returns", _java_type), r"(?<=[>\]])\s*", capture("name", _WORD), S, _params), seq(capture("name", _WORD), S, _params)),
    r"(?:\s*\[\s*\])*", maybe(r"\s*throws\s+[\w.,\s]+?(?=\s*[{;])"), r"\s*[{;]",
)

# Go
_go_type = rule("go type")
_go_type.is_ = choice(seq(r"\(", _inside, r"\)"), seq(r"(?:\[[^\]]*\]|\*|<-\s*chan\s+|chan\s+|map\[[^\]]*\])+", _go_type), seq(r"(?:interface|struct)\s*\{", _inside, r"\}"), seq(r"func\s*\(", _inside, r"\)", maybe(seq(r"[ \t]+", _go_type))), seq(r"[\w.]+", maybe(seq(r"\[", _inside, r"\]"))))
_go = seq(r"func[ \t]*", maybe(seq(r"\(", _inside, r"\)[ \t]*")), capture("name", _WORD), maybe(seq(r"\[", _inside, r"\]")), r"[ \t]*", _params, r"[ \t]*", maybe(capture("returns", _go_type)))

# Python
_PY_STRING = r'[rRuU]?(?:"""(?:[^"\\]|\\(?s:.)|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\(?s:.)|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\(?s:.))*"|\'(?:[^\'\\\n]|\\(?s:.))*\')'
_py_inside = rule("python inside")
_py_inside.is_ = many(choice(r"[^()\[\]{}\"'#]++", r"[fFbBrRuU]{0,2}" + _PY_STRING, r"#[^\n]*", seq(r"\(", _py_inside, r"\)"), seq(r"\[", _py_inside, r"\]"), seq(r"\{", _py_inside, r"\}")))
_py_expr = many(choice(r"[^:()\[\]{}\"'#\n]++", _PY_STRING, seq(r"\(", _py_inside, r"\)"), seq(r"\[", _py_inside, r"\]"), seq(r"\{", _py_inside, r"\}")))
_python = seq(
    r"(?:async[ \t]+)?def[ \t]+", capture("name", _WORD), r"[ \t]*", maybe(seq(r"\[", _py_inside, r"\]")), r"[ \t]*\(", capture("parameters", _py_inside), r"\)\s*",
    maybe(seq(r"->\s*", capture("returns", _py_expr))), r":[ \t]*", many(r"(?:#[^\n]*|\\)?\r?\n[ \t]*"), capture("doc", seq(_PY_STRING, many(seq(r"[ \t]+", _PY_STRING)))), r"[ \t\r]*(?=[;#\n]|\Z)",
)

GRAMMARS = {"javascript": _javascript, "typescript": _javascript, "java": _java, "go": _go, "python": _python}

_DEF = re.compile(r"^[ \t]*+(?:async[ \t]+)?def[ \t]", re.M)
_GO_DIRECTIVE = re.compile(r"//(?:go:|line |export |nolint|lint:|[a-z0-9]+:[a-z0-9])")


_REMARK = {"python": re.compile(rf"(?s:{_PY_STRING})|#[^\n]*")} | dict.fromkeys(("javascript", "typescript", "java", "go"), re.compile(rf"{_STRING}|//[^\n]*|/\*(?s:.*?)\*/"))


def _split(params: str, lang: str) -> list[str]:
    """The parts of a parameter list between its outermost commas, without comments."""
    if "#" in params or "/" in params:
        params = _REMARK[lang].sub(lambda m: " " if m.group()[0] in "#/" else m.group(), params)
    if not params.strip():
        return []
    if not re.search(r"[(\[{<\"']", params):
        return [p.strip() for p in params.split(",") if p.strip()]
    out, depth, at = [], 0, 0
    for m in re.finditer(rf"{_STRING}|=>|->|[()\[\]{{}}<>,]", params):
        c = m.group()
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        elif c == "," and not depth:
            out.append(params[at : m.start()])
            at = m.end()
    return [p.strip() for p in [*out, params[at:]] if p.strip()]


def _parameter(part: str, lang: str) -> str:
    if lang == "python":
        return re.match(r"\*{0,2}\s*(\w*)", part).group(1)
    if lang == "java":
        return (re.search(r"(\w+)(?:\s*\[\s*\])*\s*$", part) or [part, part])[1]
    if lang == "go":
        return re.match(r"\w*", part).group()
    part = re.sub(r"^(?:@[\w.]+(?:\([^)]*\))?\s*|(?:public|private|protected|readonly)\s+)*\.{0,3}", "", part)
    if part[:1] in ("{", "["):  # a pattern, without its type and default
        m = re.match(r"(?s)([\[{].*?[\]}])\s*(?::[^=]*)?(?:=.*)?\Z", part)
        return m.group(1) if m else part
    return re.match(r"[\w$]*", part).group()


def pairs(src: str, lang: str, comments: list[tuple[int, int]]) -> list[tuple[str, int, list[str], str | None, str]]:
    """(name, line, parameters, return type, raw documentation) of each documented declaration."""
    out, grammar = [], GRAMMARS[lang]
    run = Run(src)
    line, seen = 1, 0

    def emit(doc: str, end: int) -> None:
        nonlocal line, seen
        start, to = run.found["name"]
        line += src.count("\n", seen, start)
        seen = start
        a, b = run.found.get("parameters", (0, 0))
        returns = run.found.get("returns")
        names = [n for p in _split(src[a:b], lang) if (n := _parameter(p, lang))]
        out.append((src[start:to], line, names, src[slice(*returns)].strip() if returns else None, doc))

    if lang == "python":
        starts = [a for a, _ in comments]
        for m in _DEF.finditer(src):
            at = m.end()
            i = bisect_right(starts, at) - 1
            if i >= 0 and comments[i][1] > at:
                continue  # within a literal
            run.found = {}
            begin = m.start() + len(m.group()) - len(m.group().lstrip())
            end = grammar(run, begin)
            if end >= 0:
                emit(src[slice(*run.found["doc"])], end)
        return out
    if lang == "go":
        starts = [a for a, _ in comments]
        for m in re.finditer(r"^func\b", src, re.M):
            i = bisect_right(starts, m.start()) - 1
            if i >= 0 and comments[i][1] > m.start():
                continue
            top, texts = m.start(), []
            while i >= 0 and comments[i][1] in (top - 1, top - 2) and src[comments[i][1] : top].strip("\r") == "\n" and (comments[i][0] == 0 or src[comments[i][0] - 1] == "\n"):
                top = comments[i][0]
                text = src[top : comments[i][1]]
                if not _GO_DIRECTIVE.match(text):
                    texts.append(text)
                i -= 1
            if not texts:
                continue
            run.found = {}
            if grammar(run, m.start()) >= 0:
                emit("\n".join(reversed(texts)), 0)
        return out
    for start, end in comments:
        if src.startswith("/**", start) and end - start > 4:
            run.found = {}
            if grammar(run, end) >= 0:
                emit(src[start:end], 0)
    return out


# --- what documentation says ------------------------------------------------------------

_TAG = re.compile(r"^[ \t]*(?:[@\\](?:param|arg|argument|property|throws|exception|raises|template|typeparam|return|returns|yields?)\b[ \t]*(?:\{[^}]*\})?[ \t]*-?|:(?:param|type|raises|return|returns|rtype|arg)\b[^:\n]*:|(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Param[eè]tres|Parameter|Argumentos|Аргументы|引数)[ \t]*:?[ \t]*$|-{3,}[ \t]*$)", re.M | re.I)
_MARKS = re.compile(r"^[ \t]*(?:/\*\*?|\*+(?!\*)/?|//+)|\*+/[ \t]*$", re.M)
_PY_PARTS = re.compile(_PY_STRING)
_INLINE = re.compile(r"\{@\w+[^}]*\}|[@\\]\w+|</?\w+[^>]*>")
_WORDS = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n\s*\n|。")
_PARTS = re.compile(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|\d+|[^\W\d_a-zA-Z]+")
#: Words with which a text says that it is still to be written.  Fixed values.
_LATER = re.compile(r"^\W*(?:to ?do\b|tbd|tbw|tba|fixme|xxx|wip|fill (?:in|me)|to be (?:done|written|documented|added|determined)|needs? (?:docs?|documentation)|(?:documentation|description|docs?|comments?) (?:is |are )?(?:missing|pending|to follow|follows|goes? here|here|coming|needed|required|later)|missing (?:docs?|documentation|description|comments?)|not (?:yet )?(?:documented|described)|placeholder\b|(?:undocumented|no (?:docs?|documentation|description))\b|coming soon|write (?:me|this|docs?)|document (?:this|me)|add (?:docs?|documentation|description)|noch zu|zu erledigen|(?:beschreibung|dokumentation|kommentar) (?:folgt|fehlt)|(?:description|documentation) (?:manquante|à venir|absente)|(?:descripci[oó]n|documentaci[oó]n) (?:pendiente|faltante)|falta (?:la )?(?:descripci|documentaci)|описание|нет описания|à (?:faire|documenter|compléter|venir)|pendiente|por (?:hacer|documentar)|сделать|дописать|будет|описание позже|未記入|あとで|後で|要記入|未定)", re.I)
#: Words with which a text only points elsewhere.  Fixed values.
_ELSEWHERE = re.compile(r"^\W*(?:see|cf\b|c\.f\.|refer|compare|same as|as above|ditto|idem|inherit(?:ed|s|doc)?|siehe|vgl|wie oben|voir|v(?:e|é)ase|ver\b|consulte|cfr|смотри|см\b|参照|同上|link|https?:|www\.|documented (?:in|at|elsewhere)|described (?:in|at|elsewhere)|(?:docs?|documentation|details|description|more)\b.{0,30}\b(?:in|at|on|see)\b|copied from|overrides?\b|implements?\b|issue|ticket|pr)\b", re.I)
#: Words that add nothing to a name.  Fixed values.
_FILLER = frozenset(
    "this the a an is of for to and or in on with that it method function func procedure constructor getter setter helper fn def class member callback handler "
    "returns return does do performs perform executes execute runs run calls call implements implement name named called params param parameters parameter args arg arguments argument "
    "die der das diese dieser methode funktion la le les cette méthode fonction el los esta este método función función функция метод эта этот self cls".split()
)


def _plain(doc: str, lang: str) -> str:
    if lang == "python":
        return "".join(part[3:-3] if part[:3] in ('"""', "'''") else part[1:-1] for part in (m.lstrip("rRuU") for m in _PY_PARTS.findall(doc)))
    return _MARKS.sub("", doc)


def informative(doc: str, lang: str, name: str, params: list[str]) -> bool:
    """Whether documentation describes its function.

    It does not if nothing is left without: marks, tags, the names of the parameters, sentences
    that say it is still to be written or point elsewhere, and the function's own name, alone
    or among words that add nothing to a name."""
    text = _TAG.sub(" ", _plain(doc, lang))
    own = {p.lower() for p in _PARTS.findall(name)}
    given = {p.lower() for q in params for p in [q, *_PARTS.findall(q)]}
    for sentence in _SENTENCE.split(text):
        words = _WORDS.findall(_INLINE.sub(" ", sentence))
        if not words or _LATER.match(sentence):
            continue
        if len(words) <= 8 and _ELSEWHERE.match(sentence):
            continue
        rest = {p.lower() for w in words for p in _PARTS.findall(w)} - own - given - _FILLER
        flat = {w.lower() for w in words}
        rest = {r for r in rest if not r.isdigit()} if flat & given or own & {p.lower() for w in words for p in _PARTS.findall(w)} else rest
        if any(not r.isdigit() for r in rest):
            return True
    return False


# --- the operator -----------------------------------------------------------------------


def extract(path: str | None, content: str | None) -> list[tuple[str, int, list[str], str | None, str]]:
    """The described functions of one file; none for a file that is not valid in its language."""
    lang = EXTENSIONS.get((path or "").rsplit(".", 1)[-1].lower())
    if lang is None or not content or not content.strip():
        return []
    comments: list[tuple[int, int]] = []
    skeleton, errors = scan(content, lang, comments)
    if errors and lang != "python":
        return []
    found = [p for p in pairs(content, lang, comments) if informative(p[4], lang, p[0], p[2])]
    if not found or shape_errors(content, skeleton, errors, lang):
        return []
    return [(n, line, ps, r, _plain(d, lang).strip()) for n, line, ps, r, d in found]


SYMBOL = "array<struct<name: string, start_line: int, parameters: array<string>, return_type: string, docstring: string>>"


def documented_functions(files: DataFrame) -> DataFrame:
    """path, name, start_line, parameters, return_type and docstring of every described function
    in each file's latest row.

    Null, empty and blank contents, unknown extensions and invalid files have none; a null
    path names no file.  Two functions of one name in a file are two rows."""
    chosen = files.select("path", "mtime", F.xxhash64("content").alias("content_hash"), "content")

    def symbols(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            own = [[{"name": n, "start_line": line, "parameters": ps, "return_type": r, "docstring": d} for n, line, ps, r, d in extract(p, c)] for p, c in zip(b["path"], b["content"])]
            yield b.drop(columns="content").assign(symbols=pd.Series(own, dtype=object, index=b.index))

    made = chosen.mapInPandas(symbols, f"path string, mtime timestamp_ntz, content_hash bigint, symbols {SYMBOL}")
    return latest(made, ["symbols"]).select("path", F.explode("symbols").alias("s")).select("path", "s.*")
