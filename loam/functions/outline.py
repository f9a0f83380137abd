"""Outlines of source texts: the declarations of a file with their extents, as plain Python.

``outline(text, language)`` gives a list of nodes in the order of their starts.  JavaScript and
TypeScript are read on a mask of the text, in which comments and literals are blank and every
character keeps its place, by matching brackets; Python by its syntax tree.  A node is a tuple
in the order of ``FIELDS``; places are characters from 0, lines from 1.
"""

from __future__ import annotations

import ast
import re
import warnings

FIELDS = ("kind", "name", "start", "end", "start_line", "end_line", "start_column", "end_column", "exported", "ancestors", "parameters", "decorators", "value")
LANGUAGES = ("typescript", "javascript", "python")

# --- JavaScript and TypeScript ----------------------------------------------------------

_TOKEN = re.compile(r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|\"(?:[^\"\\\n]|\\(?s:.))*\"?|'(?:[^'\\\n]|\\(?s:.))*'?|[`/{}]")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*+(`|\$\{|\Z)")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_VALUE_ENDS = re.compile(r"(?:[\w$)\]\"'`]|\+\+|--)\s*\Z")
_BEFORE_REGEX = re.compile(r"\b(?:return|typeof|case|in|of|do|else|yield|await|void|delete|throw)\s*\Z")
_VISIBLE = re.compile(r"[^\s]")


def mask(text: str) -> str:
    """The text with blanks for comments and for the insides of literals; line ends stay."""
    out, at, pos, open_ = [], 0, 0, []  # open_: for each open brace whether a template goes on after it

    def blank(a: int, b: int, keep: int = 0) -> None:
        nonlocal at
        out.append(text[at : a + keep])
        out.append(_VISIBLE.sub(" ", text[a + keep : b - keep]))
        out.append(text[b - keep : b])
        at = b

    def template(a: int) -> int:  # from its opening mark, or from the brace that ends a part
        m = _TEMPLATE.match(text, a + 1)
        end = m.end()
        if m.group(1) == "${":
            open_.append(True)
        blank(a, end, 1 if end > a + 1 else 0)
        return end

    while m := _TOKEN.search(text, pos):
        a, pos = m.span()
        c = text[a]
        if c == "{":
            open_.append(False)
        elif c == "}":
            if open_ and open_.pop():
                pos = template(a)
        elif c == "`":
            pos = template(a)
        elif c in "\"'":
            blank(a, pos, 1 if pos - a > 1 else 0)
        elif pos - a > 1:
            blank(a, pos)
        else:  # a slash: a regular expression where no value ends
            before = text[max(0, a - 40) : a]
            if (not _VALUE_ENDS.search(before) or _BEFORE_REGEX.search(before)) and (r := _REGEX.match(text, a)):
                blank(a, r.end(), 1)
                pos = r.end()
    out.append(text[at:])
    return "".join(out)


_BRACKET = re.compile(r"[()\[\]{}]")
_DECLARATION = re.compile(
    r"(?<![\w$.#])(?:(export)\s+)?(?:default\s+)?(?:declare\s+)?((?:abstract\s+)?class|interface|(?:const\s+)?enum|namespace|module|type|(?:async\s+)?function(?:\s*\*)?|const|let|var)\b\s*([A-Za-z_$][\w$]*)?"
)
_MEMBER = re.compile(r"(?<![\w$.])(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set|accessor)\s+)*+(?:\*\s*)?(?!(?:if|for|while|switch|catch|return|with|function|super|new|throw|typeof|await|do|else|case)\b)(#?[A-Za-z_$][\w$]*)\s*\??\s*(?=[(<])")
_NOT_A_STATEMENT = re.compile(r"(?:[=(,\[?&|+*<.:-]|(?<![\w$])(?:return|new|typeof|extends|implements|case|in|of|throw|await|yield|as|satisfies))\s*\Z")
_CONTROL = re.compile(r"(?<![\w$])(?:if|for|while|switch|catch|with|await)\s*\Z")
_RETURNS = re.compile(r"\)\s*:\s*[^;{}=()]*\Z")
_KINDS = {"class": "class", "interface": "interface", "enum": "enum", "namespace": "namespace", "module": "namespace", "type": "type", "function": "function"}
_GOES_ON = frozenset("=+-*/%&|^?:,.<")  # a statement doesn't end after or before these
_TYPE_HEAD, _PARAMETER_HEAD = re.compile(r"\s*[=<]"), re.compile(r"\s*(?:<[^(]*>)?\s*\Z")
_CALL = re.compile(r"(?:await\s+)?[\w$.]+(?:\s*<[^;={}]*>)?\s*\(")
_ARROW = re.compile(r"(?:async\s*)?(?:\(|[\w$]+\s*=>|<)")


def _brackets(s: str) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """The partner of every opening bracket, and (start, end) of the blocks, outer ones first."""
    close: dict[int, int] = {}
    stack = []
    for m in _BRACKET.finditer(s):
        if m.group() in "([{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    return close, sorted((a, b) for a, b in close.items() if s[a] == "{")


def _makes_function(s: str, brace: int, opener: dict[int, int]) -> bool:
    """Whether a block is the body of a function, method or arrow."""
    before = s[max(0, brace - 200) : brace].rstrip()
    if before.endswith("=>"):
        return True
    if not before.endswith(")"):
        m = _RETURNS.search(before)
        if not m:
            return False
        before = before[: m.start() + 1]
    end = brace - len(s[max(0, brace - 200) : brace]) + len(before) - 1
    start = opener.get(end)
    return start is not None and not _CONTROL.search(s[max(0, start - 20) : start])


def _body(s: str, at: int, close: dict[int, int]) -> int | None:
    """The brace that opens the body after a parameter list, or none for a signature."""
    while at < len(s):
        c = s[at]
        if c in "([":
            at = close.get(at, len(s))
        elif c == "{":
            if s[max(0, at - 200) : at].rstrip()[-1:] not in (":", "<", "|", "&", ","):
                return at
            at = close.get(at, len(s))
        elif c in ";}":
            return None
        at += 1
    return None


def _parts(s: str, a: int, b: int, close: dict[int, int]) -> list[tuple[int, int]]:
    """The stretches between the commas of one level."""
    out, start, at, angle = [], a, a, 0
    while at < b:
        c = s[at]
        if c in close and at in close or c in "([{":
            at = close.get(at, b)
        elif c == "<":
            angle += 1
        elif c == ">" and s[at - 1] != "=":
            angle = max(0, angle - 1)
        elif c == "," and not angle:
            out.append((start, at))
            start = at + 1
        at += 1
    return [(x, y) for x, y in [*out, (start, b)] if s[x:y].strip()]


def _parameters(text: str, s: str, a: int, b: int, close: dict[int, int]) -> list[str]:
    out = []
    for x, y in _parts(s, a, b, close):
        m = re.match(r"\s*(?:@[\w.]+\s*|(?:public|private|protected|readonly|override)\s+)*(?:\.\.\.)?\s*([\w$]+)", s[x:y])
        out.append(m.group(1) if m else " ".join(text[x:y].split()))
    return out


def _statement_end(s: str, at: int, close: dict[int, int]) -> int:
    """The end of a statement: after its semicolon, else where a line ends that can't go on."""
    n, last = len(s), at
    while at < n:
        c = s[at]
        if c in "([{":
            at = close.get(at, n)
            last = at + 1
        elif c == ";":
            return at + 1
        elif c in ")]}":
            return last
        elif c == "\n":
            following = _VISIBLE.search(s, at)
            if s[last - 1 : last] not in _GOES_ON and (not following or following.group() not in _GOES_ON):
                return last
        elif not c.isspace():
            last = at + 1
        at += 1
    return last


def _value(s: str, at: int, end: int, close: dict[int, int]) -> str:
    """What kind of value begins there."""
    while at < end and s[at].isspace():
        at += 1
    head = s[at:end]
    if head.startswith("["):
        return "array"
    if head.startswith("{"):
        return "object"
    if re.match(r"new\b", head):
        return "new"
    if re.match(r"(?:async\s+)?function\b", head):
        return "function"
    if _ARROW.match(head) and "=>" in head:
        first = head.find("(")
        if first < 0 or head.find("=>") < first or re.match(r"\s*(?::[^=]*)?=>", s[close.get(at + first, end - 1) + 1 : end]):
            return "arrow"
    return "call" if _CALL.match(head) else "other"


def _script(text: str) -> list[tuple]:
    s = mask(text)
    close, blocks = _brackets(s)
    opener = {b: a for a, b in close.items()}
    found: list[dict] = []
    for m in _DECLARATION.finditer(s):
        word, name = m.group(2), m.group(3)
        kind = _KINDS.get(word.split()[-1].rstrip("*") if not word.endswith("*") else "function", "variable")
        if "function" in word:
            kind = "function"
        if not name or _NOT_A_STATEMENT.search(s[max(0, m.start() - 40) : m.start()]):
            continue
        start, at = m.start(2), m.end()
        if kind == "type":
            if not _TYPE_HEAD.match(s, at):
                continue
            found.append({"kind": kind, "name": name, "start": start, "end": _statement_end(s, at, close)})
        elif kind == "function":
            brace = s.find("(", at)
            body = _body(s, close[brace] + 1, close) if brace in close else None
            if body is None or body not in close or not _PARAMETER_HEAD.match(s[at:brace]):
                continue
            found.append({"kind": kind, "name": name, "start": start, "end": close[body] + 1, "body": body, "parameters": _parameters(text, s, brace + 1, close[brace], close)})
        elif kind == "variable":
            end = _statement_end(s, at, close)
            inner = _parts(s, m.start(3), end, close)
            for x, y in inner:
                own = re.match(r"\s*([A-Za-z_$][\w$]*)\s*", s[x:y])
                if own:
                    eq = re.search(r"(?<![=!<>])=(?![=>])", s[x:y])
                    found.append({"kind": "constant" if word == "const" else "variable", "name": own.group(1), "start": start, "end": end, "value": _value(s, x + eq.end(), y, close) if eq else ""})
        else:
            brace = s.find("{", at)
            if brace not in close or ";" in s[at:brace]:
                continue
            found.append({"kind": kind, "name": name, "start": start, "end": close[brace] + 1, "body": brace})
        for f in found[::-1]:
            if f["start"] != start:
                break
            f["exported"] = bool(m.group(1))
    classes = {f["body"]: f for f in found if f["kind"] == "class"}
    for brace in classes:
        stop, at = close[brace], brace + 1
        while at < stop:
            m = _MEMBER.search(s, at, stop)
            nested = s.find("{", at, m.start() if m else stop)
            if nested >= 0 and nested in close:  # a field's value
                at = close[nested] + 1
                continue
            if not m:
                break
            paren = s.find("(", m.end())
            at = m.end()
            if paren not in close or paren > stop or _NOT_A_STATEMENT.search(s[max(brace + 1, m.start() - 40) : m.start()]):
                at = close.get(paren, at) + 1 if paren >= 0 and paren in close and paren < stop else at
                continue
            body = _body(s, close[paren] + 1, close)
            if body is not None and body in close and body < stop:
                found.append({"kind": "method", "name": m.group(1), "start": m.start(), "end": close[body] + 1, "body": body, "parameters": _parameters(text, s, paren + 1, close[paren], close)})
                at = close[body] + 1
            else:
                at = close[paren] + 1
    bodies = {f["body"]: f["kind"] for f in found if "body" in f}
    spans = []  # what encloses: declarations, and the bodies of nameless functions
    for a, b in blocks:
        kind = bodies.get(a) or ("function" if _makes_function(s, a, opener) else None)
        if kind in ("class", "function", "method", "namespace"):
            spans.append((a, b, "function" if kind == "method" else kind))
    whole = sorted(found, key=lambda f: (f["start"], -f["end"]))
    starts = _line_starts(text)
    out, live, shown, k = [], [], [], 0
    for f in whole:
        while k < len(spans) and spans[k][0] < f["start"]:
            live.append(spans[k])
            k += 1
        live = [x for x in live if x[1] >= f["end"] - 1]
        around = [(kind, _line(starts, b) - _line(starts, a) + 1) for a, b, kind in live]
        shown = [end for end in shown if end >= f["end"]]
        exported = f.get("exported", False) or bool(shown)
        if f.get("exported"):
            shown.append(f["end"])
        out.append(_node(starts, f["kind"], f["name"], f["start"], f["end"], exported, around, f.get("parameters", []), [], f.get("value", "")))
    return out


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def _line(starts: list[int], at: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, at)


def _node(starts, kind, name, a, b, exported, around, parameters, decorators, value) -> tuple:
    first, last = _line(starts, a), _line(starts, b)
    return (kind, name, a, b, first, last, a - starts[first - 1], b - starts[last - 1], exported, [{"kind": k, "lines": n} for k, n in around], parameters, decorators, value)


# --- Python -----------------------------------------------------------------------------


def _python(text: str) -> list[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    lines = re.split(r"\r\n|\r|\n", text)
    starts = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]
    plain = text.isascii()

    def place(line: int, column: int) -> int:  # columns are bytes
        return starts[line - 1] + (column if plain or lines[line - 1].isascii() else len(lines[line - 1].encode()[:column].decode(errors="replace")))

    out = []

    def walk(node: ast.AST, around: list[tuple[str, int]]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                in_class = any(k == "class" for k, _ in around)
                a, b = place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset)
                decorators = [ast.unparse(d) for d in child.decorator_list]
                if decorators:
                    top = place(child.decorator_list[0].lineno, child.decorator_list[0].col_offset)
                    out.append(_node(starts, "decorated", child.name, text.rfind("@", 0, top), b, False, around, [], [], ""))
                given = [] if is_class else [p.arg for p in [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs]]
                out.append(_node(starts, "class" if is_class else "method" if in_class else "function", child.name, a, b, False, around, given, decorators, ""))
                walk(child, [*around, ("class" if is_class else "function", child.end_lineno - child.lineno + 1)])
                continue
            if isinstance(child, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(t, ast.Name) and not isinstance(child, ast.AugAssign):
                        a, b = place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset)
                        out.append(_node(starts, "variable", t.id, a, b, False, around, [], [], ""))
            if not isinstance(child, ast.expr):
                walk(child, around)

    walk(tree, [])
    return sorted(out, key=lambda n: (n[2], -n[3]))


def outline(text: str | None, language: str | None) -> list[tuple] | None:
    """The nodes of a source; null for a language without a reader and for a text that it can't read."""
    if text is None or language not in LANGUAGES:
        return None
    try:
        return _python(text) if language == "python" else _script(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
