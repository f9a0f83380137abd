"""Lexers with a pushdown stack for Python, JavaScript, TypeScript, Java and Go.

``scan(source, lang)`` walks a file once.  It pushes opening delimiters (and template
literals) on a stack, pops them at their counterparts and reports what a lexer can see:

* literals and comments that never end,
* delimiters without a partner, or closed by the wrong one,
* an end of file within open delimiters,
* merge-conflict marker lines outside of literals and comments.

Beside the errors it returns the *skeleton*: the source with comments blanked and the
insides of literals removed, line structure kept.  The grammar checks of ``syntax.py``
and the parsers of ``docpairs.py`` read only the skeleton.

All regular expressions start with a literal character in each alternative, so that the
regex engine skips unremarkable text without a Python-level step.
"""

from __future__ import annotations

import re

OPEN = {"(": ")", "[": "]", "{": "}"}
CLOSE = frozenset(")]}")

EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "java": "java", "go": "go"}

_BRACKETS = r"\(|\)|\[|\]|\{|\}"
# A marker line: seven equal characters at the start of a line, then a blank or the line's end.
_CONFLICT = r"<{7}(?=[ \r\n]|\Z)|>{7}(?=[ \r\n]|\Z)|={7}(?=[ \r\n]|\Z)|\|{7}(?=[ \r\n]|\Z)"

_DQ, _SQ = r'"(?:[^"\\\n]|\\(?s:.))*"', r"'(?:[^'\\\n]|\\(?s:.))*'"

TOKENS = {
    "javascript": re.compile(rf"//[^\n]*|/\*(?s:.*?)\*/|/|{_DQ}|\"|{_SQ}|'|`|{_BRACKETS}|{_CONFLICT}|#![^\n]*"),
    "java": re.compile(rf"//[^\n]*|/\*(?s:.*?)\*/|/\*|\"\"\"(?:[^\"\\]|\\(?s:.)|\"(?!\"\"))*\"\"\"|{_DQ}|\"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)'|'|`|{_BRACKETS}|{_CONFLICT}"),
    "go": re.compile(rf"//[^\n]*|/\*(?s:.*?)\*/|/\*|{_DQ}|\"|'(?:[^'\\\n]|\\x[0-9a-fA-F]{{2}}|\\[0-7]{{3}}|\\u[0-9a-fA-F]{{4}}|\\U[0-9a-fA-F]{{8}}|\\.)'|'|`[^`]*`|`|{_BRACKETS}|{_CONFLICT}"),
    "python": re.compile(rf'#[^\n]*|"""(?:[^"\\]|\\(?s:.)|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\(?s:.)|\'(?!\'\'))*\'\'\'|"""|\'\'\'|{_DQ}|"|{_SQ}|\'|{_BRACKETS}|{_CONFLICT}'),
}
TOKENS["typescript"] = TOKENS["javascript"]

_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*(?:`|\$\{)")
_REGEX_LITERAL = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_REGEX_AFTER_WORD = frozenset("return typeof case in of delete void instanceof new throw yield await do else default extends".split())
_WORD_END = re.compile(r"[\w$]+\Z")


def _regex_may_start(src: str, at: int) -> bool:
    """Whether a slash at this place begins a regex literal and does not divide."""
    i = at - 1
    while i >= 0 and src[i] in " \t\r\n":
        i -= 1
    if i < 0:
        return True
    c = src[i]
    if c in ")]}":
        return c == "}"
    if c.isalnum() or c in "_$\"'`":
        m = _WORD_END.search(src, max(0, i - 20), i + 1)
        return bool(m) and m.group() in _REGEX_AFTER_WORD
    return True


def scan(src: str, lang: str, comments: list[tuple[int, int]] | None = None) -> tuple[str, list[str]]:
    """The skeleton of a source text and its lexical errors, at most one, the first.

    Comments become one blank (their line ends stay), string literals ``""``, template
    literals the same around their ``${}`` parts, regex literals ``0``.  The places of
    all comments are added to ``comments``; in Python, those of its literals as well.
    """
    js = lang in ("javascript", "typescript")
    out: list[str] = []
    stack: list[str] = []
    errors: list[str] = []
    at, pos, find = 0, 0, TOKENS[lang].search
    push, pop = stack.append, stack.pop
    while True:
        m = find(src, pos)
        if m is None:
            break
        start, pos = m.span()
        c = src[start]
        if c in OPEN:
            push(c)
            continue
        if c in CLOSE:
            if not stack:
                errors.append(f"unmatched '{c}'")
                break
            top = pop()
            if top == "`":  # back in the text of a template
                if c != "}":
                    errors.append(f"'{c}' closes a template part")
                    break
                t = _TEMPLATE_TEXT.match(src, pos)
                if t is None:
                    errors.append("unterminated template literal")
                    break
                out.append(src[at:pos])
                at = pos = t.end()
                if src[pos - 1] == "{":
                    push("`")
                    out.append('""{')
                else:
                    out.append('"")')
                continue
            if OPEN[top] != c:
                errors.append(f"'{c}' closes '{top}'")
                break
            continue
        n = pos - start
        if c in "<>=|":
            if start == 0 or src[start - 1] == "\n":
                errors.append("merge conflict marker")
                break
            pos = start + 1
            continue
        if c == "/" or c == "#":
            if n == 1:
                if js and _regex_may_start(src, start) and (r := _REGEX_LITERAL.match(src, start)):
                    out.append(src[at:start])
                    out.append("0")
                    at = pos = r.end()
                continue
            two = src[start + 1]
            if c == "/" and two == "*":
                if n < 4 or src[pos - 1] != "/":
                    errors.append("unterminated comment")
                    break
                out.append(src[at:start])
                out.append(" " + "\n" * src.count("\n", start, pos))
            elif c == "#" and js:
                if start:
                    pos = start + 1
                    continue
                out.append(" ")
            else:
                out.append(src[at:start])
            if comments is not None:
                comments.append((start, pos))
            at = pos
            continue
        # literals
        if c == "`" and js:
            t = _TEMPLATE_TEXT.match(src, pos)
            if t is None:
                errors.append("unterminated template literal")
                break
            out.append(src[at:start])
            at = pos = t.end()
            if src[pos - 1] == "{":
                push("`")
                out.append('(""{')
            else:
                out.append('""')
            continue
        if n == 1 or lang == "python" and n == 3 and src[start:pos] in ('"""', "'''"):
            errors.append("unterminated literal")
            break
        out.append(src[at:start])
        out.append('""')
        if lang == "python" and comments is not None:
            comments.append((start, pos))
        if n > 6 and "\n" in m.group():
            out.append("\n" * src.count("\n", start, pos))
        at = pos
    if not errors and stack:
        errors.append(f"end of file within '{stack[-1]}'")
    out.append(src[at:])
    return "".join(out), errors
