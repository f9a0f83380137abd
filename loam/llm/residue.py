"""Template residue and error-page text.

Normalised lines are counted by host, here the namespace, and what recurs there (navigation,
footers, headings) is subtracted from a document.  It is a leftover if the prose that remains
holds an unfilled placeholder or an empty value in a placeholder's stead, or filler text, or
if what remains is mostly an error message or a notice that scripts are required.

A worker finds in each document the lines that could be evidence and, beside errors and
notices, the other lines; all of them then meet the counts, and only what is left decides.

Program text, code blocks, inline code, quotations, log lines and parameters of paths and
commands are no prose.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.sources.tables import materialize

#: A line recurs on a host if so many documents and so large a share of them have it; or, on
#: all hosts together, so many and so large a share.
HOST_DOCS, HOST_SHARE, ALL_DOCS, ALL_SHARE = 3, 0.05, 20, 0.001
DOMINANT = 0.6  # share of the residual's characters
SHORT = 250  # a residual of so few characters that begins with an error or a notice is one

# --- prose ------------------------------------------------------------------------------

_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n(?s:.*?)(?:^[ \t]*\1[^\n]*$|\Z)", re.M)
_INLINE_CODE = re.compile(r"``[^`\n]+``|`[^`\n]*`")
_QUOTED = re.compile(r"\"[^\"\n]{1,160}\"|“[^”\n]{1,160}”|„[^“\n]{1,160}“|«[^»\n]{1,160}»|(?<![\w])'[^'\n]{1,160}'(?!\w)")
_LOG = re.compile(r"[ \t>]*\[?\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d")
#: Lines of programs and commands.
_CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*(?:[})\]]|(?:import|from|def|class|func|function|const|let|var|return|package|public|private|protected|static|export|async|await|elif|else|try|except|catch|finally|with|raise|throw|case|default|switch|while|struct|interface|type|enum|defer|go|assert|log)\b(?=.*[(){}:;=.<]|\s*$|\s+\w+\s*$))"
    r"|^\s*(?:if|for)\b.*[:{]\s*$|^\s*(?:#!|//|/\*|\*/|\* |@\w+)|^\s*[\w.\[\]]+\s*(?::=|\+=|=)\s*\S|^\s*[\w.]+\([^)]*\)\s*[;{]?\s*$|^\s*\w+: [\w\[\], .|]+(?: = .*)?,\s*$"
)
_PROGRAM = re.compile(r"^(?:import |from \w+ import |def |class |func |package |const |let |var |function |export |public |private |async |@\w+|#!/|\"\"\"|//|/\*)", re.M)

_LINE = re.compile(r"[^\r\n]+")
_NO_BREAK = re.compile(r"[^\r\n]")

# --- placeholders -----------------------------------------------------------------------

#: The forms in which templates mark what is to be filled in.  Fixed values.
_PLACEHOLDER = re.compile(
    r"\{\{\{?\s*[\w.\- ]+\s*\}\}|<%[=\-]?\s*[\w.@ ]+\s*%>|\{%\s*[\w. ]+\s*%\}|\$\{[\w. ]+\}|\$\([a-z]\w*(?:[_. ]\w+)*\)|#\{[\w. ]+\}|\[\[\s*[\w ]+\s*\]\]|<<\s*[\w ]+\s*>>|\(\(\s*[\w ]+\s*\)\)"
    r"|@@\w[\w ]*@@|(?<![\w%])%[A-Z][A-Z_ ]{2,}%|(?<!\w)__[A-Z][A-Z0-9_ ]+?__(?!\w)|(?<!\w)___[A-Za-z][A-Za-z _]*?___(?!\w)|(?<!\w)~[A-Z][A-Z_ ]+~|\bXX[A-Z][A-Z_ ]*?XX\b"
    r"|\[(?:INSERT|ENTER|YOUR|ADD)\b[^\]\n]{1,50}\]|\[[A-Z]{2,}(?:[ _][A-Z]{2,})+\]|<(?:insert|enter|your|add)[ _-][a-z][a-z _-]*>|\[(?:insert|enter|your|add)[ _-][a-z][a-z _-]*\]|\[ [a-z]{2,}(?: [a-z]+)+ \]"
    r"|<!--\s*[a-z]+(?:_[a-z]+)+\s*-->|\?\?\?\s*[a-z][a-z _]*\?\?\?|(?<![/\w$#{}=?&])\{[a-z]+(?:_[a-z]+)+\}(?![/\w])|(?<![\w$])\$[a-z][A-Za-z_]*\$(?!\w)|\bT(?:ODO|BD): ?[a-z]+(?: [a-z]+)?(?=[\s,.:!]|\Z)",
)
_SLOT = r"(?:owned by|reviewed by|, see|questions to|or read|dear|hello|hi|hey|hola|hallo|bonjour|ciao|saludos,|équipe|contact|released on|verantwortlich:|responsable ?:|welcome to|maintained by|index for|index für|owner:|the|before you change the)"
#: What is printed where a value is missing.  Fixed values.
_EMPTY_VALUE = re.compile(
    rf"\[object Object\]|(?<![\w.])NaN(?![\w.])|\bNone None\b|{_SLOT} (?:undefined|null|None|TODO|TBD|N/A|nil)(?=[\s,.:!]|\Z)|\bundefined\b.*\bundefined\b|\bnull\b.*\bnull\b",
    re.I,
)

#: Words of sentences about placeholders.  Fixed values.
_SPEAKS = re.compile(
    r"\b(?:placeholders?|template (?:tags?|engines?|syntax|languages?|variables?)|(?:the|an?|this|each|every|nested|closing|opening) (?:tags?|macros?|directives?|syntax|variables?|expressions?|delimiters?)\b|interpolat\w+|jinja|mustache|handlebars|liquid|twig|freemarker|velocity|thymeleaf"
    r"|(?:environment|shell|template) variables?|(?:set|export|unset|define) (?:\$|%|\{)|write (?:your|the|an?)\b.{0,30}\bas\b|(?:is|are|gets?|will be) (?:replaced|expanded|substituted|escaped|interpolated)|(?:platzhalter|espace réservé|marcador de posición|плейсхолдер|プレースホルダ))",
    re.I,
)

# --- filler -----------------------------------------------------------------------------

_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur".split()
)
_ORDINARY_LATIN = frozenset("do in sit sed ad ex magna et ut ea".split())
#: Stock filler sentences.  Fixed values.
_FILLER = re.compile(
    r"^\W*(?:(?:sample|dummy|placeholder|filler|example|test) (?:text|line|paragraph|content|copy|sentence)\b.{0,40}|(?:blah[\s,]*){2,}|foo bar baz(?: qux)?|(?:x{2,}\s*){3,}|(?:(?:asdf|jkl|qwer|sdfg|hjkl|fdsa|zxcv|yxcv)\w*[\s,;]*){3,}|(?:text|content|copy) (?:goes here|coming soon|to be added|to follow|pending)|your (?:text|content|copy) here|(?:insert|add) (?:copy|text|content)(?: here)?|write something about\b.{0,60}|(?:contenu|texte) à venir|(?:contenido|texto) pendiente|hier steht (?:später |bald )?(?:ein |der )?text\b.{0,20}|(?:inhalt|text) folgt|тут будет текст|здесь будет текст|replace (?:this|me)\b.{0,40}"
    r"|dies ist (?:ein )?blindtext\b.{0,60}|blindtext\b.{0,60}|texto de (?:relleno|ejemplo|prueba)\b.{0,40}|texte (?:de remplissage|d'exemple|factice)\b.{0,40}|текст[- ]заполнитель|рыба[- ]?текст|ダミーテキスト.{0,20}|サンプルテキスト.{0,20})\W*$",
    re.I,
)

# --- error pages and script notices -----------------------------------------------------

_NAMES = r"(?:bad request|unauthorized|payment required|forbidden|(?:page |document |file |resource )?not found|method not allowed|request timeout|conflict|gone|payload too large|too many requests|internal (?:server )?error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
#: How error pages begin.  Fixed values.
_ERROR = re.compile(
    rf"^\W*(?:(?:http )?(?:error|status|fehler|erreur|código|ошибка|エラー)?[ :]*[45]\d\d\b[\s:|\-–—]*(?:{_NAMES}|page introuvable|seite nicht gefunden|no encontrad\w+|$)|{_NAMES}$|(?:http )?(?:error|fehler|erreur|ошибка|エラー)[ :]*[45]\d\d\b.{{0,40}}$"
    r"|(?:sorry, )?(?:this |the )?(?:page|file|document|resource) (?:not found|could not be found|does not exist|is unavailable|cannot be displayed)|access (?:denied|to this (?:page|resource) is denied)|permission denied|(?:oops|whoops|uh[- ]oh)\b.{0,60}$|something (?:went wrong|broke)"
    r"|application error\b.{0,80}|an? (?:unexpected |unknown |internal )?(?:error|exception) (?:has )?occurred|backend fetch failed|fatal error:.{0,80}|traceback \(most recent call last\)|unhandled exception|this site can[’']t be reached|your session has expired"
    r"|zugriff verweigert|seite nicht gefunden|die (?:angeforderte )?seite .{0,20}(?:nicht gefunden|gibt es nicht|existiert nicht)|accès (?:refusé|interdit)|page (?:introuvable|non trouvée)|le service est (?:momentanément |temporairement )?indisponible|acceso denegado|página no encontrada|el servidor no responde"
    r"|we (?:hit a snag|ran into an? (?:problem|error|issue)|encountered an? (?:problem|error|issue))|you have been (?:rate[- ]limited|blocked)|rate limit exceeded|temporarily (?:down|offline)"
    r"|pagina non trovata|accesso negato|errore (?:interno )?del server|servizio non disponibile|(?:nie znaleziono strony|strona nie (?:została znaleziona|istnieje))|(?:dostęp zabroniony|odmowa dostępu)|błąd serwera|página não encontrada|acesso negado|pagina niet gevonden|toegang geweigerd"
    r"|страница не найдена|доступ запрещ[её]н|сервер(?: временно)? (?:не отвечает|недоступен)|ページが見つかりません|アクセスが拒否|サーバーエラー)",
    re.I,
)
_BODY = re.compile(
    r'^\s*(?:\{(?=(?s:.*)"(?:error|errors|detail|status|statuscode|code)")(?=(?s:.*)(?:error|not provided|denied|forbidden|unauthorized|unavailable|not found|[45]\d\d))(?s:.*)\}|<\?xml(?s:.*)<error>(?s:.*)</error>|<!?(?:doctype )?html(?s:.*)<title>\s*[45]\d\d(?s:.*)</html>|<h1>(?:[^<]*(?:error|failed|not found|unavailable|forbidden|denied|gateway)[^<]*)</h1>(?s:.*))\W*$',
    re.I,
)
_JS = r"(?:java ?scripts?|js|scripting|scripts?)"
_NAMES_SCRIPTS = re.compile(r"js|JS|Js|script|Script|SCRIPT")
#: How pages ask for scripts.  Fixed values.
_SCRIPT = re.compile(
    rf"(?:enable|activate|allow|turn on|switch on|permit)\b.{{0,20}}\b{_JS}\b|\b{_JS}\b.{{0,30}}\b(?:is|are|be|seems?|has been)\b.{{0,20}}\b(?:required|needed|disabled|enabled|blocked|off|turned off|switched off|necessary)\b|\b{_JS} (?:disabled|required|needed|off)\b|\b(?:needs?|requires?)\b.{{0,10}}\b{_JS}\b"
    rf"|\b(?:without|not run|not support)\b.{{0,10}}\b{_JS}\b|\b(?:aktivieren|einschalten|erlauben)\b.{{0,20}}\b{_JS}\b|\b{_JS}\b.{{0,20}}\b(?:voraus|aktivieren|deaktiviert|erforderlich|ausgeschaltet)\b|\bsans {_JS}\b|\bactiver\b.{{0,10}}\b{_JS}\b|\b{_JS}\b.{{0,20}}\b(?:désactivé|requis|nécessaire)"
    rf"|\b(?:attiva(?:re)?|abilita(?:re)?|włącz(?:yć)?|wymaga(?:na)?|ativ[ae]r?|habilite|schakel|vereist)\b.{{0,20}}\b{_JS}\b|\b{_JS}\b.{{0,20}}\b(?:disattivat[oa]|disabilitat[oa]|richiesto|necessario|wyłączon[ay]|wymagan[ay]|desativado|necessário|uitgeschakeld|vereist)\b"
    rf"|\b(?:active|habilite|activar|habilitar)\b.{{0,10}}\b{_JS}\b|\bno admite {_JS}\b|\b{_JS}\b.{{0,20}}\b(?:desactivado|necesario)|включите {_JS}|{_JS}\b.{{0,20}}(?:отключ|требуется)|{_JS}を(?:有効|オン)|{_JS}が(?:無効|必要)",
    re.I,
)
#: What stands beside an error message or a notice.  Fixed values.
_BESIDE = re.compile(
    r"^\W*(?:loading\b.{0,10}|just a moment.{0,5}|please wait.{0,20}|checking your browser\b.{0,60}|(?:please |to continue, |you need to |in order to view this page, |you must |it seems that ).{0,90}|we (?:have been told|noticed|are working|could not|are sorry|apologi[sz]e)\b.{0,80}|request id\b.{0,60}|reference\b.{0,60}|ray (?:id)?\b.{0,40}|your (?:request|browser|connection|ip|session)\b.{0,90}"
    r"|this (?:page|resource|app|document|site)\b.{0,90}|sorry\b.{0,80}|go back\b.{0,60}|return (?:to )?home.{0,40}|back to\b.{0,30}|the (?:upstream|requested|address|connection|server|page|resource|document|origin|proxy)\b.{0,80}|slow down\b.{0,60}|contact (?:the |your )?(?:administrator|support|site owner|webmaster)\b.{0,60}|scheduled maintenance\b.{0,40}|the \w+ (?:stays|remains|is) (?:blank|empty)\b.{0,60}|(?:please )?(?:try again|retry|reload|refresh)\b.{0,60}|you (?:lack|do not have|are not|may not|don't have)\b.{0,80}|enable\b.{0,60}"
    r"|bitte\b.{0,80}|die (?:angeforderte|gesuchte) .{0,80}|(?:veuillez|réessayez|retour)\b.{0,60}|(?:inténtelo|vuelva|vuelve|su navegador)\b.{0,60}|(?:попробуйте|вернитесь|пожалуйста)\b.{0,60}|(?:ошибка|fehler|erreur|error) \d{3}\W*|file \"[^\"]+\", line \d+.{0,60}|\w*(?:error|exception): .{0,80}|guru\b.{0,40}|proxy \d+|[0-9a-f]{8,}|© .{0,30}|もう一度.{0,30}|しばらく.{0,30})$",
    re.I,
)
#: Sentences about such pages.  Fixed values.
_ABOUT = re.compile(r"\b(?:only;|reported|crawler|we (?:filter|saw|see|log|treat)|means that|was traced|now looks|instead of|because|when the|whenever|if the|returns? a|responds? with|for the \w+ \w+ only)\b", re.I)
_SENTENCES = re.compile(r"(?<=[.!?。])\s+|[\r\n]+")
#: Without one of these no placeholder or missing value can match.
_MAYBE = re.compile(
    r"\{\{|<%|\{%|\$\{|\$\([a-z]|#\{|\[\[|<<|\(\(|@@\w|%[A-Z]|__[A-Za-z]|~[A-Z]|XX[A-Z]|\[[A-Z][A-Z]|\[insert|\[enter|\[your|\[add|\[ [a-z]|<insert|<enter|<your|<add|<!--|\?\?\?|\{[a-z]+_|\$[a-z]|TODO|TBD"
    r"|undefined|Undefined|UNDEFINED|NaN|nan\b|NAN\b|Nan\b|null\b|Null\b|NULL|None|none\b|NONE|nil\b|Nil\b|NIL\b|N/A|n/a|N/a|todo\b|Todo\b|tbd\b|Tbd\b|\[object|\[Object|\[OBJECT"
)
#: Without one of these no filler sentence can match, without three words of ``_LATIN`` that
#: are not ordinary no Latin one, and without one of the others no error page or notice.
_FILLER_SIGNS = (
    "sample dummy placeholder filler blah xx asdf jkl qwer sdfg hjkl fdsa zxcv yxcv blindtext relleno ejemplo prueba remplissage factice d'exemple заполнитель рыба ダミー サンプル".split()
    + [f"{a} {b}" for a in ("example", "test") for b in ("text", "line", "paragraph", "content", "copy", "sentence")]
    + [f"{a} {b}" for a in ("text", "content", "copy") for b in ("goes here", "coming soon", "to be added", "to follow", "pending")]
    + [f"{a} {b}" for a in ("your", "insert", "add") for b in ("text", "content", "copy")]
    + ["foo bar", "write something", "à venir", "pendiente", "hier steht", "folgt", "будет текст", "replace this", "replace me"]
)
_PAGE_SIGNS = (
    "bad request|unauthorized|payment required|forbidden|not found|not allowed|request timeout|too large|too many requests|server error|internal error|not implemented|bad gateway|unavailable|gateway time|"
    "<error|\"error\"|\"errors\"|\"detail\"|\"status\"|\"statuscode\"|\"code\"|<title>|<h1>|access denied|is denied|permission denied|oops|uh-oh|uh oh|went wrong|something broke|application error|occurred|"
    "fetch failed|fatal error|traceback|unhandled exception|could not be found|does not exist|cannot be displayed|be reached|has expired|verweigert|gibt es nicht|nicht gefunden|existiert nicht|refusé|interdit|introuvable|non trouvée|indisponible|denegado|no encontrad|no responde|не найдена|запрещ|не отвечает|недоступен|hit a snag|ran into a|encountered a|rate-limited|rate limited|been blocked|limit exceeded|temporarily down|temporarily offline|"
    "non trovata|negato|del server|non disponibile|nie znaleziono|nie została znaleziona|nie istnieje|zabroniony|odmowa dostępu|błąd serwera|não encontrada|niet gevonden|geweigerd|見つかりません|拒否|サーバーエラー"
).split("|")
#: A status, after a word for one or at the end of a part; a name that is a common word, at the end of one or after a status.
_STATUS_SIGN = re.compile(r"[45]\d\d(?:(?<=(?:error|rreur).{3})|(?<=(?:error|rreur)[ :].{3})|(?<=(?:fehler|status|código|ошибка).{3})|(?<=(?:fehler|status|código|ошибка)[ :].{3})|(?<=エラー.{3})|(?<=エラー[ :].{3})|(?<=[ :]{2}.{3}))\b|[45]\d\d\b(?=[\s:|\-–—]*(?:[\r\n]|\Z|conflict|gone)|[:|\-–—]*(?:[ \t]{2}|\t|[ \t][|·•>/›»–—-][ \t]))")
_NAME_SIGN = re.compile(r"\b(?:gone|conflict)(?=[^\S\r\n]*(?:[\r\n]|\Z)|[ \t]{2}|\t|[ \t][|·•>/›»–—-][ \t])")
_BODY_LINE = re.compile(r'^\s*(?:\{"|<\?xml|<html|<!doctype)', re.M | re.I)
_MARKUP = re.compile(r"</?[a-z][^>]*>", re.I)
_STOP = re.compile(r"(?<=[.!?。])\s+")
_INVISIBLE = re.compile(r"[\u200b-\u200f\u2060\ufeff\u00ad]")
_SEPARATORS = r"[\r\n]+| {2,}|\t+| [|·•>/›»–—-] "
_SPLIT = re.compile(_SEPARATORS)


def _blank(m: re.Match) -> str:
    return _NO_BREAK.sub(" ", m.group())


def prose(text: str) -> str:
    """The text with blanks in the place of all that is no prose: every character keeps its place."""
    text = _INLINE_CODE.sub(_blank, _FENCE.sub(_blank, text))
    lines = [(m.start(), m.group()) for m in _LINE.finditer(text)]
    if len(_PROGRAM.findall(text)) >= 2 and sum(bool(_CODE_LINE.search(x)) for _, x in lines) >= 0.4 * sum(bool(x.strip()) for _, x in lines):
        return ""
    out, at = [], 0
    for start, x in lines:
        if x.lstrip().startswith(">") or _LOG.match(x) or _CODE_LINE.search(x) and not _PLACEHOLDER.search(x):
            out += [text[at:start], " " * len(x)]
            at = start + len(x)
    return "".join(out) + text[at:]


def placeholders(text: str) -> list[int]:
    """Where prose holds an unfilled placeholder or a missing value printed in its place.

    A sentence that speaks of placeholders, variables or tags holds none."""
    out = []
    for line in _LINE.finditer(text):
        if not _MAYBE.search(line.group()):
            continue
        x = _QUOTED.sub(_blank, line.group())
        for found in (_PLACEHOLDER, _EMPTY_VALUE):
            for m in found.finditer(x):
                if not _SPEAKS.search(x, max(x.rfind(". ", 0, m.start()), 0), (x.find(". ", m.end()) + 1 or len(x) + 1) - 1):
                    out.append(line.start() + m.start())
    return out


def fillers(text: str) -> list[int]:
    """Where sentences of the prose are filler."""
    out = []
    for a, b in _spans(_SENTENCES, _QUOTED.sub(_blank, text), 0, len(text)):
        s = text[a:b]
        if len(s.strip()) < 3:
            continue
        if not _FILLER.match(s):
            words = re.findall(r"[a-z]+", s.lower())
            latin = [w for w in words if w in _LATIN]
            if not (len(latin) >= 5 and len(latin) >= 0.7 * len(words) and len(set(latin) - _ORDINARY_LATIN) >= 3):
                continue
        out.append(a + len(s) - len(s.lstrip()))
    return out


def evidence(text: str, maybe: bool, filler: bool) -> list[tuple[str, int, str]]:
    """(line, characters, kind) of the lines that hold placeholders or filler, as they are counted."""
    text = _INVISIBLE.sub("", text)
    body = prose(text)
    places = [(at, "placeholder") for at in (placeholders(body) if maybe and body else ())] + [(at, "filler") for at in (fillers(body) if filler and body else ())]
    if not places:
        return []
    lines = list(_spans(_SPLIT, text, 0, len(text)))
    ends = [b for _, b in lines]
    held = {(text[slice(*lines[min(bisect_right(ends, at), len(lines) - 1)])], kind) for at, kind in places}
    return [(line, len(line), kind) for line, kind in sorted(held)]


_EDGES = " \t#*|·•>/›»–—-=:.✅🚀"


def _masked(m: re.Match) -> str:
    return "'" + "q" * (len(m.group()) - 2) + "'"


def _spans(pattern: re.Pattern, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The places between a pattern's matches within a stretch of text."""
    for m in pattern.finditer(text, start, end):
        yield start, m.start()
        start = m.end()
    yield start, end


def segments(text: str) -> list[tuple[str, int, str]]:
    """(line, characters, kind) of the parts of a document: error, script, beside or other.

    The line is the whole one that a part stands in, as it is counted but for normalisation; a
    part over more than one, as a code block, is given line by line.  Empty if no part is an
    error or a notice, as such a document can't be one of those."""
    text = _INVISIBLE.sub("", text)
    if _BODY.match(text.strip()):
        return [("body", len(text), "error")]
    out, strong = [], False
    # what is hidden keeps its length, so that places in the hidden text are those in the text
    hidden = _QUOTED.sub(_masked, _FENCE.sub(lambda m: "> " + "q" * (len(m.group()) - 2), text)) if not _BODY_LINE.search(text) else text
    lines = list(_spans(_SPLIT, text, 0, len(text)))
    at = 0
    for a, b in _spans(_SPLIT, hidden, 0, len(hidden)):
        line = hidden[a:b]
        if not line.strip():
            continue
        if _BODY.match(line.strip()):
            out.append(("body", len(line), "error"))
            strong = True
            continue
        quoted = line.lstrip().startswith(">") or bool(_LOG.match(line))
        for x, y in _spans(_STOP, hidden, a, b):
            t = hidden[x:y].strip()
            if not t:
                continue
            kind = "other"
            if not quoted and len(t) <= 200:
                plain = _MARKUP.sub(" ", _INLINE_CODE.sub(" ", t)).strip()
                if _ERROR.match(plain):
                    kind = "error"
                elif len(t) <= 140 and _NAMES_SCRIPTS.search(plain) and _SCRIPT.search(plain):
                    kind = "script"
                elif _BESIDE.match(plain):
                    kind = "beside"
                if kind != "other" and _ABOUT.search(plain):
                    kind = "other"
            strong |= kind in ("error", "script")
            while lines[at][1] <= x and at + 1 < len(lines):
                at += 1
            if kind in ("error", "script") or y <= lines[at][1]:
                out.append((text[slice(*lines[at])], len(t), kind))
                continue
            k = at
            while k < len(lines) and lines[k][0] < y:
                if n := len(text[max(x, lines[k][0]) : min(y, lines[k][1])].strip()):
                    out.append((text[slice(*lines[k])], n, kind))
                k += 1
    return out if strong else []


def signs(text: str) -> tuple[bool, bool, bool]:
    """Whether a text could hold a placeholder, filler, or an error or notice at all: one pass
    over it for the characters and words without which none of the rules above can match."""
    low = text.lower()
    if not low.isascii():
        low = _INVISIBLE.sub("", low)
    filler, page, names, scripts, latin = False, False, False, False, set()
    for end, (kind, word) in _automaton().iter(low):
        if kind == "filler":
            filler = True
        elif kind == "latin":
            latin.add(word)
        elif kind == "name":
            names = True
        elif kind == "script":
            scripts = True
        elif not page:
            page = _told(low, end)
    if not page:
        page = names and bool(_NAME_SIGN.search(low)) or any(_told(low, m.end()) for m in _STATUS_SIGN.finditer(low)) or scripts and _asks_for_scripts(low)
    if not page and ("<" in low or "`" in low):  # the rules see no markup and no inline code
        plain = "\n".join(_MARKUP.sub(" ", _INLINE_CODE.sub(" ", x)).strip() for x in _SPLIT.split(low) if "<" in x or "`" in x)
        page = any(kind == "page" for _, (kind, _) in _automaton().iter(plain)) or bool(_NAME_SIGN.search(plain) or _STATUS_SIGN.search(plain)) or scripts and _asks_for_scripts(plain)
    return bool(_MAYBE.search(text)), filler or len(latin) >= 3, page


def _told(low: str, end: int) -> bool:
    """Whether the part that ends there is no quotation and no log line, which are no pages."""
    start = max(low.rfind("\n", 0, end), low.rfind("\r", 0, end)) + 1
    if not (low[start : start + 8].lstrip().startswith(">") or _LOG.match(low, start)):
        return True
    part = _SPLIT.split(low[start:end])[-1]
    return not (part.lstrip().startswith(">") or _LOG.match(part))


def _asks_for_scripts(low: str) -> bool:
    return any(_SCRIPT.search(x) for x in re.split(r"[\r\n]+", low) if _NAMES_SCRIPTS.search(x))


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    words = ahocorasick.Automaton()
    listed = {"filler": _FILLER_SIGNS, "latin": _LATIN - _ORDINARY_LATIN, "page": _PAGE_SIGNS, "name": ("gone", "conflict"), "script": ("js", "script")}
    for kind, signs_of in listed.items():
        for w in signs_of:
            words.add_word(w, (kind, w))
    words.make_automaton()
    return words


def parts(text: str | None) -> list[tuple[str, int, str]]:
    """(line, characters, kind) of all that may be evidence in a document: placeholder, filler,
    error, script, and beside or other where there are errors or notices to weigh them with."""
    if not text or not text.strip():
        return []
    maybe, filler, page = signs(text)
    return (evidence(text, maybe, filler) if maybe or filler else []) + (segments(text) if page else [])


# --- the operator -----------------------------------------------------------------------


def _normalized(c: Column) -> Column:
    """A line, or the lines of a text, as counted: no invisible marks, lower case, all digits 0."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, _INVISIBLE.pattern, "")), "[1-9]", "0")


def _key(line: Column) -> Column:
    """What tells normalised lines apart: 64 bits of them without blanks and marks at their ends."""
    return F.xxhash64(F.btrim(line, F.lit(_EDGES)))


def recurrent(documents: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which of the ``asked`` lines recur on a host (host, line) and on all hosts together (line).

    Lines are keys; every line of every document is read, and those asked for are counted."""
    nothing = F.xxhash64(F.lit(""))
    lines = F.array_distinct(F.transform(F.split(_normalized(F.col("text")), _SEPARATORS), _key))
    host = F.coalesce("namespace", F.lit(""))
    each = documents.where(F.length("text") > 0).select(host.alias("host"), F.explode(lines).alias("line")).where(F.col("line") != nothing)
    counted = materialize(each.join(asked, "line", "left_semi").groupBy("host", "line").agg(F.count("*").alias("n")))
    sizes = documents.groupBy(host.alias("host")).agg(F.count("*").alias("docs"))
    on_host = counted.where(F.col("n") >= HOST_DOCS).join(sizes, "host").where(F.col("n") >= HOST_SHARE * F.col("docs")).select("host", "line")
    everywhere = counted.groupBy("line").agg(F.sum("n").alias("n")).where(F.col("n") >= ALL_DOCS)
    return on_host, everywhere.where(F.col("n") >= ALL_SHARE * documents.agg(F.count("*")).scalar()).select("line")


def examine(documents: DataFrame) -> DataFrame:
    """doc_id, residue and reason of every document.

    ``reason`` is placeholder, filler, error or script where ``residue`` holds, else null.
    Null, empty and blank texts hold nothing.  Documents without a namespace share a host.
    A line that recurs on its host, or on all hosts, is subtracted before anything is decided;
    an error or a notice that recurs, and filler that recurs on other hosts, is evidence still,
    as a failed page has no other content.
    """
    chosen = documents.select("doc_id", F.coalesce("namespace", F.lit("")).alias("host"), "text")
    kinds = "array<struct<at: int, line: string, size: int, kind: string>>"

    def look(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            found = [[{"at": i, "line": a, "size": n, "kind": k} for i, (a, n, k) in enumerate(parts(x))] for x in b["text"]]
            yield b.drop(columns="text").assign(parts=pd.Series(found, dtype=object, index=b.index))

    looked = chosen.mapInPandas(look, f"doc_id bigint, host string, parts {kinds}")
    each = looked.select("doc_id", "host", F.explode_outer("parts").alias("p")).select("doc_id", "host", "p.*")
    each = materialize(each.withColumn("line", F.when(F.col("kind").isNotNull(), _key(_normalized(F.col("line"))))))
    told, own = F.col("kind").isin("error", "script"), F.col("kind").isin("placeholder", "filler")
    open_ = each.where(F.col("kind").isNotNull() & ~told)
    on_host, everywhere = recurrent(documents, open_.select("line").distinct())
    rest = open_.join(on_host, ["host", "line"], "left_anti")
    rest = rest.where(own).unionByName(rest.where(~own).join(everywhere, "line", "left_anti")).select("doc_id", "at", "size", "kind")
    size = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("size")).otherwise(0))
    left = rest.unionByName(each.where(told).select("doc_id", "at", "size", "kind")).groupBy("doc_id").agg(
        F.min_by("kind", F.when(~own, F.col("at"))).alias("first"), size("error", "script", "beside", "other").alias("all"), size("error", "script", "beside").alias("said"), size("script").alias("script"), size("error").alias("error"),
        F.bool_or(F.col("kind") == "placeholder").alias("placeholder"), F.bool_or(F.col("kind") == "filler").alias("filler"),
    )
    page = (F.col("error") + F.col("script") > 0) & ((F.col("said") >= DOMINANT * F.col("all")) | F.col("first").isin("error", "script") & (F.col("all") <= SHORT))
    reason = F.when(F.col("placeholder"), "placeholder").when(F.col("filler"), "filler").when(page, F.when(F.col("script") > F.col("error"), "script").otherwise("error"))
    judged = left.select("doc_id", reason.alias("reason"))
    return each.select("doc_id").distinct().join(judged, "doc_id", "left").select("doc_id", F.col("reason").isNotNull().alias("residue"), "reason")


def clean(documents: DataFrame) -> DataFrame:
    """The documents, all columns, without those that hold residue."""
    return documents.join(examine(documents).where("residue").select("doc_id"), "doc_id", "left_anti")
