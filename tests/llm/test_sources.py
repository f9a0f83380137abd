"""Documented functions, provenance, syntax and residue on small cases."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from loam.llm import docpairs, provenance, queries, residue, syntax
from loam.llm.lexers import scan

FILE = "path string, rel_path string, namespace string, language string, mtime timestamp_ntz, content string"


def files(spark, rows):
    made = [(f"/r/{p}", p, "ns", None, None, c) for p, c in rows]
    return spark.createDataFrame(made, FILE).withColumn("symbols", F.lit("clash")).withColumn("w", F.lit(1)).withColumn("parse_errors", F.lit(2))


# --- syntax ---

VALID = [
    ("a.js", "const r = /[{(\\[]\\s*$/.test(x) ? `a${`b${1}`}c` : 'it\\'s';\nfor await (const [k, v] of f()) { g(k / 2 / v); }\n"), ("a.ts", "export async function f(a: Map<string, number>): Promise<{ id: string }> {\n  return a as unknown as any;\n}\n"),
    ("A.java", 'package a.b;\n\n/** x */\n@Timed("a")\npublic final class A {\n  char c = \'{\';\n  String s = """\n    { "id": 5,\n    """;\n  int f() { return 1; }\n}\n'), ("a.go", "package p\n\nimport (\n\t\"fmt\"\n)\n\n// } closes\nfunc F(a []string) error {\n\ts := `{ \"open\": [`\n\tif x := g(s); x != nil {\n\t\treturn x\n\t}\n\treturn nil\n}\n"),
    ("f.ts", "x++; y--; if (a-- > b) { }\ntype A<T = B> = C;\nlet m: Map<string> = new Map();\nconst o = { a: 1 } as const;\n"), ("g.py", "for x in y:\n    pass\nelse:\n    pass\ntry:\n    a = (b +\n      c)\nexcept E:\n    d = [\n  1,\n]\nmatch = a if b else c\nmatch a:\n    case [x, *_] if x:\n        pass\nasync def f(): return await g()\n"),
    ("a.py", "def f(x):\n    return f\"{x!r}:{1:>8}\"\n"), ("b.py", ""), ("b.go", "  \n"), ("a.unknown", "((("), ("c.js", "// <<<<<<< ours\nconst s = \"=======\";\n/*\n>>>>>>> theirs\n*/\n"), ("d.js", "class A { static async m({ a, b } = {}) { return { a, ...b }; } get x() { return 1 } }\nexport default A\n"),
]
INVALID = [
    ("f.js", "g(1 +);\n"), ("g.js", "let x = = 3;\n"), ("h.js", "const = 4;\n"), ("C.java", "class A { void f() { int x = ; } }\n"), ("c.go", "package a\nfunc f() {\n\tx := }\n"), ("k.cjs", "f(\n"), ("d.py", "x = 1 +\n"), ("e.py", "if a:\nb()\n"), ("f.py", "else:\n    pass\n"), ("g.py", "try:\n    a()\nb()\n"), ("h.py", "for x in y\n    pass\n"), ("i.pyi", "def f() -> :\n    pass\n"),
    ("a.js", "function f() {\n"), ("b.js", "const s = 'open;\n"), ("c.js", "<<<<<<< ours\nf();\n=======\ng();\n>>>>>>> theirs\n"), ("d.js", "export function f(a: string): number {\n  return 1;\n}\n"), ("e.js", "interface A {\n  b: string;\n}\n"), ("a.ts", "package main\n\nfunc F() int {\n\treturn 1\n}\n"),
    ("b.ts", "# Title\n\nThis is a text about things.\n"), ("c.ts", "f(]);\n"), ("A.java", "func F() int {\n\treturn 1\n}\n"), ("B.java", "class A {\n  /* open\n}\n"), ("a.go", "func F() {}\n"), ("b.go", "package p\n\npublic class A {\n}\n"), ("a.py", "def f(:\n"), ("b.py", "function f() {}\n"), ("c.py", "def f():\n    x = 1\n   y = 2\n"), ("e.ts", "const t = `open ${x;\n"),
]


@pytest.mark.parametrize("path, text", VALID)
def test_valid(path, text):
    assert syntax.parse_errors(path, text) == []
    assert syntax.parse_errors(path, text.replace("\n", "\r\n")) == []


@pytest.mark.parametrize("path, text", INVALID)
def test_invalid(path, text):
    assert syntax.parse_errors(path, text)


def test_skeleton_keeps_lines():
    for path, text in VALID:
        lang = {"js": "javascript", "ts": "typescript", "java": "java", "go": "go", "py": "python"}.get(path.rsplit(".", 1)[1])
        if lang:
            assert scan(text, lang)[0].count("\n") == text.count("\n")


def test_check_table(spark):
    frame = files(spark, [("a.js", "f("), ("a.js", "f("), ("b.js", None), ("c.js", "")])
    older = frame.limit(1).withColumn("path", F.lit("/r/d.js")).withColumn("rel_path", F.lit("d.js"))
    both = frame.unionByName(older.withColumn("mtime", F.lit("2025-01-01").cast("timestamp_ntz"))).unionByName(older.withColumns({"mtime": F.lit("2025-01-02").cast("timestamp_ntz"), "content": F.lit("f()")}))
    got = {r["path"]: r["parse_errors"] for r in syntax.check(both).collect()}
    assert got["/r/b.js"] is None and got["/r/c.js"] == [] and got["/r/d.js"] == [] and got["/r/a.js"]
    assert [(r["files"], r["invalid"]) for r in syntax.rates(syntax.check(both)).collect()] == [(3, 1)]
    assert syntax.check(both.limit(0)).count() == 0


def test_the_compiler_is_asked_only_about_what_the_stack_reports(monkeypatch):
    monkeypatch.setattr(syntax, "confirmed", lambda *a: ["asked"])
    assert [syntax.parse_errors(p, t) for p, t in VALID if p.endswith(".py")] == [[]] * sum(p.endswith(".py") for p, _ in VALID)
    assert all(syntax.parse_errors(p, t) == ["asked"] for p, t in INVALID if p.endswith(".py"))


# --- documented functions ---

def test_comments_among_parameters():
    assert docpairs._split('a, b=")", # note (x\n c=1', "python") == ["a", 'b=")"', "c=1"]
    assert docpairs._split("a, // first (one\n b /* { */, c", "javascript") == ["a", "b", "c"]


DOCUMENTED = [
    ("a.py", '@dec\nasync def load_index(path: str, *, limit=3) -> list[str]:\n    """Reads the index from disk."""\n\ndef bare(): pass\n', [("load_index", 2, ["path", "limit"], "list[str]")]),
    ("a.js", "/**\n * Sorts rows by age.\n * @param rows\n */\nexport const sortRows = async (rows, { by = 1 } = {}) => {\n};\nclass A {\n  /** Opens the gate. */\n  // eslint-disable-next-line\n  static open(a) { }\n}\n", [("sortRows", 5, ["rows", "{ by = 1 }"], None), ("open", 10, ["a"], None)]),
    ("a.ts", "/** Finds a user by name. */\nprivate function find(a: Map<string, number>, b?: string): Promise<{ id: string }> {\n}\n", []),
    ("b.ts", "/** Finds a user by name. */\nexport function find<T>(a: Map<string, number>, b?: string): Promise<{ id: string }> {\n}\n", [("find", 2, ["a", "b"], "Promise<{ id: string }>")]),
    ("A.java", 'class A {\n  /** Counts the open files. */\n  @Timed("x")\n  public static Map<String, Integer> count(List<String> a, byte[] b) throws E {\n    return null;\n  }\n}\n', [("count", 4, ["a", "b"], "Map<String, Integer>")]),
    ("a.go", "package p\n\n// Sum adds the numbers up.\n//go:noinline\nfunc (s *Store) Sum(a, b int, c []string) (int, error) {\n\treturn 0, nil\n}\n\n// Not a comment of it.\n\nfunc Other() {}\n", [("Sum", 5, ["a", "b", "c"], "(int, error)")]),
    ("c.py", 'def f():\n    text = """\ndef g():\n    \'\'\'Looks like a function.\'\'\'\n"""\n', []), ("d.py", 'def f(\n    """Says something here."""\n', []),
]


@pytest.mark.parametrize("path, text, want", DOCUMENTED)
def test_extract(path, text, want):
    assert [x[:4] for x in docpairs.extract(path, text)] == want


@pytest.mark.parametrize("doc", ["", "...", "TODO: document this", "TBD", "see above", "cf. issue 12", "{@inheritDoc}", "@param a\n@returns", "load_index", "Load the index.", "This method: loadIndex.", "Beschreibung folgt", "à documenter", "Loads index for the a."])
def test_says_nothing(doc):
    assert not docpairs.informative(f'"""{doc}"""', "python", "load_index", ["a", "b"]) or doc.startswith("Loads")


@pytest.mark.parametrize("doc", ["Reads the index from disk.", "断片は書き直されます。", "Пустой раздел пропускается.", "TODO later. Reads the whole index from disk.", "See the cache first, then read every block of the remaining file from disk."])
def test_says_something(doc):
    assert docpairs.informative(f'"""{doc}"""', "python", "load_index", ["a", "b"])


def test_documented_table(spark):
    frame = files(spark, [(p, t) for p, t, _ in DOCUMENTED] + [("n.py", None), ("e.py", ""), ("a.py", DOCUMENTED[0][1])])
    got = {(r["path"], r["name"], r["start_line"]) for r in docpairs.documented_functions(frame).collect()}
    assert got == {(f"/r/{p}", n, line) for p, _, w in DOCUMENTED for n, line, *_ in w}
    assert docpairs.documented_functions(frame.limit(0)).count() == 0


# --- provenance ---

CODE = "import { x } from './x.js';\n\n" + "".join(f"export function step{i}Of{w}(first, second) {{\n  if (first === {i}) {{\n    return second;\n  }}\n  return first + {i};\n}}\n\n" for i, w in enumerate(["Alpha", "Bravo", "Delta", "Gamma"]))
NUMBERED = "".join(f"export class Node{i:03d}Request {{\n  static tag = {i};\n}}\n" for i in range(1, 15))


def test_provenance(spark):
    own = CODE.replace("Of", "In")
    rows = [
        ("src/a.js", CODE.replace("Of", "At")), ("src/gen.js", NUMBERED), ("src/m.js", "var a=function(b,c){return b>c?b-1:c+2};" * 40), ("src/d.ts", "export const rows = [\n" + "  [1, 2, 3],\n" * 100 + "];\n"), ("lib/copy.js", CODE),
        ("other/copy.js", CODE + "// changed\n"), ("vendor/lib/x.js", own), ("src/banner.js", "const banner = '// DO NOT EDIT';\n" + CODE.replace("Of", "By")), ("src/n.js", None), ("src/e.js", ""), ("src/broken.py", "def f(:\n" + "  some text here\n" * 9),
    ]
    got = {r["path"][3:]: (r["include"], r["label"]) for r in provenance.classify(files(spark, rows)).collect()}
    assert got["src/gen.js"] == (False, "generated") and got["src/m.js"] == (False, "minified") and got["src/d.ts"] == (False, "blob")
    assert got["lib/copy.js"] == (False, "vendored") and got["other/copy.js"] == (False, "vendored") and got["vendor/lib/x.js"] == (False, "vendored")
    assert got["src/n.js"] == (False, None)
    assert all(got[p] == (True, "handwritten") for p in ("src/a.js", "src/banner.js", "src/e.js", "src/broken.py"))
    assert provenance.classify(files(spark, rows).limit(0)).count() == 0


def test_marks_are_found_in_all_comments():
    """After a long licence, at the foot and in a documentation string, but in no other literal."""
    marked = lambda path, text: [b > a for a, b in zip(provenance.evidence(path, CODE if path.endswith("js") else "x = 1\n" * 40)[0], provenance.evidence(path, text)[0])][1:4:2]
    licence = "// one line of a long licence text\n" * 80
    py = "x = 1\n" * 400
    assert marked("a.js", licence + "// Code generated by tool. DO NOT EDIT.\n" + CODE) == [True, False]
    assert marked("a.js", CODE * 4 + "/*\n * This file was automatically generated\n */\n") == [True, False]
    assert marked("a.js", licence + "/* @license alpha@1.2 */\n" + CODE) == [False, True]
    assert marked("a.py", py + "# automatically generated\n") == [True, False] and marked("a.py", '"""Automatically generated."""\n' + py) == [True, False]
    assert marked("a.js", licence + CODE + "const t = `\n// Code generated by tool.\n// @license alpha@1.2\n`;\n") == [False, False]
    assert marked("a.py", py + 't = """\n# automatically generated\n"""\n') == [False, False] and marked("a.py", py + "y = 1  # automatically generated\n") == [False, False]


def test_beliefs_are_exact(spark):
    """On a small tree the two sweeps give what summing over all assignments gives."""
    import itertools
    import math

    named = [("f1", "n:/a"), ("f2", "n:/a"), ("f3", "n:/a/b")]
    weight = {"f1": [0.3, 1.0, 0.0, 0.2, 0.0], "f2": [0.0, 0.4, 0.0, 0.0, 0.1], "f3": [1.5, 0.0, 0.2, 0.9, 0.0]}
    frame = spark.createDataFrame([(p, True, f, *weight[p]) for p, f in named], "path string, known boolean, folder string, e0 double, e1 double, e2 double, e3 double, e4 double")
    folders = ["n:", "n:/a", "n:/a/b"]
    total = {p: [0.0] * 5 for p in weight}
    for ds in itertools.product(range(5), repeat=3):
        base = provenance.DIR_IN[ds[0]][ds[1]] * provenance.DIR_IN[ds[1]][ds[2]] * math.prod(math.exp(1.5) if x == 0 else 1.0 for x in ds)
        for fs in itertools.product(range(5), repeat=3):
            w = base * math.prod(provenance.FILE_IN[ds[folders.index(f)]][k] * math.exp(weight[p][k]) for (p, f), k in zip(named, fs))
            for (p, _), k in zip(named, fs):
                total[p][k] += w
    for r in provenance.beliefs(frame).collect():
        t = total[r["path"]]
        order = sorted(range(5), key=lambda k: -t[k])
        assert r["label"] == provenance.LABELS[order[0]] and math.isclose(r["margin"], math.log(t[order[0]] / t[order[1]]), rel_tol=1e-6)


# --- residue ---

RESIDUE = [
    ("Dear {{ first_name }},\n\nyour index is ready.", "placeholder"), ("Released on __DOCS_LINK__. A long text about the index.", "placeholder"), ("Welcome to undefined, maintained by undefined. Real content.", "placeholder"), ("This page is owned by [your service title].", "placeholder"),
    ("Lorem ipsum dolor sit amet consectetur adipiscing elit. Sed veniam nostrud incididunt labore dolor amet.", "filler"), ("Some words.\n\nSample text goes here. Blah blah blah.", "filler"), ("404 Not Found", "error"), ("Home | Docs\n\nSomething went wrong. Request id abcdef12", "error"),
    ('{"error":"Gone","message":"no such document","status":410}', "error"), ("Seite nicht gefunden\nDie angeforderte Seite gibt es nicht (mehr).", "error"), ("Please enable JavaScript to view this page.", "script"), ("JSを有効にしてください。", "script"), ("Loading...\n\nJS is required to show this content.", "script"),
]
CONTENT = [
    "Our renderer replaces `{{name}}` with the value; an unknown name stays as it is.", "```html\n<p>{{ total }}</p>\n```\n\nThe page shows the total.", 'Users reported "Please enable JavaScript" in the viewer, which came from a stale cache. The cache is now cleared.',
    "The crawler saved 'Page not found' bodies as documents, so it now looks at the status first. That helped a lot with quality.", "[2025-01-01T00:00:00Z] upsert failed: 502 Bad Gateway, retry 1", "> 404 Not Found\n\nThis is what clients saw while the cache was cold. It is fixed now and will not come back.",
    "PUT /v2/posting/{id}/tuple and DELETE /v2/{vault} need a key.", "search <query> --limit <n> [--namespace NAME]", "We filter lorem ipsum before embedding because filler text pulled everything together.", "def f(x=None):\n    return None\n\ndef g():\n    return f'{x}'\n", "", "   \n", None,
]


def test_residue(spark):
    rows = [(i, t, "h") for i, (t, _) in enumerate(RESIDUE)] + [(100 + i, t, None) for i, t in enumerate(CONTENT)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, namespace string").withColumn("reason", F.lit("clash")).withColumn("line", F.lit(1))
    got = {r["doc_id"]: (r["residue"], r["reason"]) for r in residue.examine(frame).collect()}
    assert [got[i] for i in range(len(RESIDUE))] == [(True, k) for _, k in RESIDUE]
    assert [got[100 + i] for i in range(len(CONTENT))] == [(False, None)] * len(CONTENT)
    assert residue.clean(frame).count() == len(CONTENT) and residue.clean(frame).columns == frame.columns
    assert residue.examine(frame.limit(0)).count() == 0


def test_recurrent_lines_are_subtracted(spark):
    menu = "Alpha section of links\nBravo section of links\nDelta section of links\nGamma section of links\nOmega section of links\n" * 3
    rows = [(i, menu + ("Access denied" if i == 0 else f"Page {chr(97 + i)} tells about the {chr(97 + i)} index in words."), "h") for i in range(6)]
    got = [r["doc_id"] for r in residue.examine(spark.createDataFrame(rows, "doc_id bigint, text string, namespace string")).where("residue").collect()]
    assert got == [0]


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_ids", "p9_found", "p8_shares", "p9_clean"])
def test_registered(spark, name):
    columns = {"p2_found": ["path", "name", "start_line"], "p3_found": ["id"], "p4_found": ["id_a", "id_b"], "p5_found": ["path"], "p6_found": ["path"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}
    made = queries.QUERIES[name](spark, DATA)
    assert made.columns == columns.get(name, made.columns) and made.count()


def found(spark, rows):
    return {r["doc_id"] for r in residue.examine(spark.createDataFrame(rows, "doc_id bigint, text string, namespace string")).where("residue").collect()}


def test_lines_are_counted_over_all_hosts(spark):
    """A footer of 21 to 40 characters, once on each of many hosts."""
    footer = "\n".join(f"the {w} footer of all our pages" for w in ("alpha", "bravo", "delta", "gamma", "omega", "sigma", "kappa", "theta", "lambda"))
    rows = [(i, footer + f"\nPage {i}: a {'b' * i} tells about it", f"h{i}") for i in range(30)] + [(99, footer + "\nAccess denied", "h99")]
    assert found(spark, rows) == {99}
    assert found(spark, rows[:10] + rows[-1:]) == set()


def test_whole_sentences_recur(spark):
    """Lines with full stops, longer than 40 characters, of more than one sentence, or with marks within."""
    notice = "We use cookies (and the like) to make this site work; see our policy. You can change that at any time.\nCopyright 2024 Alpha Corporation and its subsidiaries. All rights reserved everywhere.\n\"Read - and write\" is the motto of our good old house = home.\n"
    rows = [(i, notice + f"Page {i}: a {'b' * i} tells about it in words.", "h") for i in range(6)] + [(99, notice.replace("2024", "2025") + "Access denied", "h")]
    assert len(notice) > residue.SHORT and found(spark, rows) == {99}
    assert found(spark, [(99, notice + "Access denied", "h"), (1, "We use cookies (and the like) to make tea. " * 9, "h")]) == set()


PAGES = (
    ["404", "503", "HTTP 502", "Status: 503", "Fehler: 404", "Erreur: 500", "Código 404", "Ошибка 500", "エラー404", "エラー: 503", "Error : 404", "error404", "500 Internal Error", "404 no encontrado", "404 no encontrada", "404 page introuvable", "409 – Conflict", "410 gone away", "Text here.  404\r\nmore", "Conflict\r\nmore", "Gone"]
    + ["Bad Request", "Unauthorized", "Payment required", "Forbidden", "File not found", "Method not allowed", "Request timeout", "Payload too large", "Too many requests", "Internal server error", "Internal error", "Not implemented", "Bad gateway", "Service temporarily unavailable", "Gateway time-out", "Gateway timeout"]
    + ["This page could not be found", "The file does not exist", "Page is unavailable", "Document cannot be displayed", "Access denied", "Access to this page is denied", "Permission denied", "Whoops, no", "Uh-oh", "Uh oh", "Something went wrong", "Something broke", "Application error", "An unknown exception has occurred", "Backend fetch failed", "Fatal error: x", "Traceback (most recent call last)", "Unhandled exception", "This site can’t be reached", "Your session has expired"]
    + ["Zugriff verweigert", "Die Seite wurde nicht gefunden", "Die Seite gibt es nicht", "Die Seite existiert nicht", "Accès interdit", "Page non trouvée", "Le service est indisponible", "Acceso denegado", "Página no encontrada", "El servidor no responde", "Страница не найдена", "Доступ запрещён", "Сервер не отвечает", "Сервер временно недоступен", "ページが見つかりません", "アクセスが拒否", "サーバーエラー"]
    + ['{"status": 503, "message": "upstream timed out"}', '{"code": 500}', '{"error": "denied"}', '{"errors": ["not found"]}', '{"detail": "forbidden"}', '{"statusCode": 404}', "<?xml version='1.0'?><error>x</error>", "<html><title> 404</title></html>", "<h1>Request failed</h1>"]
    + ["enable script", "allow scripting", "JS off", "Node.js is required", "needs js", "without JavaScript", "Java Script is disabled", "activer js", "sans scripts", "включите js", "scriptを有効", "x > 404 Not Found", "> quoted > 404", "<b>Error</b> 404", "bad<br>request", "4\u200b04"]
)
FILLER = (
    [f"{a} {b}" for a in ("sample", "dummy", "placeholder", "filler", "example", "test") for b in ("text", "line", "paragraph", "content", "copy", "sentence")] + [f"{a} {b}" for a in ("text", "content", "copy") for b in ("goes here", "coming soon", "to be added", "to follow", "pending")]
    + [x for b in ("text", "content", "copy") for x in (f"your {b} here", f"insert {b}", f"add {b} here")] + [f"{x} {x} {x}" for x in ("asdf", "jkl", "qwer", "sdfg", "hjkl", "fdsa", "zxcv", "yxcv", "xx")]
    + ["blah blah", "foo bar baz", "write something about it", "contenu à venir", "texte à venir", "texto pendiente", "hier steht ein text", "inhalt folgt", "тут будет текст", "здесь будет текст", "replace me", "replace this", "blindtext", "dies ist blindtext", "texto de relleno", "texto de ejemplo", "texto de prueba", "texte de remplissage", "texte factice", "texte d'exemple", "текст-заполнитель", "рыбатекст", "рыба текст", "ダミーテキスト", "サンプルテキスト"]
    + ["Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur."] + [f"{a} {b} {c} et in ut" for a, b, c in zip(*[iter(sorted(residue._LATIN - residue._ORDINARY_LATIN))] * 3)]
)
MISSING = [f"Dear {x}, hello" for x in ("undefined", "null", "Null", "NULL", "None", "none", "TODO", "Todo", "TBD", "Tbd", "N/A", "n/a", "N/a", "nil", "Nil", "NIL")] + ["costs NaN euros", "costs Nan euros", "costs NAN euros", "[object Object]", "None None"]


def test_every_alternative_of_a_rule_has_a_sign():
    assert [x for x in PAGES if not residue.segments(x)] == [] and [x for x in PAGES if not residue.signs(x)[2]] == []
    assert [x for x in FILLER if not residue.fillers(x)] == [] and [x for x in FILLER if not residue.signs(x)[1]] == []
    assert [x for x in MISSING if not residue.placeholders(x)] == [] and [x for x in MISSING if not residue.signs(x)[0]] == []


def test_texts_about_templates_are_no_cases():
    about = ["In Jinja the tag {% include header %} pulls in another file", "Set ${HOME} before you start the tool", "Write your greeting as Hello {{name}}", "The placeholder {{name}} is replaced when the page is rendered.", "A closing tag such as <% end %> ends the block."]
    assert [x for x in about if residue.parts(x)] == []
    assert residue.parts("Dear {{name}}, welcome. The template tag is explained elsewhere.")[0][2] == "placeholder"


def test_pages_of_further_languages():
    pages = ["We hit a snag while loading this page.", "You have been rate limited.", "Pagina non trovata", "Accesso negato", "Błąd serwera. Spróbuj później.", "Nie znaleziono strony", "Página não encontrada", "Toegang geweigerd"]
    notices = ["Włącz JavaScript, aby korzystać z tej strony.", "Attiva JavaScript per continuare.", "Ative o JavaScript no seu navegador.", "JavaScript is uitgeschakeld"]
    assert [x for x in pages if not any(k == "error" for _, _, k in residue.parts(x))] == []
    assert [x for x in notices if not any(k == "script" for _, _, k in residue.parts(x))] == []


def test_evidence_in_recurring_lines_is_subtracted(spark):
    """A placeholder in a host's navigation isn't the document's; one in its own text is."""
    menu = "Home {{site_name}} Help"
    texts = [(i, f"{menu}\nA page about subject number {chr(97 + i)} and what it is good for.", "n") for i in range(12)] + [(50, menu + "\nDear {{user}}, here is the page.", "n"), (51, menu + "\nSomething else altogether.", "other")]
    assert found(spark, texts) == {50, 51}
