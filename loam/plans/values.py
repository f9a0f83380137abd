"""The values that the SQL of the registered queries compares with.

They are written out here apart from the operators' own, so that a wrong pattern on either side
shows as a difference.  Fixed values; ``{W}`` stands for white space, ``{N}`` for any but a line end.
"""

from __future__ import annotations

from loam.functions.text import WS

_N = r"[^\n\r\x{2028}\x{2029}]"


def _of(*patterns: str) -> list[str]:
    return [p.replace("{W}", WS).replace("{N}", _N) for p in patterns]


#: On the lower-cased path.
TEST = _of(r"\.(test|spec|tests)\.[jt]sx?$", r"__tests__/", r"/tests?/", r"/spec/", r"\.stories\.[jt]sx?$", r"test_{N}*\.py$", r"_test\.py$", r"conftest\.py$", r"_test\.go$", r"/(test|tests|spec|specs|__tests__)/{N}*$")
GENERATED = _of(
    r"/dist/", r"/build/", r"/out/", r"/target/", r"/bin/", r"/obj/", r"\.generated\.", r"\.gen\.", r"_generated\.", r"\.min\.[jt]s$", r"\.bundle\.[jt]s$", r"\.map$", r"\.d\.ts$", r"\.pyc$", r"\.pyo$", r"\.class$", r"\.o$",
    r"\.obj$", r"\.exe$", r"\.dll$", r"\.so$", r"\.dylib$", r"/docs?/build/", r"/docs?/_build/",
)
#: On the lower-cased name; ``CONFIG`` on the path as well.
VALUABLE = _of(r"webpack\.config\.[jt]s$", r"rollup\.config\.[jt]s$", r"vite\.config\.[jt]s$", r"next\.config\.[jt]s$", r"nuxt\.config\.[jt]s$", r"tailwind\.config\.[jt]s$", r"gatsby-config\.[jt]s$")
CONFIG = _of(
    r"^package\.json$", r"^package-lock\.json$", r"^yarn\.lock$", r"^pnpm-lock\.yaml$", r"^poetry\.lock$", r"^composer\.lock$", r"^webpack\.config\.[jt]s$", r"^rollup\.config\.[jt]s$", r"^vite\.config\.[jt]s$", r"^babel\.config\.[jt]s$",
    r"^jest\.config\.[jt]s$", r"^\.eslintrc", r"^\.prettierrc", r"^\.editorconfig$", r"^\.gitignore$", r"^\.gitattributes$", r"^\.dockerignore$", r"^\.vscode/", r"^\.idea/", r"\.iml$", r"^\.github/", r"^\.gitlab-ci\.yml$",
    r"^\.travis\.yml$", r"^appveyor\.yml$", r"^azure-pipelines\.yml$", r"^\.env", r"^docker-compose",
)
#: In the content, in order: pattern, reason, least length.
INDICATORS = [
    (_of(p)[0], reason, least) for p, reason, least in (
        (r"^{N}{200,}$", "Very long lines (likely minified)", 0), (r"[a-zA-Z]{50,}", "Very long identifiers (likely obfuscated)", 0), (r"\w{1,2}=function\(\w{1,2}\)", "Minified function patterns", 0),
        (r"This file was generated automatically", "Contains generation marker", 0), (r"DO NOT EDIT", "Contains do-not-edit warning", 0), (r"Auto-generated by {N}+", "Contains auto-generation marker", 0),
        (r"Generated on \d{4}-\d{2}-\d{2}", "Contains generation timestamp", 0), (r"^{W}*[\[\{]", "Starts with JSON/data structure", 10_000),
    )
]
CODE = _of(r"function{W}*\(", r"class{W}+\w+", r"import{W}+", r"export{W}+", r"const{W}+\w+{W}*=", r"let{W}+\w+{W}*=", r"var{W}+\w+{W}*=")

EXTENSIONS = {
    "ts typescript, tsx typescript, js javascript, jsx javascript, mjs javascript, cjs javascript, py python, pyi python, pyw python, java java, c c, cpp cpp, cxx cpp, cc cpp, hpp cpp, hxx cpp, go go, rs rust, cs csharp, php php, rb ruby, swift swift, kt kotlin, kts kotlin": 1.0,
    "sh shell, bash shell, zsh shell, sql sql, yml yaml, yaml yaml, json json, md markdown, markdown markdown, xml xml, html html, htm html, css css, scss scss, sass sass, less less": 1.0,
    "pyx python": 0.9, "h c": 0.8,
}
LANGUAGE_OF = {"." + e.split()[0]: (e.split()[1], sure) for group, sure in EXTENSIONS.items() for e in group.split(", ")}
#: Weights in hundredths of what the first lines hint at.
HINTS = [
    (lang, _of(p)[0], w / 100) for lang, w, p in (
        ("typescript", 20, r"import{W}+{N}*{W}+from{W}+['\"]"), ("typescript", 30, r"export{W}+(default{W}+)?(class|function|const|interface)"), ("typescript", 40, r"interface{W}+\w+"), ("typescript", 30, r"type{W}+\w+{W}*="), ("typescript", 20, r"<\w+{N}*>{N}*</\w+>"),
        ("python", 30, r"^def{W}+\w+{W}*\("), ("python", 40, r"^class{W}+\w+{W}*\(?{W}*\w*{W}*\)?:"), ("python", 20, r"import{W}+\w+"), ("python", 30, r"from{W}+\w+{W}+import"),
        ("java", 40, r"public{W}+(class|interface|enum){W}+\w+"), ("java", 30, r"package{W}+[\w.]+;"), ("java", 20, r"@\w+"), ("cpp", 30, r"#include{W}*<{N}*>"), ("cpp", 40, r"namespace{W}+\w+"), ("cpp", 30, r"class{W}+\w+{W}*\{"),
        ("go", 30, r"package{W}+\w+"), ("go", 30, r"func{W}+\w+{W}*\("), ("go", 20, r"import{W}*\([^)]*\)"), ("rust", 30, r"fn{W}+\w+{W}*\("), ("rust", 30, r"use{W}+\w+(::\w+)*;"), ("rust", 30, r"struct{W}+\w+{W}*\{"),
    )
]
HINTED = ["typescript", "python", "java", "cpp", "go", "rust"]
#: On the lower-cased name or path, then on the path alone.
TYPES = [
    ("test", _of(r"\.(test|spec|tests)\.[jt]sx?$", r"test_{N}*\.py$", r"_test\.py$", r"_test\.go$")),
    ("config", _of(r"^(webpack|rollup|vite|babel|eslint|prettier)\.config\.[jt]s$", r"^(tsconfig|jsconfig)\.json$", r"^package\.json$", r"^pom\.xml$", r"^requirements\.txt$", r"^poetry\.lock$", r"^go\.mod$", r"\.config\.[jt]s$")),
    ("documentation", _of(r"\.(md|markdown|rst|txt)$", r"^readme", r"^changelog", r"^license")), ("data", _of(r"\.(json|yaml|yml|xml|csv|toml)$")),
]
FOLDERS = [("test", _of("/test/", "/__tests__/", "/tests/", "/spec/")), ("config", _of("/config/", "/configs/", r"/\.config/")), ("documentation", _of("/docs/", "/doc/", "/documentation/"))]

IGNORED_DIRECTORIES = "node_modules .git .svn .hg dist build out target bin obj __pycache__ .pytest_cache .mypy_cache .tox venv env .env .next .nuxt coverage .nyc_output logs tmp temp .DS_Store Thumbs.db".split()
IGNORED_FILES = ".gitignore .dockerignore .eslintignore .prettierignore package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock Pipfile.lock poetry.lock".split()
SCRIPT_EXTENSIONS = ".ts .tsx .js .jsx .mjs .cjs .py .pyx .pyi".split()

#: How lines begin that declare something, in order; the name is the group.
DECLARATIONS = [
    (_of(p)[0], kind) for p, kind in (
        (r"^(?:export{W}+)?(?:default{W}+)?(?:abstract{W}+)?class{W}+(\w+)", "class"), (r"^(?:export{W}+)?interface{W}+(\w+)", "interface"), (r"^(?:export{W}+)?(?:default{W}+)?(?:async{W}+)?function{W}+(\w+)", "function"),
        (r"^(?:async{W}+)?def{W}+(\w+)", "function"), (r"^func{W}+(?:\([^)]*\){W}*)?(\w+)", "function"), (r"^(?:export{W}+)?type{W}+(\w+){W}*[=\w]", "type"), (r"^(?:export{W}+)?enum{W}+(\w+)", "enum"), (r"^export{W}+(?:const|let|var){W}+(\w+)", "variable"),
    )
]
