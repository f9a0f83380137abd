"""Golden values worked out by hand, and cases without a row or a value."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.config import Config
from loam.functions import text as X
from loam.operators import chunks, discovery, filters, language, search, store, units, usage
from loam.plans import registry
from loam.sources import files as sources


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


CASCADE = [
    ("src/a.test.ts", "x", False, "Test file", 0.9), ("tests/util.py", "x", True, "Source code file", 0.8), ("src/tests/util.py", "x", False, "Test file", 0.9), ("src/FooTest.java", "x", True, "Source code file", 0.8),
    ("dist/a.ts", "x", True, "Source code file", 0.8), ("pkg/dist/a.ts", "x", False, "Generated file", 0.95), ("types/x.d.ts", "x", False, "Generated file", 0.95), ("vite.config.ts", "x", True, "Valuable configuration file", 0.7),
    ("package.json", "x", False, "Configuration file", 0.85), ("Cargo.lock", "x", True, "Source code file", 0.8), ("a.ts", "x " * 100, False, "Very long lines (likely minified)", 0.8), ("a.ts", "x " * 100 + "\n", True, "Source code file", 0.8),
    ("a.ts", "// DO NOT EDIT", False, "Contains do-not-edit warning", 0.8), ("a.ts", "", True, "Source code file", 0.8), ("a.ts", None, False, "No content", 1.0), ("a.ts", "ab\x00c", False, "Binary content", 1.0),
    ("a.ts", "same line\n" * 30, False, "Contains repeated patterns (likely generated)", 0.75), ("a.py", "# a\n" * 9 + "x", False, "Mostly comments (documentation file)", 0.75),
]


def test_cascade(spark):
    frame = spark.createDataFrame([(i, p, c) for i, (p, c, *_) in enumerate(CASCADE)], "i int, rel_path string, content string")
    found = filters.classify(frame).orderBy("i").collect()
    assert [(r["include"], r["reason"], float(r["confidence"])) for r in found] == [c[2:] for c in CASCADE]


@pytest.mark.parametrize("path, content, want", [("x.h", "", ("c", 0.8)), ("x.foo", "fn main() {}\nuse a::b;", ("rust", 0.6)), ("x.foo", "", ("text", 0.1)), ("x.py", "import os", ("python", 1.0))])
def test_language(spark, path, content, want):
    r = one(spark, language.detect("p", "c"), p=path, c=content)
    assert (r["language"], r["confidence"]) == want


def test_ids(spark):
    assert one(spark, X.chunk_id(F.lit("/src/a.go"), F.lit(1), F.lit("x"))) == "chunk_e76e816239c0ab92"
    assert one(spark, X.short_id(F.lit("/src/app/main.ts"), F.lit("3-9"))) == "main_c1d1efcd_3-9"
    assert one(spark, X.namespace_id(F.lit("/tmp/demo"))) == "mcp_b9375f222b2f27c6"


def test_truncate(spark):
    cut = lambda s: one(spark, X.truncate("s", 10), s=s)
    assert cut("short") == "short"
    assert cut("aaaaaaaaa\nbbb") == "aaaaaaaaa\n"
    assert cut("a\naaaaaaaaaaaa") == "a\naaaaaaaa" + X.TRUNCATED
    assert one(spark, X.truncate("s", 10), s=None) is None


def cut_by_hand(text, limit):
    """The truncation rule over Python's code points."""
    last = max(text.rfind(mark, 0, limit) for mark in "\n}") + 1
    return text if len(text) <= limit else text[:last] if last - 1 > limit * 0.8 else text[:limit] + X.TRUNCATED


def test_truncate_all_documents(spark, tmp_path):
    made = ["short 🙂", "🙂" * 990 + "\n" + "日本語" * 40, "e\u0301" * 495 + "}" + "‘x’ – •\u200b" * 9, "👩\u200d👩\u200d👧" * 300, "カ\u3099" * 400 + "\r\n" + "漢" * 500, "\n" + "字" * 1000, "字" * 1000, "", None]
    spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in registry.QUERIES["truncate_embed_input"](spark, str(tmp_path)).collect()}
    assert got == {i: cut_by_hand(t, 1000) for i, t in enumerate(made) if t is not None}


def test_embed_all_chunks(spark, tmp_path):
    import hashlib
    import math
    import re

    long = [f"word{i % 97} x{i % 89} 日本{i % 7}" + "\n" * (i % 11 == 0) for i in range(3000)]
    made = ["one two two", " ".join(long), "a1 " * 6000 + "}" + "tail " * 900, "b2 " * 9000, "y" * 19_999 + "\n" + "left out", "", None]
    spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(made)], "id string, content string").write.parquet(str(tmp_path / "chunks.parquet"))
    wanted = {}
    for i, t in enumerate(made):
        v = [0.0] * 64
        for term in re.findall(r"\w+", cut_by_hand(t or "", 20_000).lower()):
            h = hashlib.md5(term.encode()).hexdigest()
            v[int(h[:6], 16) % 64] += 1.0 if int(h[6], 16) < 8 else -1.0
        norm = math.sqrt(sum(x * x for x in v))
        wanted |= {(f"c{i}", k): round(x / norm, 6) for k, x in enumerate(v) if x}
    assert sum(len(t or "") > 20_000 for t in made) == 4
    got = {(r["id"], r["dim"]): r["value"] for r in registry.QUERIES["embed_hashed"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(wanted, abs=2e-6)


def test_windows_and_complexity(spark):
    frame = spark.createDataFrame([("a", "\n".join(map(str, range(250)))), ("b", "\n" * 120), ("c", None)], "path string, content string")
    got = [(r["start_line"], r["end_line"]) for r in chunks.windows(frame).orderBy("path", "start_line").collect()]
    assert got == [(1, 100), (101, 200), (201, 250)]
    assert one(spark, chunks.complexity("c"), c="x{\n" * 2 + "\n" * 16) == "low"
    assert one(spark, chunks.complexity("c"), c="x{\n" * 2 + "\n" * 17) == "medium"
    assert one(spark, chunks.complexity("c"), c="x{\n" * 10 + "\n" * 88) == "high"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab {}\n", max_size=40), min_size=1, max_size=4))
def test_windows_partition_lines(spark, texts):
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    got = {}
    for r in chunks.windows(frame, 3, keep_blank=True).orderBy("path", "start_line").collect():
        got.setdefault(r["path"], []).append(r["content"])
    assert [got[str(i)] for i in range(len(texts))] == [["\n".join(t.split("\n")[k : k + 3]) for k in range(0, len(t.split("\n")), 3)] for t in texts]


def test_sections(spark):
    text = "import a\nimport b\n\nfunction f() {\n  x\n}"
    got = [r["content"] for r in chunks.sections(spark.createDataFrame([("i", text)], "id string, content string")).orderBy("section").collect()]
    assert got == ["import a\nimport b", "", "function f() {", "  x", "}"]


def test_merge_units(spark):
    ranges = [("a", 0, 400), ("a", 450, 900), ("b", 0, 400), ("b", 500, 900), ("c", 0, 1000), ("c", 100, 500)]
    frame = spark.createDataFrame([(p, s, e, "class") for p, s, e in ranges], "path string, start_idx int, end_idx int, type string")
    ends = lambda d: [(r["path"], r["start_idx"], r["end_idx"]) for r in d.orderBy("path", "unit").collect()]
    assert ends(chunks.merge_units(frame)) == [("a", 0, 900), ("b", 0, 400), ("b", 500, 900), ("c", 0, 1000)]
    assert ends(chunks.merge_units(frame, compat=True))[-1] == ("c", 0, 500)


def test_pack_keeps_every_section(spark):
    text = "import a from 'x'\n" + "\n".join(f"function f{i}() {{\n  return {'y' * 200};\n}}" for i in range(12))
    parts = chunks.sub_chunks(spark.createDataFrame([("i", text), ("s", "small")], "id string, content string")).collect()
    whole = "\n".join(r["content"] for r in parts)
    assert all(f"function f{i}()" in whole for i in range(12)) and len(parts) > 2
    assert all(r["content"].startswith("import a") for r in parts if r["id"] == "i")


def test_adaptive_windows_reach_the_end(spark):
    text = "\n".join(f"line {i}" + " pad" * 20 for i in range(400))
    got = chunks.adaptive_windows(spark.createDataFrame([("p", text)], "path string, content string"), 3000, 400).orderBy("window").collect()
    assert got[0]["start_line"] == 1 and got[-1]["end_line"] == 400
    assert all(a["end_line"] >= b["start_line"] - 1 for a, b in zip(got, got[1:]))
    assert all(r["end_offset"] - r["start_offset"] <= 3000 for r in got)


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 7, 64, 65, 1000):
        values = [(i * 7) % 11 - 5 for i in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(chunks.running(F.col("v")).alias("s")).first()["s"]
        assert got == [sum(values[: i + 1]) for i in range(n)]


LARGE = "class Big {\n" + "".join(f"  method{i}(a: number) {{\n    return a + {i};\n  }}\n" for i in range(60)) + "}\n"


def test_units(spark):
    rows = [("big", "big.ts", LARGE), ("ns", "ns.ts", "namespace N {\n  export function inside(a: string) { return a; }\n}\n"), ("deco", "d.py", "@wrap\ndef f():\n    def inner_function_here():\n        return 1\n    return inner_function_here\n"), ("blank", "b.ts", " \n"), ("null", "n.ts", None)]
    frame = spark.createDataFrame(rows, "path string, rel_path string, content string")
    made = units.semantic_chunks(frame).orderBy("path", "start_line", F.col("end_line").desc()).collect()
    big = [r for r in made if r["path"] == "big"]
    assert (big[0]["start_line"], big[0]["end_line"], big[0]["chunk_type"]) == (1, 182, "mixed")  # with the methods in its first 1500 characters
    assert len(big) > 1 and all(r["size"] <= 1500 for r in big[1:]) and {r["chunk_type"] for r in big[1:]} == {"mixed"}
    assert [(r["path"], r["chunk_type"]) for r in made if r["path"] != "big"] == [("deco", "mixed"), ("ns", "module")]
    assert all(r["content"] == dict((p, c) for p, _, c in rows)[r["path"]][dict((p, c) for p, _, c in rows)[r["path"]].index(r["content"]) :][: len(r["content"])] for r in made)


SCRIPTS = [
    ("const r = /[{(]/g, s = `a ${`}`} {`;\nfunction f() { return 1 }\n", [("function", "f", 2, 2)]),
    ("/* class No {} */\nconst x = 'class No {}';\nclass Yes { static of<T>(a: T): Yes { return new Yes() } field = { a: 1 }; set v(x) { } }\n", [("class", "Yes", 3, 3), ("method", "of", 3, 3), ("method", "v", 3, 3)]),
    ("type Id = string |\n  number;\nenum C { A }\nexport default async function main({ a }: O): Promise<{ b: string }> {\n}\ndeclare function sig(a: string): void;\n", [("type", "Id", 1, 2), ("enum", "C", 3, 3), ("function", "main", 4, 5)]),
    ("return function notOne() {};\nconst made = call({\n  a: 1,\n});\nclass Open {", []),
]


@pytest.mark.parametrize("text, want", SCRIPTS)
def test_outline(text, want):
    from loam.functions.outline import mask, outline

    assert len(mask(text)) == len(text)
    assert [(n[0], n[1], n[4], n[5]) for n in outline(text, "typescript") if n[0] not in ("constant", "variable")] == want


def test_fusion(spark):
    hits = lambda s: spark.createDataFrame([(0, k, i) for i, k in enumerate(s)], "query_id int, id string, rank int")
    got = [(r["id"], r["raw"], r["score"]) for r in search.fuse(hits("ABCE"), hits("BDE")).orderBy("rank").collect()]
    assert got == [("B", 8.636364, 1.0), ("E", 7.362637, 1.0), ("A", 5.454545, 0.751579), ("C", 4.615385, 0.614413), ("D", 3.333333, 0.425965)]


def test_overlap(spark):
    r = [(0, "f", 1, 100, 0), (0, "f", 20, 90, 1), (0, "f", 80, 120, 2), (0, "f", 5, 5, 3), (0, "g", 20, 90, 4), (1, "h", 20, 90, 0), (1, "h", 1, 100, 1)]
    frame = spark.createDataFrame(r, "query_id int, file_path string, start_line int, end_line int, rank int")
    got = sorted((x["query_id"], x["rank"]) for x in search.without_overlaps(frame).collect())
    assert got == [(0, 0), (0, 2), (0, 3), (0, 4), (1, 0)]


def test_cosine_of_nothing(spark):
    assert one(spark, search.cosine(F.lit([0.0, 0.0]), F.lit([1.0, 2.0]))) is None
    assert [one(spark, search.usable(F.lit(v).cast("array<float>"), 2)) for v in ([1.0, 2.0], [0.0, 0.0], [1.0], [float("nan"), 1.0])] == [True, False, False, False]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, content string, file_path string, start_line int, end_line int, vector array<float>")
    assert search.hybrid(none.drop("vector"), none.select("id", "vector"), [(1, "words", [1.0] * 64)]).count() == 0
    assert chunks.sections(none).count() == 0 and chunks.windows(none, path="file_path").count() == 0
    assert store.statistics(spark.createDataFrame([], "total_chunks bigint, failed boolean, indexed_at timestamp")).first()["chunks"] == 0


def test_limiter(spark):
    hours = [0, 1, 2, 24, 25, 26]
    frame = spark.createDataFrame([(i, "k", h) for i, h in enumerate(hours)], "id int, key string, h int").select("id", "key", F.timestamp_seconds(F.col("h") * 3600).alias("created_at"))
    got = [r["allowed"] for r in usage.fixed_windows(frame, ["key"], 2, 86_400).orderBy("id").collect()]
    assert got == [True, True, False, True, True, False]


def test_streaming_limiter_equals_batch(spark, tmp_path):
    from loam.streaming.events import limited

    frame = spark.createDataFrame([(i, f"k{i % 3}", i * 700) for i in range(60)], "id int, key string, s int").select("id", "key", F.timestamp_seconds("s").alias("created_at"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = limited(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), ["key"], 2, 7200)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r["id"]: r["allowed"] for r in usage.fixed_windows(frame, ["key"], 2, 7200).collect()}
    assert {r["id"]: r["allowed"] for r in spark.table("limited").collect()} == want


def test_streaming_usage(spark, tmp_path):
    from loam.streaming.events import usage_windows

    frame = spark.createDataFrame([(1, "A", 200, 7200), (1, "A", 200, 7200), (2, "A", 500, 7210), (3, "B", 200, 14000), (4, "B", 200, 99_999_999)], "id int, type string, status_code int, s int").select("id", "type", "status_code", F.timestamp_seconds("s").alias("created_at"))
    frame.write.parquet(str(tmp_path / "in"))
    q = usage_windows(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("used").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("used").where("type = 'A'").collect()[0][2:] == (2, 1)


def test_changes(spark):
    frame = lambda r: spark.createDataFrame(r, "path string, content string, mtime timestamp")
    old, new = frame([("a", "1", None), ("b", "2", None), ("c", "3", None)]), frame([("a", "1", None), ("b", "22", None), ("d", "4", None)])
    got = {r["path"]: r["change"] for r in store.changes(new, store.state(old)).collect()}
    assert got == {"b": "modified", "c": "deleted", "d": "added"}
    assert store.changes(new, store.state(new)).count() == 0


def test_upsert_and_latest(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 9)], "id string, v int")
    b = spark.createDataFrame([("y", 3), ("z", 4), ("z", 4)], "id string, v int")
    assert sorted(map(tuple, store.upsert(a, b).collect())) == [("x", 1), ("y", 3), ("z", 4)]
    assert sorted(map(tuple, store.insert_missing(a, b, "id").where("id is not null").collect())) == [("x", 1), ("y", 2), ("z", 4)]


def test_python_symbols(spark):
    text = "X = 1\n\n@dec\ndef f(a, b):\n    pass\n\nclass C:\n    y = 2\n    def m(self): pass\n"
    frame = spark.createDataFrame([("p", "a.py", text), ("q", "b.py", "def ("), ("r", "c.py", None)], "path string, rel_path string, content string")
    got = {(r["name"], r["type"], r["start_line"], r["scope"]) for r in units.symbols(frame, ("python",)).collect()}
    assert got == {("X", "variable", 1, "global"), ("f", "function", 4, "global"), ("C", "class", 7, "global"), ("y", "constant", 8, "local"), ("m", "method", 9, "local")}


def test_discovery(spark):
    paths = ["src/a.ts", "node_modules/a.ts", ".git/a.ts", "a.min.js", "x/.hidden.ts", "deep/" * 21 + "a.ts", "b.gen.ts", "c.txt", "yarn.lock", "d.PY"]
    frame = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    assert sorted(r["rel_path"] for r in discovery.discover(frame).collect()) == ["d.PY", "src/a.ts"]


def test_config():
    c = Config(api_key="abcdefghijkl").override(search={"limit": 3})
    assert c.search.limit == 3 and c.search.vector_weight == 0.6 and c.summary()["api_key"] == "abcd****ijkl"
    assert Config().override(search={"limit": -1}).problems()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "code"
    (root / "src").mkdir(parents=True)
    (root / "src" / "lock.ts").write_text("import { x } from './x';\n\nexport function acquireLock(name: string) {\n  return name + ' stale lock';\n}\n")
    (root / "src" / "parse.py").write_text("def parse_header(text):\n    return text.split(':')\n")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "z.js").write_text("var hidden = 1;\n")
    return root


def test_engine(spark, tree, tmp_path):
    import os

    from loam import worker
    from loam.plans.engine import Engine

    engine = Engine(spark, str(tmp_path / "index"))
    assert engine.describe() == "No codebase is indexed." and not engine.search("anything").success
    assert worker.run(spark, str(tmp_path / "index"), str(tree), "demo") == 0
    said = usage.log_statistics(sources.read_logs(spark, sources.newest_log(spark, f"{tmp_path}/index/logs", "demo"))).first()
    assert said["completed"] and said["chunks"] == 2 and said["started"] < said["ended"] and said["batches"] == 1
    for strategy in ("hybrid", "bm25", "vector"):
        r = engine.search("stale lock", str(tree), limit=1, strategy=strategy, connected=True)
        top = r.results.first()
        assert r.success and top["file_path"].endswith("lock.ts") and top["similarity"] is not None
        assert top["connections"]["imports"] == ["./x"] == top["connections"]["related_files"] and top["connections"]["exports"] == ["acquireLock"]
        assert [s["name"] for s in top["symbols"]] == ["acquireLock"] and top["complexity"] == "low"
    assert not engine.search("  ", str(tree)).success and not engine.search("x", "/nowhere").success
    assert engine.search("parse header", str(tree), where=F.col("language") == "typescript").results.where("file_path like '%.py'").count() == 0
    assert engine.search("parse header", file_types=["py"]).results.count() == 1  # the first codebase
    assert engine.search("parse lock", str(tree), attributes=["file_path"]).results.columns == ["id", "score", "file_path", "rank"]
    assert engine.search_symbols(["parse_header"], str(tree)).results.first()["file_path"].endswith("parse.py")
    both = [r["id"] for r in engine.search("parse lock header stale", str(tree), rerank=False).results.collect()]
    assert [r["id"] for r in engine.search("parse lock header stale", str(tree), rerank=False, offset=1).results.collect()] == both[1:]
    # a refresh writes only what changed
    assert engine.refresh(str(tree)) == {}
    old = (tree / "src" / "lock.ts").read_text()
    (tree / "src" / "lock.ts").write_text(old.replace("stale", "fresh"))
    (tree / "src" / "parse.py").unlink()
    (tree / "src" / "new.go").write_text("package p\n\nfunc Fetch() int {\n\treturn 1\n}\n")
    assert engine.refresh(str(tree)) == {"added": 1, "deleted": 1, "modified": 1}
    entry = engine._entry(str(tree))
    batch = spark.read.parquet(f"{tmp_path}/index/chunks/namespace={entry['namespace']}/batch={entry['version']}")
    assert sorted(r["file_path"].rsplit("/", 1)[1] for r in batch.collect()) == ["lock.ts", "new.go"]
    shown = engine.search("stale fresh lock fetch", str(tree), limit=9).results.collect()
    assert len(shown) == 2 and not any("stale" in r["content"] for r in shown)
    assert engine.get_indexing_status(str(tree)).first()["total_chunks"] == 2 and engine.is_indexed(str(tree))
    assert engine.update_chunk_count(str(tree)) == 2 and "2 chunks of 2 files" in engine.describe()
    assert engine.chunk_ids(str(tree), str(tree / "src" / "new.go")).count() == 1
    os.utime(tree / "src" / "lock.ts", (1, 1))  # another time, the same content
    assert engine.refresh(str(tree)) == {}
    (tree / "src" / "lock.ts").unlink()
    (tree / "src" / "new.go").unlink()
    assert engine.refresh(str(tree)) == {"deleted": 2}  # the last files leave nothing behind
    assert engine.search("lock", str(tree), strategy="bm25").results.count() == 0
    assert engine.clear_index() and not engine.clear_index(str(tree)) and engine.remove_orphans() == []


def test_compaction_keeps_the_live_rows(spark, tree, tmp_path, monkeypatch):
    from loam.plans import engine as E

    for i in range(120):
        (tree / "src" / f"m{i}.py").write_text(f"def number_{i}(value):\n    return value + {i}\n")
    engine = E.Engine(spark, str(tmp_path / "index"))
    assert engine.index_codebase(str(tree)) == 122
    for i in range(70):
        (tree / "src" / f"m{i}.py").write_text(f"def other_{i}(value):\n    return value - {i}\n\n")
    assert engine.refresh(str(tree)) == {"modified": 70}
    entry = engine._entry(str(tree))
    assert spark.read.parquet(f"{tmp_path}/index/lengths/namespace={entry['namespace']}").count() == 122
    assert engine.search("other_3", str(tree), strategy="bm25", limit=1).results.first()["file_path"].endswith("m3.py")
    assert len(engine.search("value return", str(tree), limit=50).results.collect()) == 50


def test_odd_roots_locks_and_failures(spark, tmp_path):
    from loam.plans.engine import Engine, Locked

    root = tmp_path / "c++ (old) [x]"
    (root / "lib").mkdir(parents=True)
    (root / "lib" / "a.ts").write_text("export function alpha(one: string) {\n  return one;\n}\n")
    (root / "lib" / "skip.ts").write_text("export function beta(one: string) {\n  return one;\n}\n")
    engine = Engine(spark, str(tmp_path / "index"), reranker=lambda query, text: F.lit(0.5))
    assert [r["rel_path"] for r in sources.read_tree(spark, str(root), exclude=["skip*"]).collect()] == ["lib/a.ts"]
    assert engine.index_codebase(str(root), exclude=["lib/skip.*"]) == 1
    assert engine.search("alpha", str(root)).results.first()["score"] == 0.5
    namespace = engine.namespace(str(root))
    with engine._lock(namespace):
        with pytest.raises(Locked):
            engine.refresh(str(root))
        assert engine.search("alpha", str(root), fresh=True).results.count() == 1  # a refresh that fails is no failure
    (tmp_path / "index" / "locks").mkdir(exist_ok=True)
    (tmp_path / "index" / "locks" / namespace).write_text("broken")  # taken over
    assert engine.refresh(str(root), exclude=["lib/skip.*"]) == {} and engine.lock_state(str(root)) is None

    def broken(files, limit):
        raise RuntimeError("no chunks today")

    with pytest.raises(RuntimeError):
        Engine(spark, str(tmp_path / "index"), chunker=broken).index_codebase(str(root))
    assert engine._entry(str(root))["failed"] and engine.search("alpha", str(root)).results.count() == 1


def test_small_functions(spark, tmp_path, tree):
    assert one(spark, X.duration(F.lit(61_500))) == "1m 1s" and one(spark, X.relative(F.lit("/a.b/c"), "/a.b")) == "c" and one(spark, X.relative(F.lit("/axb/c"), "/a.b")) == "/axb/c"
    keyed = spark.range(1).select(X.hmac_sha256("secret")(F.lit("key")).alias("h")).first()["h"]
    assert keyed == __import__("hmac").new(b"secret", b"key", "sha256").hexdigest()
    assert one(spark, sources.masked(F.create_map(F.lit("X-Api-Key"), F.lit("abc"), F.lit("Host"), F.lit("h")))) == {"X-Api-Key": "***", "Host": "h"}
    assert one(spark, sources.trimmed(F.lit("x" * 2005))).endswith("... (5 more)") and "python" in language.known_languages() and filters.pattern_counts()["quality"] == 8
    c = Config.from_environment({"LOAM_LIMIT": "3", "LOAM_API_KEY": "test", "LOAM_RERANK": "no", "LOAM_DIM": ""})
    assert c.search.limit == 3 and not c.search.rerank and not c.has_key and c.dim == 64
    sources.append_rows(spark.range(2), str(tmp_path / "rows"))
    sources.append_rows(spark.range(2), str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4


def test_limit_status(spark):
    frame = spark.createDataFrame([(1, "k", 0), (2, "k", 10), (3, "k", 20), (4, "old", 0)], "id int, key string, s int").select("id", "key", F.timestamp_seconds("s").alias("created_at"))
    got = {r["key"]: tuple(r)[1:] for r in usage.limit_status(frame, ["key"], 2, 60, F.lit(30_000_000)).collect()}
    assert got == {"k": (2, 2, 0, 60_000_000, 30), "old": (2, 1, 1, 60_000_000, None)}
    later = {r["key"]: tuple(r)[1:] for r in usage.limit_status(frame, ["key"], 2, 60, F.lit(60_000_000)).collect()}
    assert later == {"k": (2, 0, 2, None, None), "old": (2, 0, 2, None, None)}


def test_new_files_as_a_stream(spark, tree, tmp_path):
    from loam.streaming.events import on_new_files

    seen = []
    q = on_new_files(sources.stream_tree(spark, str(tree)), str(tmp_path / "cp"), lambda rows, _: seen.extend(r["rel_path"] for r in rows.collect()))
    q.awaitTermination(120)
    assert sorted(seen) == ["src/lock.ts", "src/parse.py"]


def test_hot_keys_join_by_a_bounded_broadcast(spark):
    from loam.sources import tables

    left = spark.range(30_000).select((F.when(F.col("id") < 10_000, 0).otherwise(F.col("id"))).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 0")
    assert tables.skew_join(left, right, "k", "n").count() == left.where("k % 2 = 0").count()


def test_files_and_logs(spark, tree, tmp_path):
    assert sorted(r["rel_path"] for r in sources.read_tree(spark, str(tree)).collect()) == ["src/lock.ts", "src/parse.py"]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "background-indexing-demo-2025-01-01T00-00-00Z.log").write_text("[t0] Starting indexing for: x\n[t1] Process completed with code: 0\n")
    row = usage.log_statistics(sources.read_logs(spark, str(logs))).first()
    assert row["completed"] and row["started"] == "t0" and row["ended"] == "t1"
    assert "demo" in sources.newest_log(spark, str(logs), "demo")
