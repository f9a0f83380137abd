"""Percentiles, splitting, neighbours, encoding and mixing against brute force and round trips."""

import base64
import math
import random

import numpy as np
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from loam.llm import mixing, neighbours, percentiles, queries, split, tokenize

EVENT = "id int, type string, api_key_id int, created_at timestamp_ntz, duration_ms int, value string"


# --- registered SQL ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(queries.ORACLE[name]).df())


# --- percentiles ---


def events(spark, values):
    made = spark.createDataFrame([(i, t, k, v) for i, (t, k, v) in enumerate(values)], "id int, type string, api_key_id int, duration_ms int")
    return made.select("id", "type", "api_key_id", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"), "duration_ms", F.lit("clash").alias("value"))


def brute(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(len(v) * p - 1e-9)) - 1]


def test_percentiles_bound_and_merge(spark):
    rng = random.Random(1)
    values = [(rng.choice(["A", None]), rng.choice([1, 2, None]), rng.choice([None, -5, 0, 7, rng.randrange(300), rng.randrange(10**6), 2**31 - 1])) for _ in range(400)]
    source = percentiles.distinct_events(events(spark, values))
    first, second = percentiles.summarize(source.where("value % 2 = 0"), ["type"]), percentiles.summarize(source.where("value % 2 = 1"), ["type"])
    found = {(r["type"], r["p"]): r for r in percentiles.percentiles(percentiles.merge(first, second), ["type"]).collect()}
    for t in ("A", None):
        own = [v for a, _, v in values if a == t and v is not None and v >= 0]
        for p in percentiles.PERCENTILES:
            r, want = found[t, p], brute(own, p)
            assert r["low"] <= want <= r["high"] and r["n"] == len(own)
            assert r["high"] - r["low"] <= max(0, want / 2**percentiles.BITS) and abs(r["value"] - want) <= r["error"] + 0.5
    exact = {(r["type"], r["p"]): r["value"] for r in percentiles.exact_percentiles(source, ["type"], halvings=3).collect()}
    assert exact == {(t, p): brute([v for a, _, v in values if a == t and v is not None and v >= 0], p) for t in ("A", None) for p in percentiles.PERCENTILES}


@pytest.mark.parametrize("halvings", [3, 11])
def test_percentiles_of_negative_and_fractional_values(spark, halvings):
    rng = random.Random(halvings)
    inf, nan = float("inf"), float("nan")
    doubles = [(g, x) for g in ("a", "b", None) for x in [rng.gauss(0, 10.0 ** rng.randint(-5, 8)) for _ in range(200)] + [0.0, -0.0, 5e-324, -1e300, 1e300, inf, -inf, nan, None]]
    ordered = {g: sorted(x for h, x in doubles if h == g and x is not None and abs(x) < inf) for g in ("a", "b", None)}
    rows = spark.createDataFrame(doubles, "g string, x double").withColumnRenamed("x", "value")
    wanted = (0.01, 0.5, 0.99)
    exact = {(r["g"], r["p"]): r["value"] for r in percentiles.exact_percentiles(rows, ["g"], wanted=wanted, halvings=4 * halvings).collect()}
    assert exact == {(g, p): brute(v, p) for g, v in ordered.items() for p in wanted}
    for r in percentiles.percentiles(percentiles.summarize(rows, ["g"]), ["g"], wanted, fractional=True).collect():
        want = brute(ordered[r["g"]], r["p"])
        assert r["low"] <= want <= r["high"] and r["high"] - r["low"] <= abs(want) / 2**percentiles.BITS * 1.02 + 5e-320
    whole = [rng.randint(-(10**k), 10**k) for k in range(1, 18) for _ in range(20)] + [-(2**63), 2**63 - 1, None]
    ints = spark.createDataFrame([(x,) for x in whole], "value bigint").withColumn("g", F.lit(1))
    known = sorted(x for x in whole if x is not None)
    assert {r["p"]: r["value"] for r in percentiles.exact_percentiles(ints, ["g"], wanted=wanted, halvings=4 * halvings).collect()} == {p: brute(known, p) for p in wanted}
    for r in percentiles.percentiles(percentiles.summarize(ints, ["g"]), ["g"], wanted).collect():
        want = brute(known, r["p"])
        assert r["low"] <= want <= r["high"] and r["high"] - r["low"] <= abs(want) / 2**percentiles.BITS


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([], EVENT)
    assert percentiles.percentiles(percentiles.grouped(none), ["level", "type", "api_key_id"]).count() == 0
    twice = spark.createDataFrame([(1, "A", 1, None, 5, "x")] * 3, EVENT)
    assert {r["n"] for r in percentiles.percentiles(percentiles.grouped(twice), ["level", "type", "api_key_id"]).collect()} == {1}


# --- splitting ---


@pytest.mark.parametrize("text", ["line of text\n" * 400, "x" * 5000, "é漢🚀" * 900, "a\r\n" * 2000, "{\n" + "  y;\n" * 600 + "}\n\n" + "z" * 3000, "word " * 1200])
@pytest.mark.parametrize("limit, overlap", [(1500, 150), (100, 0), (100, 99), (7, 3)])
def test_cut(text, limit, overlap):
    pieces = split.cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e in pieces)
    assert all(b[0] == max(0, a[1] - overlap) and b[1] > a[1] for a, b in zip(pieces, pieces[1:]))
    done = text[: pieces[0][1]] + "".join(text[a[1] : b[1]] for a, b in zip(pieces, pieces[1:]))
    assert done == text


def test_cut_is_least(spark):
    """The dynamic programme finds the least cost that trying all cuts finds."""
    text, limit, overlap = "aa\nb\n\nccc\ndd }\n}\nee\nf\ngg\n", 9, 2
    places, penalty = split.boundaries(text, max(1, (limit - overlap) // 4))
    n, room = len(text), limit - overlap
    count = 1 + -(-(n - limit) // room)
    target = (n + (count - 1) * overlap) / count

    def cost(ends):
        total = 0.0
        for i, e in enumerate(ends):
            size = e if not i else e - ends[i - 1] + overlap
            total += (size - target) ** 2 / limit**2 + penalty[places.index(e)] + 0.05
        return total

    def all_cuts(last, first):
        for e in places:
            if last < e <= last + (limit if first else room):
                if e == n:
                    yield [e]
                else:
                    yield from ([e, *r] for r in all_cuts(e, False))

    assert math.isclose(cost([e for _, e in split.cut(text, limit, overlap)]), min(cost(c) for c in all_cuts(0, True)))


def test_split_table(spark):
    config = spark.createDataFrame([("default", 20, 5), ("python", None, None), ("go", 30, 0)], "language string, max_chunk_size int, overlap_chars int")
    made = [("a", "x = 1\n" * 10, "python", 5), ("a", "x = 1\n" * 10, "python", 5), ("b", "y" * 20, None, 1), ("c", "y" * 21, None, None), ("d", None, "go", 1), ("e", "", "go", 1), (None, "z" * 40, "rust", 1), ("f", "w" * 30, "go", 1)]
    chunks = spark.createDataFrame(made, "id string, content string, language string, start_line int").withColumn("lim", F.lit("clash")).withColumn("piece", F.lit(1))
    got = split.split_oversized(chunks, config).orderBy("id", "piece").collect()
    assert {r["id"] for r in got} == {"a", "c", None}
    own = [r for r in got if r["id"] == "a"]
    assert own[0]["start_line"] == 5 and own[-1]["end_line"] == 14 and [r["piece"] for r in own] == list(range(len(own)))
    assert all(r["start_line"] is None for r in got if r["id"] == "c")
    assert split.split_oversized(chunks.limit(0), config.limit(0)).count() == 0


# --- neighbours ---


def exact_neighbours(table):
    ids = sorted(table, key=str.encode)
    x = neighbours.unit(np.array([table[i] for i in ids], dtype=np.float64))
    out = {}
    for i, a in enumerate(ids):
        cos = np.rint(x[i] @ x.T * 1e6).astype(int)
        out[a] = [ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-cos[j], ids[j].encode()))[:10]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    base = {f"v{i:04d}": rng.standard_normal(64).astype(np.float32).tolist() for i in range(150)}
    base |= {f"c{i:02d}": base["v0000"] for i in range(30)}  # a group of equal vectors
    base |= {f"s{i}": [2 * x for x in base["v0001"]] for i in range(3)}  # the same directions
    bad = [("z0", None), ("z1", [1.0] * 63), ("z2", [0.0] * 64), ("z3", [float("nan")] * 64), ("z4", [float("inf")] + [1.0] * 63), (None, [1.0] * 64)]
    frame = spark.createDataFrame([*base.items(), *list(base.items())[:20], *bad], "id string, vector array<float>").withColumn("num", F.lit("clash"))
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in neighbours.nearest(frame).collect()}
    want = exact_neighbours(base)
    assert set(got) == set(want)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.99 * 10 * len(want)
    pairs = {tuple(r) for r in neighbours.pairs(neighbours.nearest(frame)).collect()}
    assert all(a < b for a, b in pairs) and len(pairs) >= 0.98 * len({tuple(sorted((a, b))) for a in want for b in want[a]})


def test_full_lists_are_dealt_out(spark, monkeypatch):
    """Cells of at most a few members give what whole lists give."""
    rng = np.random.default_rng(4)
    table = {f"v{i:04d}": (rng.standard_normal(64) + 3).astype(np.float32).tolist() for i in range(200)} | {f"w{i:03d}": [1.0] * 64 for i in range(60)}
    frame = spark.createDataFrame([*table.items()], "id string, vector array<float>")
    whole = sorted(map(tuple, neighbours.pairs(neighbours.nearest(frame)).collect()))
    monkeypatch.setattr(neighbours, "FULL", 20)
    assert sorted(map(tuple, neighbours.pairs(neighbours.nearest(frame)).collect())) == whole


def test_neighbours_of_few(spark):
    schema = "id string, vector array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    assert [r["neighbours"] for r in neighbours.nearest(spark.createDataFrame([("a", [1.0] * 64)], schema)).collect()] == [[]]


def test_centroid_graph_finds_the_nearest():
    rng = np.random.default_rng(0)
    centre = neighbours.unit(rng.standard_normal((400, 64)))
    x = neighbours.unit(rng.standard_normal((200, 64)))
    at, cos = neighbours.CentroidGraph(centre).search(x, 5)
    assert (at[:, 0] == np.argmax(x @ centre.T, axis=1)).mean() >= 0.95
    assert all(len(set(r)) == 5 for r in at.tolist()) and (np.diff(cos, axis=1) <= 1e-6).all()


# --- encoding ---


def reference_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = [None, "", " ", "\n\n  \t x", "don't we'll I'VE", "<|endoftext|>", "aaaaaaaa" * 50, "x" * 20_000, "日本語のテキスト 12345", "🚀✅ é \u00a0\u2003 z\u200b", "a  b   c    ", "Größe\r\n\r\n", "\x1c\x85\u2028y", "ÀÉ½²٣"]


def test_encoding(spark):
    want = reference_encoding()
    frame = spark.createDataFrame([*enumerate(HARD), *enumerate(HARD)], "doc_id bigint, text string").withColumn("pre", F.lit("clash")).withColumn("ids", F.lit(1))
    got = tokenize.encode(frame).collect()
    assert len(got) == 2 * len(HARD)
    for r in got:
        assert r["ids"] == (want.encode_ordinary(HARD[r["doc_id"]]) if HARD[r["doc_id"]] else [])
        assert want.decode(r["ids"]) == (HARD[r["doc_id"]] or "")
    assert tokenize.encode(frame.limit(0)).count() == 0


def test_encoding_of_documents(spark):
    want = reference_encoding()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.p7_ids(spark, DATA).collect():
        assert r["ids"] == (want.encode_ordinary(texts[r["doc_id"]]) if texts[r["doc_id"]] else [])


# --- mixing ---


def test_split_tree_loses_nothing():
    rng = np.random.default_rng(5)
    blocks = np.array([100, 7, 0, 13])
    parts = mixing.split_tree(rng, blocks, 16)
    assert len(parts) == 16 and (np.sum(parts, axis=0) == blocks).all()
    assert max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 4


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, "word " * rng.randrange(1, 60), rng.choice(["a"] * 8 + ["b", None, "other"]), "x") for i in range(600)] + [(9000, None, "a", "x"), (9001, "", "b", "x")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string, shard string")
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 2), (None, 0.3, 1)], "source string, weight double, max_repeats int")
    got = mixing.mix(frame, goals, seed=7).collect()
    assert {r["source"] for r in got} == {"a", "b"} and len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    assert max(r["copy"] for r in got if r["source"] == "a") == 0 and max(r["copy"] for r in got if r["source"] == "b") == 2
    told = {r["source"]: r for r in mixing.shares(frame, goals, seed=7).collect()}
    assert told["gone"]["tokens"] == 0 and not told["gone"]["reached"] and not told["b"]["reached"] and told["a"]["reached"]
    assert told["b"]["tokens"] == 3 * told["b"]["available"] and abs(told["a"]["tokens"] - told["a"]["quota"]) <= 61
    assert {s: sum(r["n_tokens"] for r in got if r["source"] == s) for s in "ab"} == {s: told[s]["tokens"] for s in "ab"}
    assert len({r["shard"] for r in got}) == mixing.SHARDS
    again = mixing.mix(frame.repartition(3), goals, seed=7).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mixing_in_finer_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 1)
    frame = spark.createDataFrame([(i, "some words here " * (i % 7 + 1), "ab"[i % 3 == 0]) for i in range(300)], "doc_id bigint, text string, source string")
    goals = spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 5)], "source string, weight double, max_repeats int")
    for r in mixing.shares(frame, goals).collect():
        assert r["reached"] and r["quota"] - 30 <= r["tokens"] <= r["quota"]


def test_mixing_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    goals = spark.createDataFrame([("a", None, None)], "source string, weight double, max_repeats int")
    assert mixing.mix(docs, goals).count() == 0 and mixing.mix(docs, goals.limit(0)).count() == 0
    assert [r["share"] for r in mixing.shares(docs, goals).collect()] == [0.0]
