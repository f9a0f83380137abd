"""Retrieval: inverted index, BM25, cosine, reciprocal-rank fusion, overlap suppression, reranking.

Ranking functions are expressions; every top-k is an ``ORDER BY ... LIMIT``, which Spark runs
as a partial top-k per partition.  Query terms are pushed into the postings by a semi-join
against the query's few terms before anything is scored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.sources.tables import materialize

K1, B = 1.2, 0.75
#: Fusion constants.  Fixed values.
RANK_OFFSET, RANK_BASE, LEAST_SCORE, BONUS, OVERLAP = 10, 100, 0.01, 0.2, 0.7
VECTOR_WEIGHT, TEXT_WEIGHT = 0.6, 0.4
DEFAULT_LIMIT, MOST_CANDIDATES, RERANK_DEPTH = 8, 50, 20


def postings(docs: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """``key``, ``term`` and ``tf``."""
    return docs.where(F.col(content).isNotNull()).select(key, F.explode(X.terms(content)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """``key`` and ``len``, the number of terms; 0 for null content."""
    return docs.select(key, F.coalesce(F.size(X.terms(content)), F.lit(0)).alias("len"))


def indexed(docs: DataFrame, key: str = "id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Postings and lengths from one reading of the texts: the terms are written once."""
    words = materialize(docs.select(key, X.terms(content).alias("_terms")))
    index = words.select(key, F.explode("_terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return index, words.select(key, F.coalesce(F.size("_terms"), F.lit(0)).alias("len"))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    return queries.select(key, F.explode(F.array_distinct(X.terms(text))).alias("term"))


def bm25(index: DataFrame, doc_lengths: DataFrame, queries: DataFrame, key: str = "id") -> DataFrame:
    """``query_id``, ``key`` and ``score`` of every document with a term of the query.

    Scores are sums of rounded contributions, so that their order doesn't change them."""
    asked = query_terms(queries)
    hit = materialize(index.join(asked.select("term").distinct(), "term", "left_semi"))  # only the queries' terms
    n, mean = doc_lengths.agg(F.count("*")).scalar(), doc_lengths.agg(F.avg("len")).scalar()
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    # only documents with a hit need their length; the two statistics are scalar subqueries
    scored = hit.join(df, "term").join(doc_lengths, key).withColumns({"n": n, "mean": mean})
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return scored.join(asked, "term").groupBy("query_id", key).agg(F.sum(F.round(part, 9).cast("decimal(20,9)")).cast("double").alias("score"))


def top(scored: DataFrame, limit: int, key: str = "id", ascending: bool = False, by: str = "query_id") -> DataFrame:
    """The best ``limit`` rows per query with their ``rank`` from 0; ties to the smaller key."""
    order = F.col("score").asc() if ascending else F.col("score").desc()
    # compared as it is, the row number is limited within each partition, before the shuffle
    numbered = scored.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order, F.col(key)))).where(F.col("_n") <= limit)
    return numbered.withColumn("rank", F.col("_n") - 1).drop("_n")


def unit(v: str | Column) -> Column:
    """The vector in double precision."""
    return X.col(v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in a fixed order of summation; null for zero vectors."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(v: str | Column, dim: int) -> Column:
    c = X.col(v)
    return F.coalesce((F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0), F.lit(False))


def vector_scores(vectors: DataFrame, queries: list[tuple[int, list[float]]], key: str = "id", vector: str = "vector", dim: int = 64) -> DataFrame:
    """``query_id``, ``key`` and ``score``, the cosine distance rounded to 6 decimals, of every usable vector.

    A stated few query vectors travel as literals within the plan; the vectors are read once,
    and nothing is joined."""
    each = [F.struct(F.lit(i).cast("bigint").alias("query_id"), F.lit([float(x) for x in q]).cast("array<double>").alias("q")) for i, q in queries]
    asked = F.array(*each) if each else F.array().cast("array<struct<query_id: bigint, q: array<double>>>")
    rows = vectors.where(usable(vector, dim)).select(key, unit(vector).alias("v"), F.explode(asked).alias("a"))
    return rows.select(F.col("a.query_id").alias("query_id"), key, F.round(1 - cosine(F.col("v"), F.col("a.q")), 6).alias("score"))


def candidates(limit: int) -> int:
    """How deep each arm is read."""
    return min(2 * limit, MOST_CANDIDATES)


def fuse(vector_hits: DataFrame, text_hits: DataFrame, vector_weight: float = VECTOR_WEIGHT, text_weight: float = TEXT_WEIGHT, key: str = "id", by: str = "query_id") -> DataFrame:
    """Ranked hits (``by``, ``key``, ``rank``) of both arms fused by reciprocal rank.

    ``raw`` is the sum of the weighted reciprocal ranks, ``rank`` the order by it: ties go to the
    better vector rank, then text rank, then the smaller key.  ``score`` is raw over its maximum
    plus a bonus that falls with the rank, at most 1."""
    arm = lambda h, w, v: h.select(by, key, F.lit(w * RANK_BASE).alias("w"), "rank", (F.col("rank") if v else F.lit(None).cast("int")).alias("v_rank"), (F.lit(None).cast("int") if v else F.col("rank")).alias("t_rank"))
    both = arm(vector_hits, vector_weight, True).unionByName(arm(text_hits, text_weight, False))
    part = F.col("w") / (RANK_OFFSET + F.col("rank") + 1)
    fused = both.groupBy(by, key).agg(F.sum(part).alias("raw"), F.min("v_rank").alias("v_rank"), F.min("t_rank").alias("t_rank")).where(F.col("raw") >= LEAST_SCORE)
    fused = fused.withColumn("raw", F.round("raw", 9))
    order = Window.partitionBy(by).orderBy(F.col("raw").desc(), F.col("v_rank").asc_nulls_last(), F.col("t_rank").asc_nulls_last(), F.col(key))
    everything = Window.partitionBy(by)
    ranked = fused.withColumns({"rank": F.row_number().over(order) - 1, "n": F.count("*").over(everything), "most": F.max("raw").over(everything)})
    score = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("raw") / F.col("most")) + (F.col("n") - F.col("rank")) / F.col("n") * BONUS)
    return ranked.select(by, key, "rank", F.round("raw", 6).alias("raw"), F.round(score, 6).alias("score"))


def keep_first(ranked: DataFrame, same: list[str]) -> DataFrame:
    """The best-ranked row of those equal in ``same``."""
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy("rank"))).where(F.col("_n") == 1).drop("_n")


def without_overlaps(ranked: DataFrame, by: str = "query_id", path: str = "file_path") -> DataFrame:
    """The rows that no better row of the same file and query covers by more than 70 %.

    An anti-join on (query, file) with the range as a residual; rows without a path or of no
    size are kept."""
    a, b = ranked.alias("a"), ranked.alias("b")
    size = F.col("a.end_line") - F.col("a.start_line")
    shared = F.least("a.end_line", "b.end_line") - F.greatest("a.start_line", "b.start_line")
    covered = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col(f"a.{path}") == F.col(f"b.{path}")) & (F.col("b.rank") < F.col("a.rank")) & (size > 0) & (shared > OVERLAP * size)
    return a.join(b, covered, "left_anti")


def rerank_text(path: Column, start: Column, end: Column, symbols: Column, content: Column) -> Column:
    """What a reranker is shown of a hit."""
    return F.concat_ws("\n", F.concat(F.lit("File: "), path), F.concat(F.lit("Lines: "), start.cast("string"), F.lit("-"), end.cast("string")), F.when(F.size(symbols) > 0, F.concat(F.lit("Symbols: "), F.array_join(symbols, ", "))), content)


def lexical_relevance(query: Column, text: Column) -> Column:
    """The default reranker: the share of the query's terms in a text, terms counted with diminishing weight."""
    asked, given = F.array_distinct(X.terms(query)), X.terms(text)
    found = F.transform(asked, lambda t: F.size(F.filter(given, lambda g: g == t)))
    gain = F.aggregate(found, F.lit(0.0), lambda s, n: s + n / (n + 1.0))
    return F.round(X.ratio(gain, F.size(asked)), 6)


def rerank(hits: DataFrame, query: Column, text: Column, by: str = "query_id", key: str = "id", depth: int = RERANK_DEPTH, scorer=lexical_relevance) -> DataFrame:
    """The first ``depth`` hits of each query in the order of their relevance, and after them all
    others as they were; the old score is kept.  ``scorer`` makes the relevance of (query, text)."""
    near = F.col("rank") < depth
    scored = hits.withColumns({"original_score": F.col("score"), "score": F.when(near, scorer(query, text)).otherwise(F.col("score")), "_far": ~near})
    order = Window.partitionBy(by).orderBy("_far", F.when(~F.col("_far"), F.col("score")).desc_nulls_last(), F.col("rank"), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order) - 1).drop("_far")


def embed(content: str | Column, dim: int = 64) -> Column:
    """The default embedder: term counts hashed into ``dim`` buckets, as a unit vector.

    Bucket and sign come from the term's MD5, so any engine gives the same vector."""
    bucket = lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % dim
    sign = lambda t: F.when(F.conv(F.substring(F.md5(t), 7, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)
    marked = F.transform(X.terms(truncated(content)), lambda t: F.struct(bucket(t).alias("b"), sign(t).alias("s")))
    # a transform over an array of one binds its element, which is then computed once
    bound = lambda value, use: F.transform(F.array(value), use)[0]
    spread = lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(m, F.lit(0.0), lambda a, x: a + F.when(x["b"] == i, x["s"]).otherwise(0.0)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    scaled = lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))
    return bound(bound(marked, spread), scaled)


def truncated(content: str | Column) -> Column:
    return X.truncate(content)


def hybrid(docs: DataFrame, vectors: DataFrame, queries: list[tuple[int, str, list[float]]], limit: int = DEFAULT_LIMIT, vector_weight: float = VECTOR_WEIGHT, text_weight: float = TEXT_WEIGHT, where: Column | None = None) -> DataFrame:
    """The best ``limit`` chunks per query: BM25 and cosine, fused, without repeats and overlaps.

    ``docs`` has id, content, file_path, start_line and end_line; ``vectors`` id and vector;
    a query is (query_id, text, vector).  ``where`` filters the chunks before any ranking.
    """
    spark = docs.sparkSession
    queries = [q for q in queries if q[1] and q[1].strip()]  # a blank query asks for nothing
    if where is not None:
        docs = docs.where(where)
        vectors = vectors.join(docs.select("id"), "id", "left_semi")
    asked = spark.createDataFrame([(q[0], q[1]) for q in queries], "query_id bigint, query string")
    depth = candidates(limit)
    index, sizes = indexed(docs)
    text_hits = top(bm25(index, sizes, asked), depth)
    vector_hits = top(vector_scores(vectors, [(q[0], q[2]) for q in queries if q[2]]), depth, ascending=True)
    fused = fuse(vector_hits, text_hits, vector_weight, text_weight)
    # few rows, at most twice the depth per query, that the anti-join reads twice
    placed = materialize(docs.select("id", "file_path", "start_line", "end_line").join(fused, "id"))
    kept = without_overlaps(keep_first(placed, ["query_id", "file_path", "start_line", "end_line"]))
    final = kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("position") <= limit)
    return final.select("query_id", "position", "id", "file_path", "start_line", "end_line", "raw", "score")


def any_of(terms: list[str], column: str = "term") -> Column:
    return reduce(Column.__or__, [F.col(column) == t for t in terms], F.lit(False))
