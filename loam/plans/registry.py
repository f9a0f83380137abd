"""The registered queries over the engine's operators and the same in SQL.

``QUERIES`` maps names to functions of (spark, data folder); ``ORACLE`` has the SQL, written
for DuckDB from the semantics and not from the plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators import chunks as C
from loam.operators import discovery, filters, language, search, store, symbols, units, usage
from loam.plans import goldens, values
from loam.sources.tables import materialize, spread, table

FLAGSHIP = "hybrid_search"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _files(spark: SparkSession, d: str) -> DataFrame:
    return store.files(table(spark, d, "source_files").select("path", "rel_path", "namespace", "language", "size", "mtime", "content"))


def _latest(spark: SparkSession, d: str, *derived) -> DataFrame:
    """path and what is derived from the latest state of each file; no content is shuffled."""
    return store.latest_of(spread(table(spark, d, "source_files").select("path", "rel_path", "language", "mtime", "content")), *derived)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return store.distinct_chunks(table(spark, d, "chunks"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """The chunks to search, written once: postings, lengths and results each read them."""
    return materialize(_chunks(spark, d).select("id", "content", "file_path", "start_line", "end_line", "symbols"))


_EVENTS_SQL = "ev AS (SELECT DISTINCT id, type, namespace_id, metadata, CASE WHEN duration_ms >= 0 THEN duration_ms END AS duration_ms, status_code, created_at, api_key_id FROM api_event)"
W = X.WS
_FILES_SQL = "f AS (SELECT * EXCLUDE (_h) FROM (SELECT *, coalesce(md5(content), '') AS _h FROM source_files WHERE path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, _h DESC) = 1)"
_CHUNKS_SQL = "c AS (SELECT * EXCLUDE (_h) FROM (SELECT *, md5(coalesce(content, '')) AS _h FROM chunks WHERE id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY _h DESC) = 1)"
_LINES_SQL = "l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM f WHERE content IS NOT NULL)"


def _sql_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{W}+', ''), '{W}+\\z', '')"


def _q(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _any(column: str, patterns: list[str]) -> str:
    """Whether one of some patterns matches, in SQL."""
    return "(" + " OR ".join(f"regexp_matches({column}, {_q(p)})" for p in patterns) + ")"


_TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"

# --- terms, postings, BM25 ---------------------------------------------------------------


@query(f"WITH {_CHUNKS_SQL}, t AS (SELECT id, unnest({_TERMS.format('content')}) AS term FROM c) SELECT id, term, count(*) AS tf FROM t GROUP BY ALL")
def postings_tf(spark, d):
    return search.postings(_chunks(spark, d))


@query(f"WITH {_CHUNKS_SQL} SELECT id, coalesce(len({_TERMS.format('content')}), 0) AS len FROM c")
def doc_lengths(spark, d):
    return search.lengths(_chunks(spark, d))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark, d):
    return table(spark, d, "documents").select(F.explode(X.terms("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


TEXT_QUERIES = [(1, "parse the notebook content"), (2, "checksum window merge"), (3, "async function load registry"), (4, "return None from scope tree"), (5, "  ")]
_QUERIES_SQL = "q(query_id, query) AS (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in TEXT_QUERIES) + ")"
_BM25_SQL = f"""tok AS (SELECT id, unnest({_TERMS.format('content')}) AS term FROM c), tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT id, coalesce(len({_TERMS.format('content')}), 0) AS len FROM c), st AS (SELECT count(*) AS n, avg(len) AS mean FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT query_id, unnest({_TERMS.format('query')}) AS term FROM q),
bm AS (SELECT query_id, id, CAST(sum(CAST(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)), 9) AS DECIMAL(20, 9))) AS DOUBLE) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), st GROUP BY ALL)"""


@query(f"WITH {_CHUNKS_SQL}, {_QUERIES_SQL}, {_BM25_SQL} SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INT) AS rank FROM bm) WHERE rank < 20")
def bm25_batch_topk(spark, d):
    docs = _docs(spark, d)
    asked = spark.createDataFrame(TEXT_QUERIES, "query_id bigint, query string")
    return search.top(search.bm25(*search.indexed(docs), asked), 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


# --- vectors and fusion ------------------------------------------------------------------

#: Query vectors by rule: coordinate i of query k is sin of their mix.
VECTOR_QUERIES = [(k, [round(__import__("math").sin(k * 1.7 + i * (0.3 + 0.11 * k)), 6) for i in range(64)]) for k in range(1, 6)]
_VECTORS_SQL = "v AS (SELECT id, any_value(CAST(vector AS DOUBLE[])) AS v FROM vectors WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY id)"
_VQ_SQL = "vq(query_id, q) AS (VALUES " + ", ".join(f"({k}, CAST([{', '.join(map(str, v))}] AS DOUBLE[]))" for k, v in VECTOR_QUERIES) + ")"
_VHITS_SQL = "vs AS (SELECT query_id, id, round(1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS score FROM v, vq)"


def _vectors(spark, d):
    return store.latest(table(spark, d, "vectors").select("id", "namespace", "vector").where(search.usable("vector", 64)), "id", ["namespace"])


@query(f"WITH {_VECTORS_SQL}, {_VQ_SQL}, {_VHITS_SQL} SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, id) - 1 AS INT) AS rank FROM vs) WHERE rank < 10")
def vector_topk(spark, d):
    return search.top(search.vector_scores(_vectors(spark, d), VECTOR_QUERIES), 10, ascending=True)


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 3), q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS score FROM e, q ORDER BY score, vec_id LIMIT 10")
def vector_topk_filtered(spark, d):
    e = table(spark, d, "embeddings")
    q = [(7, r[0]) for r in e.where("vec_id = 7").select("embedding").limit(1).collect()]
    return search.vector_scores(e.where("label = 3"), q, key="vec_id", vector="embedding").orderBy("score", "vec_id").limit(10).select("vec_id", "score")


_FUSE_SQL = """arm AS (SELECT query_id, id, 60.0::DOUBLE AS w, rank, rank AS v_rank, NULL::INT AS t_rank FROM vh UNION ALL SELECT query_id, id, 40.0::DOUBLE, rank, NULL, rank FROM th),
fu AS (SELECT query_id, id, round(sum(w / (11 + rank)), 9) AS raw, min(v_rank) AS v_rank, min(t_rank) AS t_rank FROM arm GROUP BY ALL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, v_rank NULLS LAST, t_rank NULLS LAST, id) - 1 AS INT) AS rank, count(*) OVER (PARTITION BY query_id) AS n, max(raw) OVER (PARTITION BY query_id) AS most FROM fu WHERE raw >= 0.01),
fin AS (SELECT query_id, id, rank, round(raw, 6) AS raw, round(least(1.0, raw / most + (n - rank)::DOUBLE / n * 0.2), 6) AS score FROM rk)"""
_ARMS_SQL = """vh AS (SELECT * FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, id) - 1 AS INT) AS rank FROM vs) WHERE rank < 16),
th AS (SELECT * FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INT) AS rank FROM bm) WHERE rank < 16)"""


@query(f"WITH {_CHUNKS_SQL}, {_QUERIES_SQL}, {_BM25_SQL}, {_VECTORS_SQL}, {_VQ_SQL}, {_VHITS_SQL}, {_ARMS_SQL}, {_FUSE_SQL} SELECT query_id, id, rank, raw, score FROM fin")
def rrf_fuse(spark, d):
    docs = _docs(spark, d)
    asked = spark.createDataFrame(TEXT_QUERIES, "query_id bigint, query string")
    text = search.top(search.bm25(*search.indexed(docs), asked), 16)
    return search.fuse(search.top(search.vector_scores(_vectors(spark, d), VECTOR_QUERIES), 16, ascending=True), text)


_DEDUPE_SQL = """pl AS (SELECT f.*, c.file_path, c.start_line, c.end_line FROM fin f JOIN c USING (id)),
kf AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY query_id, file_path, start_line, end_line ORDER BY rank) = 1),
ov AS (SELECT a.* FROM kf a WHERE NOT EXISTS (SELECT 1 FROM kf b WHERE b.query_id = a.query_id AND b.file_path = a.file_path AND b.rank < a.rank AND a.end_line > a.start_line
  AND least(a.end_line, b.end_line) - greatest(a.start_line, b.start_line) > 0.7 * (a.end_line - a.start_line)))"""
HYBRID = [(i, t, dict(VECTOR_QUERIES)[i]) for i, t in TEXT_QUERIES]
_VHITS_ASKED_SQL = _VHITS_SQL.replace("FROM v, vq)", "FROM v, vq WHERE query_id IN (SELECT query_id FROM q WHERE regexp_matches(query, '\\S')))")


@query(f"WITH {_CHUNKS_SQL}, {_QUERIES_SQL}, {_BM25_SQL}, {_VECTORS_SQL}, {_VQ_SQL}, {_VHITS_ASKED_SQL}, {_ARMS_SQL}, {_FUSE_SQL}, {_DEDUPE_SQL} SELECT query_id, position, id, file_path, start_line, end_line, raw, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS position FROM ov) WHERE position <= 8")
def hybrid_search(spark, d):
    return search.hybrid(_docs(spark, d), _vectors(spark, d), HYBRID)


_RANKED_SQL = f"WITH {_CHUNKS_SQL}, p AS (SELECT 0 AS query_id, id, file_path, start_line, end_line, CAST(row_number() OVER (PARTITION BY file_path ORDER BY length(content) DESC NULLS LAST, id) - 1 AS INT) AS rank FROM c WHERE file_path IS NOT NULL)"


def _ranked(spark, d):
    """Every chunk, ranked within its file by size."""
    order = Window.partitionBy("file_path").orderBy(F.length("content").desc_nulls_last(), "id")
    return _chunks(spark, d).where("file_path is not null").select(F.lit(0).alias("query_id"), "id", "file_path", "start_line", "end_line", (F.row_number().over(order) - 1).alias("rank"))


@query(_RANKED_SQL + " SELECT query_id, id, file_path, start_line, end_line, rank FROM p QUALIFY row_number() OVER (PARTITION BY file_path, start_line, end_line ORDER BY rank) = 1")
def dedupe_ranges(spark, d):
    return search.keep_first(_ranked(spark, d), ["file_path", "start_line", "end_line"])


@query(_RANKED_SQL + " SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.file_path = a.file_path AND b.rank < a.rank AND a.end_line > a.start_line AND least(a.end_line, b.end_line) - greatest(a.start_line, b.start_line) > 0.7 * (a.end_line - a.start_line))")
def overlap_antijoin(spark, d):
    return search.without_overlaps(_ranked(spark, d))


@query(f"""WITH {_CHUNKS_SQL}, {_QUERIES_SQL}, {_BM25_SQL}, h AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS INT) AS rank FROM bm), t AS (
  SELECT h.query_id, h.id, h.rank, list_distinct({_TERMS.format('q.query')}) AS asked, {_TERMS.format("concat_ws(chr(10), 'File: ' || c.file_path, 'Lines: ' || c.start_line || '-' || c.end_line, CASE WHEN len(c.symbols) > 0 THEN 'Symbols: ' || array_to_string(list_transform(c.symbols, lambda s: s.name), ', ') END, c.content)")} AS given
  FROM h JOIN q USING (query_id) JOIN c USING (id) WHERE h.rank < 16),
s AS (SELECT query_id, id, rank AS old, round(list_sum(list_transform(asked, lambda a: len(list_filter(given, lambda g: g = a)) / (len(list_filter(given, lambda g: g = a)) + 1.0)))::DOUBLE / len(asked), 6) AS score FROM t)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old, id) - 1 AS INT) AS rank FROM s""")
def rerank_lexical(spark, d):
    chunks = _docs(spark, d)
    asked = spark.createDataFrame(TEXT_QUERIES, "query_id bigint, query string")
    hits = search.top(search.bm25(*search.indexed(chunks), asked), 16)
    shown = search.rerank_text(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.transform("symbols", lambda s: s["name"]), F.col("content"))
    full = hits.join(chunks.select("id", shown.alias("shown")), "id").join(asked, "query_id")
    return search.rerank(full, F.col("query"), F.col("shown")).select("query_id", "id", "score", "rank")


def _cut_sql(text: str, limit: int) -> str:
    """A text cut for an embedder: where its last line end or brace stands is told by what comes after it."""
    head = f"left({text}, {limit})"
    last = lambda c: f"CASE WHEN contains({head}, {c}) THEN {limit} - length(string_split({head}, {c})[-1]) ELSE 0 END"
    k = f"greatest({last('chr(10)')}, {last(_q('}'))})"
    return f"CASE WHEN length({text}) <= {limit} THEN {text} WHEN {k} - 1 > {limit} * 0.8 THEN left({text}, {k}) ELSE {head} || chr(10) || '// ... content truncated for embedding' END"


@query(f"""WITH {_CHUNKS_SQL}, t AS (SELECT id, unnest({_TERMS.format(_cut_sql("content", 20000))}) AS t FROM c),
b AS (SELECT id, CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 64 AS b, sum(CASE WHEN CAST('0x' || substr(md5(t), 7, 1) AS INT) < 8 THEN 1.0 ELSE -1.0 END)::DOUBLE AS s FROM t GROUP BY ALL),
n AS (SELECT id, sqrt(sum(s * s)) AS n FROM b GROUP BY id) SELECT b.id, CAST(b.b AS INT) AS dim, round(s / n, 6) AS value FROM b JOIN n USING (id) WHERE s <> 0""")
def embed_hashed(spark, d):
    """Every chunk, those beyond the embedder's limit by their truncated text."""
    rows = _chunks(spark, d).select("id", F.posexplode(search.embed("content")).alias("dim", "value"))
    return rows.where("value <> 0").select("id", "dim", F.round("value", 6).alias("value"))


# --- discovery, filters, language --------------------------------------------------------


@query(f"""WITH {_FILES_SQL}, s AS (SELECT path, string_split(rel_path, '/') AS p FROM f) SELECT path FROM s WHERE len(p) <= 21 AND len(list_filter(p[1:-2], lambda x: x IN ({', '.join(map(_q, values.IGNORED_DIRECTORIES))}) OR starts_with(x, '.'))) = 0
AND p[-1] NOT IN ({', '.join(map(_q, values.IGNORED_FILES))}) AND NOT starts_with(p[-1], '.') AND NOT ends_with(p[-1], '.min.js') AND NOT ends_with(p[-1], '.map') AND NOT contains(p[-1], '.generated.') AND NOT contains(p[-1], '.gen.')
AND lower(regexp_extract(p[-1], '(\\.[^.]*)$', 1)) IN ({', '.join(map(_q, values.SCRIPT_EXTENSIONS))})""")
def discover_files(spark, d):
    return _latest(spark, d, discovery.included("rel_path", ["typescript", "javascript", "python"]).alias("kept")).where("kept").select("path")


def _cascade_sql() -> str:
    tr = _sql_trim("x")
    case = ["WHEN content IS NULL THEN 'No content|0|1.0'", f"WHEN {_any('lp', values.TEST)} THEN 'Test file|0|0.9'", f"WHEN {_any('lp', values.GENERATED)} THEN 'Generated file|0|0.95'"]
    case += [f"WHEN {_any('nm', values.VALUABLE)} THEN 'Valuable configuration file|1|0.7'", f"WHEN {_any('lp', values.CONFIG)} OR {_any('nm', values.CONFIG)} THEN 'Configuration file|0|0.85'", "WHEN length(content) > 500000 THEN 'File too large (likely data file)|0|0.9'"]
    case += [f"WHEN length(content) >= {n} AND regexp_matches(content, {_q(p)}) THEN {_q(r + '|0|0.8')}" for p, r, n in values.INDICATORS]
    case += ["WHEN com > 0.8 THEN 'Mostly comments (documentation file)|0|0.75'", "WHEN wsr > 0.6 THEN 'Mostly whitespace (formatting file)|0|0.75'", "WHEN rep THEN 'Contains repeated patterns (likely generated)|0|0.75'"]
    case += [f"WHEN CASE WHEN (starts_with(tc, '{{') AND ends_with(tc, '}}')) OR (starts_with(tc, '[') AND ends_with(tc, ']')) THEN NOT {_any('content', values.CODE)} AND length(content) > 5000 ELSE contains(content, ',') AND len(ls) > 50 AND com10 > 30 END THEN 'Appears to be data/configuration content|0|0.75'"]
    case += ["WHEN bin > 0.1 THEN 'Binary content|0|1.0'"]
    return f"""WITH {_FILES_SQL}, {_LINES_SQL}, lt AS (SELECT path, {_sql_trim('line')} AS t FROM l), cnt AS (SELECT path, t, count(*) AS n FROM lt WHERE t <> '' GROUP BY ALL),
mx AS (SELECT path, max(n) AS most, sum(n) AS total FROM cnt GROUP BY path),
x AS (SELECT f.path, content, lower(rel_path) AS lp, lower(string_split(rel_path, '/')[-1]) AS nm, string_split(content, chr(10)) AS ls, {_sql_trim('content')} AS tc,
 len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches({tr}, '^(?://|#|/\\*|\\*|<!--)')))::DOUBLE / len(string_split(content, chr(10))) AS com,
 coalesce(len(regexp_extract_all(content, '{W}'))::DOUBLE / nullif(length(content), 0), 0) AS wsr, coalesce(len(regexp_extract_all(left(content, 1000), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]'))::DOUBLE / nullif(least(length(content), 1000), 0), 0) AS bin,
 length(array_to_string(string_split(content, chr(10))[1:10], chr(10))) - length(replace(array_to_string(string_split(content, chr(10))[1:10], chr(10)), ',', '')) AS com10, most, total FROM f LEFT JOIN mx USING (path)),
y AS (SELECT *, CASE WHEN len(ls) < 20 THEN false WHEN regexp_matches(content, 'export class (?:Logger|Utils|Helper)') OR (contains(content, 'debug(') AND contains(content, 'info(') AND contains(content, 'warn(') AND contains(content, 'error(')) THEN false ELSE coalesce(most > 10 AND most::DOUBLE / total > 0.2, false) END AS rep FROM x),
z AS (SELECT path, CASE {' '.join(case)} ELSE 'Source code file|1|0.8' END AS r FROM y)
SELECT path, split_part(r, '|', 2) = '1' AS include, split_part(r, '|', 1) AS reason, CAST(split_part(r, '|', 3) AS DOUBLE) AS confidence FROM z"""


@query(_cascade_sql())
def filter_cascade(spark, d):
    return _latest(spark, d, filters.cascade().alias("r")).select("path", "r.include", "r.reason", F.col("r.confidence").cast("double").alias("confidence"))


@query(f"WITH r AS ({_cascade_sql()}) SELECT reason, include, count(*) AS files FROM r GROUP BY ALL")
def filter_reasons(spark, d):
    return _latest(spark, d, filters.cascade().alias("r")).groupBy(F.col("r.reason").alias("reason"), F.col("r.include").alias("include")).agg(F.count("*").alias("files"))


@query(f"SELECT doc_id, round(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches({_sql_trim('x')}, '^(?://|#|/\\*|\\*|<!--)')))::DOUBLE / len(string_split(text, chr(10))), 6) AS comments, round(coalesce(len(regexp_extract_all(text, '{W}'))::DOUBLE / nullif(length(text), 0), 0), 6) AS blanks FROM documents WHERE text IS NOT NULL")
def quality_ratios(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select("doc_id", F.round(filters.comment_ratio(t), 6).alias("comments"), F.round(filters.whitespace_ratio(t), 6).alias("blanks"))


@query(f"WITH l AS (SELECT doc_id, {_sql_trim('u.line')} AS t FROM documents, unnest(string_split(text, chr(10))) AS u(line) WHERE text IS NOT NULL), n AS (SELECT doc_id, t, count(*) AS n FROM l WHERE t <> '' GROUP BY ALL), m AS (SELECT doc_id, max(n) AS most, sum(n) AS n FROM n GROUP BY doc_id) SELECT doc_id, CAST(coalesce(most, 0) AS INT) AS most, CAST(coalesce(n, 0) AS INT) AS n FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN m USING (doc_id)")
def repeated_lines(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", filters.repeated_share(F.col("text")).alias("r")).select("doc_id", "r.*")


def _hints_sql() -> str:
    per = {k: " + ".join(f"CASE WHEN regexp_matches(h, {_q(p)}) THEN {w} ELSE 0 END" for lang, p, w in values.HINTS if lang == k) for k in values.HINTED}
    return "".join(f", round(({v})::DOUBLE, 6) AS s_{k}" for k, v in per.items())


def _detect_sql() -> str:
    best = "CASE " + " ".join(f"WHEN s_{k} = m THEN '{k}'" for k in values.HINTED) + " END"
    ext = "CASE e " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in values.LANGUAGE_OF.items()) + " ELSE 'text' END"
    conf = "CASE e " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in values.LANGUAGE_OF.items()) + " ELSE 0.1 END::DOUBLE"
    kinds = " ".join(f"WHEN {_any('nm', p)} OR {_any('lp', p)} THEN '{k}'" for k, p in values.TYPES) + " " + " ".join(f"WHEN {_any('lp', p)} THEN '{k}'" for k, p in values.FOLDERS)
    return f"""WITH {_FILES_SQL}, h AS (SELECT path, lower(rel_path) AS lp, lower(string_split(rel_path, '/')[-1]) AS nm, lower(regexp_extract(string_split(rel_path, '/')[-1], '^.+(\\.[^.]*)$', 1)) AS e, array_to_string(string_split(coalesce(content, ''), chr(10))[1:50], chr(10)) AS h FROM f),
s AS (SELECT *{_hints_sql()} FROM h), b AS (SELECT *, greatest({', '.join('s_' + k for k in values.HINTED)}) AS m, {ext} AS el, {conf} AS ec FROM s), g AS (SELECT *, {best} AS bl, least(m, 0.8) AS sure FROM b)
SELECT path, CASE WHEN m > 0 AND sure > ec THEN bl ELSE el END AS language, round(CASE WHEN m > 0 AND sure > ec THEN sure WHEN m > 0 AND bl = el THEN least(1.0, ec + 0.3 * sure) ELSE ec END, 6) AS confidence, CASE {kinds} ELSE 'source' END AS file_type FROM g"""


@query(_detect_sql())
def detect_language(spark, d):
    return _latest(spark, d, language.detect("rel_path", "content").alias("d")).select("path", "d.*")


# --- chunks ------------------------------------------------------------------------------


def _windows_sql(table_sql: str, path: str, content: str, size: int) -> str:
    return f"""{table_sql}w AS (SELECT {path} AS path, ls, unnest(generate_series(0, len(ls) - 1, {size})) AS s FROM (SELECT {path}, string_split({content}, chr(10)) AS ls FROM src WHERE {content} IS NOT NULL)),
x AS (SELECT path, CAST(s + 1 AS INT) AS start_line, CAST(least(s + {size}, len(ls)) AS INT) AS end_line, array_to_string(ls[s + 1 : s + {size}], chr(10)) AS content FROM w)
SELECT path, 'chunk_' || substr(sha256(path || ':' || start_line || ':' || content), 1, 16) AS id, start_line, end_line, content FROM x WHERE {_sql_trim('content')} <> ''"""


@query(_windows_sql(f"WITH {_FILES_SQL}, src AS (SELECT * FROM f), ", "path", "content", 100))
def line_windows_100(spark, d):
    return C.windows(_files(spark, d), 100)


@query(_windows_sql("WITH src AS (SELECT CAST(doc_id AS VARCHAR) AS p, text FROM documents), ", "p", "text", 10))
def line_windows_10(spark, d):
    return C.windows(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), 10)


@query(f"WITH {_FILES_SQL} SELECT path, left(string_split(string_split(path, '/')[-1], '.')[1] || '_' || substr(md5(path), 1, 8) || '_' || '1-' || len(string_split(content, chr(10))), 60) AS id FROM f WHERE content IS NOT NULL")
def short_ids(spark, d):
    return _latest(spark, d, F.size(X.lines("content")).alias("n")).where("n is not null").select("path", X.short_id("path", F.concat(F.lit("1-"), F.col("n").cast("string"))).alias("id"))


_SECTION_CASE = f"""CASE WHEN regexp_matches(t, '^(?:import|export){W}+') THEN CASE WHEN starts_with(t, 'export') THEN 'export' ELSE 'import' END
 WHEN regexp_matches(t, '^(?:interface|type|enum|const|let|var){W}+') AND depth = 0 THEN CASE WHEN regexp_matches(t, '^(?:interface|type)') THEN 'interface' ELSE 'header' END
 WHEN regexp_matches(t, '^(?:export{W}+)?class{W}+\\w+') THEN 'class'
 WHEN regexp_matches(t, '^(?:export{W}+)?(?:async{W}+)?function{W}+\\w+') OR regexp_matches(t, '^{W}*\\w+{W}*\\([^)]*\\){W}*[:{{]') OR regexp_matches(t, '^(?:public|private|protected){W}+\\w+{W}*\\(') THEN 'function'
 WHEN regexp_matches(t, '^(?:/\\*\\*|//|{W}*\\*)') THEN 'comment' ELSE 'other' END"""
_SECTIONS_SQL = f"""WITH {_CHUNKS_SQL}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM c WHERE content IS NOT NULL),
a AS (SELECT *, {_sql_trim('line')} AS t, sum(length(line) - length(replace(line, '{{', '')) - length(line) + length(replace(line, '}}', ''))) OVER (PARTITION BY id ORDER BY n) AS depth FROM l),
b AS (SELECT *, {_SECTION_CASE} AS type FROM a), e AS (SELECT *, CASE WHEN (depth = 0 AND t IN ('}}', '')) OR regexp_matches(t, '^(?:/\\*\\*|export|class|interface|function)') OR coalesce(lag(type) OVER (PARTITION BY id ORDER BY n) <> type, true) THEN 1 ELSE 0 END AS new FROM b),
r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY n) AS section FROM e)"""


@query(_SECTIONS_SQL + " SELECT id, CAST(section AS INT) AS section, arg_min(type, n) AS type, CAST(min(n) AS INT) AS start_line, CAST(max(n) AS INT) AS end_line, string_agg(line, chr(10) ORDER BY n) AS content, CASE arg_min(type, n) WHEN 'import' THEN 10 WHEN 'export' THEN 9 WHEN 'interface' THEN 8 WHEN 'class' THEN 7 WHEN 'function' THEN 6 WHEN 'header' THEN 5 WHEN 'comment' THEN 3 ELSE 1 END AS priority FROM r GROUP BY id, section")
def sections_islands(spark, d):
    return C.sections(_chunks(spark, d))


@query(f"""WITH {_CHUNKS_SQL} SELECT id, unnest(list_distinct(list_filter(list_concat(regexp_extract_all(content, 'from{W}+[''"]([^''"]+)[''"]', 1), regexp_extract_all(content, '(\\w+){W}*\\(', 1)), lambda x: x <> ''))) AS dependency FROM c WHERE content IS NOT NULL""")
def section_dependencies(spark, d):
    return _chunks(spark, d).where("content is not null").select("id", F.explode(C.dependencies("content")).alias("dependency"))


@query()
def subchunk_pack(spark, d):
    return C.sub_chunks(_chunks(spark, d).where("content is not null").select("id", "content"))


@query()
def subchunk_quality(spark, d):
    return C.quality(subchunk_pack(spark, d))


_FIRST_LINE = f"regexp_matches(t, '^(?:export{W}+)?(?:class|interface|enum){W}+\\w+') OR regexp_matches(t, '^(?:export{W}+)?(?:async{W}+)?function{W}+\\w+') OR regexp_matches(t, '^(?:export{W}+)?(?:const|let|var){W}+\\w+{W}*=') OR regexp_matches(t, '^class{W}+\\w+{W}*(?:\\(.*\\))?:') OR regexp_matches(t, '^(?:async{W}+)?def{W}+\\w+{W}*\\(') OR regexp_matches(t, '^@\\w+')"


def _adaptive_sql(size: int, overlap: int) -> str:
    most = f"greatest(len(list_filter(starts, lambda x: x <= starts[a + 1] + {size})) - 1, a + 1)"
    half = lambda marks: f"list_max(list_filter({marks}, lambda m: m > a AND m <= most AND starts[m + 1] >= starts[a + 1] + {size // 2}))"
    end = f"CASE WHEN most >= n THEN n ELSE coalesce({half('begins')}, {half('closes')}, most) END"
    after = f"least(b, greatest(a + 1, len(list_filter(starts, lambda x: x < starts[b + 1] - {overlap}))))"
    placed = lambda rows: f"SELECT path, win, a, {end} AS b FROM (SELECT *, {most} AS most FROM ({rows}))"
    return f"""WITH RECURSIVE {_FILES_SQL}, {_LINES_SQL}, t AS (SELECT path, line_no, length(line) + 1 AS w, {_sql_trim('line')} AS t FROM l), k AS (SELECT path, line_no, t, sum(w) OVER (PARTITION BY path ORDER BY line_no) AS upto, {_FIRST_LINE} AS begin_ FROM t),
m AS MATERIALIZED (SELECT path, count(*) AS n, list_prepend(0, list(CAST(upto AS BIGINT) ORDER BY line_no)) AS starts, coalesce(list(line_no - 1 ORDER BY line_no) FILTER (begin_), []) AS begins, coalesce(list(line_no ORDER BY line_no) FILTER (t IN ('', '}}')), []) AS closes FROM k GROUP BY path),
r AS ({placed('SELECT path, 0 AS win, 0 AS a, n, starts, begins, closes FROM m')} UNION ALL {placed(f'SELECT path, win + 1 AS win, {after} AS a, n, starts, begins, closes FROM r JOIN m USING (path) WHERE b < n')})
SELECT path, CAST(win AS INT) AS "window", CAST(a + 1 AS INT) AS start_line, CAST(b AS INT) AS end_line, starts[a + 1] AS start_offset, starts[b + 1] AS end_offset FROM r JOIN m USING (path)"""


@query(_adaptive_sql(6000, 500))
def adaptive_windows(spark, d):
    return C.adaptive_windows(_files(spark, d), size=6000, overlap=500)


@query(_windows_sql(f"WITH {_FILES_SQL}, src AS (SELECT * FROM f), ", "path", "content", 50).rsplit(" WHERE ", 1)[0])
def line_windows_50_with_blanks(spark, d):
    return C.windows(_files(spark, d), 50, keep_blank=True)


_BOUNDARY_SQL = f"""b AS (SELECT path, CAST(line_no AS INT) AS line_no, {_sql_trim('line')} AS t FROM l)
SELECT * FROM (SELECT path, line_no, CASE WHEN regexp_matches(t, '^(?:export{W}+)?(?:class|interface|enum){W}+\\w+') THEN regexp_extract(t, '^(?:export{W}+)?(class|interface|enum)', 1) WHEN regexp_matches(t, '^(?:export{W}+)?(?:async{W}+)?function{W}+\\w+') THEN 'function'
 WHEN regexp_matches(t, '^(?:export{W}+)?(?:const|let|var){W}+\\w+{W}*=') THEN 'variable' WHEN regexp_matches(t, '^class{W}+\\w+{W}*(?:\\(.*\\))?:') THEN 'class' WHEN regexp_matches(t, '^(?:async{W}+)?def{W}+\\w+{W}*\\(') THEN 'function' WHEN regexp_matches(t, '^@\\w+') THEN 'decorator' END AS type,
 nullif(CASE WHEN regexp_matches(t, '^(?:export{W}+)?(?:class|interface|enum){W}+\\w+') THEN regexp_extract(t, '^(?:export{W}+)?(?:class|interface|enum){W}+(\\w+)', 1) WHEN regexp_matches(t, '^(?:export{W}+)?(?:async{W}+)?function{W}+\\w+') THEN regexp_extract(t, 'function{W}+(\\w+)', 1)
 WHEN regexp_matches(t, '^(?:export{W}+)?(?:const|let|var){W}+\\w+{W}*=') THEN regexp_extract(t, '^(?:export{W}+)?(?:const|let|var){W}+(\\w+)', 1) WHEN regexp_matches(t, '^class{W}+\\w+{W}*(?:\\(.*\\))?:') THEN regexp_extract(t, '^class{W}+(\\w+)', 1) WHEN regexp_matches(t, '^(?:async{W}+)?def{W}+\\w+{W}*\\(') THEN regexp_extract(t, 'def{W}+(\\w+)', 1) END, '') AS name FROM b) WHERE type IS NOT NULL"""


@query(f"WITH {_FILES_SQL}, {_LINES_SQL}, {_BOUNDARY_SQL}")
def boundaries_scan(spark, d):
    return C.boundaries(C.line_rows(_files(spark, d), ["path"]))


_IMPORTS_SQL = f"""t AS (SELECT path, CAST(line_no AS INT) AS line_no, {_sql_trim('line')} AS t FROM l), im AS (SELECT path, line_no, CASE WHEN starts_with(t, 'import ') THEN coalesce(nullif(regexp_extract(t, 'from{W}+[''"]([^''"]+)[''"]', 1), ''), 'unknown') WHEN starts_with(t, 'from ') AND contains(t, ' import ') THEN nullif(regexp_extract(t, 'from{W}+(\\S+){W}+import{W}+.+', 1), '') END AS module FROM t)"""


@query(f"WITH {_FILES_SQL}, {_LINES_SQL}, {_IMPORTS_SQL} SELECT * FROM im WHERE module IS NOT NULL")
def imports_scan(spark, d):
    return C.imports(C.line_rows(_files(spark, d), ["path"])).drop("symbols")


@query(f"WITH {_FILES_SQL}, {_LINES_SQL} SELECT path, CAST(line_no AS INT) AS line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" FROM l")
def running_offsets(spark, d):
    return C.offsets(_files(spark, d)).drop("line")


@query(f"WITH {_FILES_SQL}, {_LINES_SQL} SELECT path, CAST(line_no AS INT) AS line_no, CAST(sum(length(replace(line, '}}', '')) - length(replace(line, '{{', ''))) OVER (PARTITION BY path ORDER BY line_no) AS BIGINT) AS depth FROM l")
def brace_depth(spark, d):
    return C.depths(_files(spark, d))


@query(f"WITH {_CHUNKS_SQL} SELECT id, CASE WHEN n < 20 AND b < 3 THEN 'low' WHEN n < 100 AND b < 10 THEN 'medium' ELSE 'high' END AS complexity FROM (SELECT id, len(string_split(content, chr(10))) AS n, length(content) - length(replace(content, '{{', '')) AS b FROM c WHERE content IS NOT NULL)")
def chunk_complexity(spark, d):
    return _chunks(spark, d).where("content is not null").select("id", C.complexity("content").alias("complexity"))


#: Stored symbols as ranges: 40 characters a line.
_UNITS_SQL = "u AS (SELECT path, s, e, t, row_number() OVER (PARTITION BY path ORDER BY s, e, t NULLS FIRST) AS n FROM (SELECT DISTINCT path, type AS t, CAST(start_line AS BIGINT) * 40 AS s, CAST(end_line AS BIGINT) * 40 AS e FROM symbols WHERE path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL))"


@query(f"""WITH RECURSIVE {_UNITS_SQL}, r AS (SELECT path, n, s, e, t, 0 AS unit FROM u WHERE n = 1 UNION ALL
 SELECT path, n, CASE WHEN near THEN ps ELSE s END, CASE WHEN near THEN greatest(pe, e) ELSE e END, CASE WHEN near THEN 'mixed' ELSE t END, unit + CASE WHEN near THEN 0 ELSE 1 END
 FROM (SELECT u.*, r.s AS ps, r.e AS pe, r.unit, u.s - r.e < 100 AND u.e - r.s <= 1500 AS near FROM r JOIN u ON u.path = r.path AND u.n = r.n + 1))
SELECT path, unit, arg_max(s, n) AS start_idx, arg_max(e, n) AS end_idx, arg_max(t, n) AS type FROM r GROUP BY path, unit""")
def unit_merge_fold(spark, d):
    place = lambda c: (F.col(c).cast("bigint") * 40)
    stored = table(spark, d, "symbols").where("path is not null and start_line is not null and end_line is not null")
    return C.merge_units(stored.select("path", "type", place("start_line").alias("start_idx"), place("end_line").alias("end_idx")).distinct())


@query()
def semantic_chunks(spark, d):
    return units.semantic_chunks(_files(spark, d))


@query(
    _SECTIONS_SQL + """, s AS (SELECT id, CAST(section AS INT) AS section, arg_min(type, n) AS type, min(n) AS a, max(n) AS b FROM r GROUP BY id, section), y AS (SELECT id, start_line AS first, unnest(symbols) AS x FROM c),
k AS (SELECT s.id, s.section, count(x) AS n FROM s LEFT JOIN y ON y.id = s.id AND x.start_line - first + 1 BETWEEN a AND b GROUP BY ALL)
SELECT id, section, CAST(n AS INT) AS symbols, least(10, CASE type WHEN 'import' THEN 10 WHEN 'export' THEN 9 WHEN 'interface' THEN 8 WHEN 'class' THEN 7 WHEN 'function' THEN 6 WHEN 'header' THEN 5 WHEN 'comment' THEN 3 ELSE 1 END + CASE WHEN n > 3 THEN 2 ELSE 0 END) AS priority FROM s JOIN k USING (id, section)""")
def section_symbols(spark, d):
    """The sections of chunks with how many of the chunk's symbols begin in them."""
    own = F.transform(F.coalesce("symbols", F.array()), lambda x: x.withField("start_line", x["start_line"] - F.col("start_line") + 1))
    rows = _chunks(spark, d).where("content is not null").select("id", F.explode(symbols.in_sections(C.section_array(F.col("content")), own)).alias("s"))
    return rows.select("id", "s.section", F.size("s.symbols").alias("symbols"), "s.priority")


@query(_SECTIONS_SQL + f""", s AS (SELECT id, CAST(section AS INT) AS section, string_agg(line, chr(10) ORDER BY n) AS content FROM r GROUP BY id, section), y AS (SELECT DISTINCT id, unnest(list_transform(imports, lambda x: x.module)) AS module FROM c)
SELECT s.id, section, module FROM s JOIN y USING (id) WHERE module IS NOT NULL AND (contains(content, module) OR list_contains(list_concat(regexp_extract_all(content, 'from{W}+[''"]([^''"]+)[''"]', 1), regexp_extract_all(content, '(\\w+){W}*\\(', 1)), module))""")
def section_imports(spark, d):
    """The imports of a chunk that each of its sections depends on."""
    rows = _chunks(spark, d).where("content is not null").select("id", F.coalesce("imports", F.array()).alias("imports"), F.explode(C.section_array(F.col("content"))).alias("s"))
    needed = symbols.needed(F.col("imports"), C.dependencies(F.col("s.content")), F.col("s.content"))
    return rows.select("id", "s.section", F.explode(F.array_distinct(F.transform(needed, lambda i: i["module"]))).alias("module")).where("module is not null")


@query(f"SELECT doc_id, {_cut_sql('text', 1000)} AS text FROM documents WHERE text IS NOT NULL")
def truncate_embed_input(spark, d):
    """Every document with a text: characters are code points on both sides."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.truncate("text", 1000).alias("text"))


# --- symbols and joins -------------------------------------------------------------------

_SYMBOLS_SQL = "s AS (SELECT DISTINCT path, name, type, start_line, end_line, scope FROM symbols WHERE type IN ('function', 'class', 'interface', 'type', 'variable', 'method', 'enum', 'namespace', 'module'))"


def _symbols(spark, d):
    return table(spark, d, "symbols").select("path", "name", "type", "start_line", "end_line", "scope").distinct()


@query(f"WITH {_CHUNKS_SQL}, {_SYMBOLS_SQL} SELECT c.id, s.name, s.type, s.start_line, s.end_line, s.scope FROM c JOIN s ON s.path = c.file_path AND s.start_line >= c.start_line AND s.end_line <= c.end_line")
def symbol_chunk_containment(spark, d):
    return symbols.in_chunks(_chunks(spark, d), _symbols(spark, d))


@query(f"WITH {_CHUNKS_SQL}, {_SYMBOLS_SQL}, j AS (SELECT c.id, count(s.name) AS n FROM c LEFT JOIN s ON s.path = c.file_path AND s.start_line >= c.start_line AND s.end_line <= c.end_line GROUP BY c.id) SELECT id, CAST(n AS INT) AS symbols FROM j")
def symbols_per_chunk(spark, d):
    return symbols.assign(_chunks(spark, d), _symbols(spark, d)).select("id", F.size("symbols").alias("symbols"))


@query(f"WITH {_FILES_SQL}, {_LINES_SQL}, {_IMPORTS_SQL}, {_CHUNKS_SQL} SELECT c.id, im.module, im.line_no FROM c JOIN im ON im.path = c.file_path AND im.line_no <= c.end_line WHERE module IS NOT NULL")
def import_chunk_inequality(spark, d):
    return symbols.visible_imports(_chunks(spark, d), C.imports(C.line_rows(_files(spark, d), ["path"])))


@query(f"WITH {_CHUNKS_SQL}, e AS (SELECT DISTINCT id, unnest(exports) AS name FROM c), s AS (SELECT DISTINCT id, unnest(list_transform(symbols, lambda x: x.name)) AS name FROM c) SELECT id, name FROM e SEMI JOIN s USING (id, name)")
def export_semijoin(spark, d):
    return symbols.exported(_chunks(spark, d))


@query(f"""WITH {_CHUNKS_SQL}, i AS (SELECT DISTINCT file_path, unnest(list_transform(imports, lambda x: x.module)) AS m FROM c WHERE file_path IS NOT NULL), e AS (SELECT DISTINCT file_path, unnest(exports) AS m FROM c WHERE file_path IS NOT NULL),
p AS (SELECT DISTINCT file_path FROM c WHERE file_path IS NOT NULL), ia AS (SELECT file_path, list_sort(list(m))[1:5] AS a FROM i GROUP BY file_path), ea AS (SELECT file_path, list_sort(list(m))[1:5] AS a FROM e GROUP BY file_path)
SELECT file_path, coalesce(array_to_string(ia.a, ','), '') AS imports, coalesce(array_to_string(ea.a, ','), '') AS exports FROM p LEFT JOIN ia USING (file_path) LEFT JOIN ea USING (file_path)""")
def file_connections(spark, d):
    return symbols.connections(_chunks(spark, d)).select("file_path", F.array_join("imports", ",").alias("imports"), F.array_join("exports", ",").alias("exports"))


@query(f"""WITH {_FILES_SQL}, {_LINES_SQL}, y AS (SELECT DISTINCT path, name, start_line FROM symbols WHERE start_line >= 1), a AS (SELECT path, line_no, regexp_matches({_sql_trim('line')}, '^(?://|/\\*|\\*|#|@)') AS told,
 sum(length(replace(line, '}}', '')) - length(replace(line, '{{', ''))) OVER (PARTITION BY path ORDER BY line_no) AS depth FROM l),
b AS (SELECT y.path, name, start_line, max(line_no) FILTER (line_no < start_line AND NOT told) AS above, min(line_no) FILTER (line_no BETWEEN start_line AND start_line + 50 AND depth <= was) AS closed, least(start_line + 50, max(line_no)) AS furthest
 FROM (SELECT y.*, coalesce(p.depth, 0) AS was FROM y LEFT JOIN a p ON p.path = y.path AND p.line_no = y.start_line - 1) y JOIN a ON a.path = y.path GROUP BY y.path, name, start_line, was HAVING start_line <= max(line_no))
SELECT path, name, start_line, CAST(coalesce(above, 0) + 1 AS INT) AS first, CAST(coalesce(closed, furthest) AS INT) AS last FROM b""")
def logical_units(spark, d):
    """Stored symbols widened to their comments and blocks."""
    return C.logical_units(_files(spark, d), table(spark, d, "symbols").select("path", "name", "start_line").distinct())


@query()
def symbols_python(spark, d):
    return units.symbols(_files(spark, d), ("python",))


@query()
def symbols_typescript(spark, d):
    return units.symbols(_files(spark, d), ("typescript", "javascript"))


def _scan_sql() -> str:
    kind = " ".join(f"WHEN regexp_matches(t, {_q(p)}) THEN '{k}'" for p, k in values.DECLARATIONS)
    name = " ".join(f"WHEN regexp_matches(t, {_q(p)}) THEN regexp_extract(t, {_q(p)}, 1)" for p, _ in values.DECLARATIONS)
    return f"WITH {_FILES_SQL}, {_LINES_SQL}, t AS (SELECT path, CAST(line_no AS INT) AS line_no, {_sql_trim('line')} AS t FROM l) SELECT * FROM (SELECT path, line_no, CASE {kind} END AS type, CASE {name} END AS name FROM t) WHERE type IS NOT NULL"


@query(_scan_sql())
def symbols_scan(spark, d):
    return symbols.scan(C.line_rows(_files(spark, d), ["path"]))


# --- store, catalog, change detection ----------------------------------------------------


@query(f"WITH {_FILES_SQL} SELECT path, sha256(coalesce(content, '')) AS content_hash, 'mcp_' || substr(md5(path || 'key'), 1, 16) AS namespace_id FROM f")
def content_hashes(spark, d):
    return _latest(spark, d, F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash")).select("path", "content_hash", X.namespace_id("path", "key").alias("namespace_id"))


@query("SELECT id, left(hash, 4) || repeat('*', CAST(length(hash) - 8 AS INT)) || right(hash, 4) AS masked FROM api_key")
def mask_keys(spark, d):
    return table(spark, d, "api_key").select("id", X.mask("hash").alias("masked"))


_OLD_SQL = "o AS (SELECT * EXCLUDE (_h) FROM (SELECT *, coalesce(md5(content), '') AS _h FROM source_files WHERE path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime NULLS FIRST, _h) = 1)"


@query(f"""WITH {_FILES_SQL}, {_OLD_SQL}, n AS (SELECT path, content FROM f WHERE namespace IS DISTINCT FROM (SELECT min(name) FROM namespace_owner)), k AS (SELECT path, content FROM o WHERE language IS NOT NULL)
SELECT path, CASE WHEN k.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT coalesce(n.path, k.path) AS path FROM n FULL JOIN k ON n.path = k.path) a LEFT JOIN n USING (path) LEFT JOIN k USING (path)
WHERE k.path IS NULL OR n.path IS NULL OR coalesce(n.content, '') <> coalesce(k.content, '')""")
def cdc_changes(spark, d):
    """The latest files without one repository against their oldest states in a known language."""
    rows = table(spark, d, "source_files")
    gone = table(spark, d, "namespace_owner").agg(F.min("name")).scalar()
    now = _files(spark, d).where(~F.col("namespace").eqNullSafe(gone))
    aged = rows.withColumns({"_t": F.coalesce(F.col("mtime").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")), "_h": F.coalesce(F.md5("content"), F.lit(""))})
    old = aged.where("path is not null").groupBy("path").agg(F.min_by(F.struct("language", "mtime", "content"), F.struct("_t", "_h")).alias("r")).select("path", "r.*").where("language is not null")
    return store.changes(now.withColumn("content", F.coalesce("content", F.lit(""))), store.state(old.withColumn("content", F.coalesce("content", F.lit("")))))


_STORED_SQL = f"{_CHUNKS_SQL}, st AS (SELECT id, md5(coalesce(content, '')) AS h FROM c WHERE language IS NOT NULL), nw AS (SELECT id, max(md5(coalesce(relative_path, ''))) AS h FROM vectors WHERE id IS NOT NULL GROUP BY id)"


def _stored(spark, d):
    """A store of the chunks in a known language, and the vectors' rows to bring into it."""
    now = _chunks(spark, d).where("language is not null").select("id", F.md5(F.coalesce("content", F.lit(""))).alias("h"))
    return now, store.latest(table(spark, d, "vectors").select("id", F.md5(F.coalesce("relative_path", F.lit(""))).alias("h")), "id", ["h"])


@query(f"WITH {_STORED_SQL} SELECT id, coalesce(nw.h, st.h) AS h FROM st FULL JOIN nw USING (id)")
def upsert_latest(spark, d):
    """Stored rows replaced where their id comes again, new ids inserted, others kept."""
    return store.upsert(*_stored(spark, d))


@query(f"WITH {_STORED_SQL} SELECT id, coalesce(st.h, nw.h) AS h FROM st FULL JOIN nw USING (id)")
def insert_missing(spark, d):
    return store.insert_missing(*_stored(spark, d), "id")


@query(f"WITH {_FILES_SQL}, {_CHUNKS_SQL}, i AS (SELECT file_path AS path, string_agg(id, ',' ORDER BY id) AS ids FROM c WHERE file_path IS NOT NULL GROUP BY file_path) SELECT path, CAST(length(content) AS BIGINT) AS size, sha256(coalesce(content, '')) AS content_hash, coalesce(ids, '') AS chunk_ids FROM f LEFT JOIN i USING (path)")
def file_state(spark, d):
    """What is remembered of each file, with the ids of its chunks."""
    states = _latest(spark, d, F.col("mtime").alias("last_modified"), F.length("content").cast("bigint").alias("size"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
    return store.with_chunk_ids(states, _chunks(spark, d).where("file_path is not null")).select("path", "size", "content_hash", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query(f"WITH {_FILES_SQL} SELECT path, strlen(content) AS bytes, CAST(epoch_us(mtime) AS BIGINT) AS mtime, coalesce(mtime > (SELECT min(mtime) + INTERVAL 400 DAY FROM source_files), true) AS recent, CASE WHEN starts_with(path, '/srv/checkouts/') THEN substr(path, 16) ELSE path END AS rel FROM f")
def file_stats(spark, d):
    """Size, time, relative path, and whether a file is newer than a day some time after the first."""
    since = table(spark, d, "source_files").agg(F.min("mtime") + F.expr("interval 400 days")).scalar()
    rows = _latest(spark, d, F.octet_length("content").cast("bigint").alias("bytes"), F.col("mtime"))
    return rows.select("path", "bytes", F.unix_micros(F.col("mtime").cast("timestamp")).alias("mtime"), discovery.modified_since(F.col("mtime"), since).alias("recent"), X.relative("path", "/srv/checkouts").alias("rel"))


@query(f"""WITH {_FILES_SQL}, o AS (SELECT path, arg_min(mtime, coalesce(mtime, TIMESTAMP '0001-01-01')) AS mtime, arg_min(coalesce(strlen(content), 0), coalesce(mtime, TIMESTAMP '0001-01-01')) AS bytes FROM source_files WHERE path IS NOT NULL AND language IS NOT NULL AND mtime IS NOT NULL GROUP BY path),
n AS (SELECT path, mtime, coalesce(strlen(content), 0) AS bytes FROM f WHERE namespace IS DISTINCT FROM (SELECT min(name) FROM namespace_owner))
SELECT path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM n FULL JOIN o USING (path) WHERE o.path IS NULL OR n.path IS NULL OR o.mtime IS DISTINCT FROM n.mtime OR o.bytes <> n.bytes""".replace("CASE WHEN o.path IS NULL", "CASE WHEN o.bytes IS NULL").replace("WHEN n.path IS NULL THEN", "WHEN n.bytes IS NULL THEN").replace("WHERE o.path IS NULL OR n.path IS NULL", "WHERE o.bytes IS NULL OR n.bytes IS NULL"))
def touched_files(spark, d):
    """What a listing tells of the files against their oldest states, without their contents."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes")
    gone = table(spark, d, "namespace_owner").agg(F.min("name")).scalar()
    rows = table(spark, d, "source_files").select("path", "rel_path", "namespace", "language", "mtime", "content")
    now = store.latest_of(rows, "mtime", size, "namespace").where(~F.col("namespace").eqNullSafe(gone)).drop("namespace")
    first = rows.where("path is not null and language is not null and mtime is not null").groupBy("path").agg(F.min_by(F.struct(F.col("mtime").alias("last_modified"), size), "mtime").alias("r"))
    return store.touched(now, first.select("path", "r.*"))


@query("SELECT id FROM (SELECT DISTINCT id, file_path FROM chunks WHERE file_path = (SELECT min(file_path) FROM chunks)) WHERE id IS NOT NULL ORDER BY id LIMIT 1000")
def chunk_ids_of_file(spark, d):
    rows = _chunks(spark, d)
    return store.ids_of_file(rows, table(spark, d, "chunks").agg(F.min("file_path")).first()[0])


@query("SELECT DISTINCT id, api_key_id FROM api_event WHERE api_key_id IS NOT NULL AND api_key_id NOT IN (SELECT id FROM api_key)")
def dangling_keys(spark, d):
    """Events whose key isn't known."""
    return store.dangling(_events(spark, d).select("id", "api_key_id").distinct(), "api_key_id", table(spark, d, "api_key"), "id")


@query("SELECT DISTINCT language, language IN ('typescript', 'javascript', 'python') AS supported, CASE lower(language) WHEN 'typescript' THEN '.ts' WHEN 'javascript' THEN '.js' WHEN 'python' THEN '.py' WHEN 'java' THEN '.java' WHEN 'go' THEN '.go' END AS extension FROM source_files")
def languages_present(spark, d):
    return table(spark, d, "source_files").select("language", language.supported(F.col("language")).alias("supported"), language.primary_extension(F.col("language")).alias("extension")).distinct()


@query("SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM vectors WHERE id IS NOT NULL)")
def delete_by_ids(spark, d):
    return store.delete(table(spark, d, "chunks").where("id is not null").select("id").distinct(), table(spark, d, "vectors").where("id is not null"))


@query(f"""WITH {_CHUNKS_SQL}, {_FILES_SQL}, src AS (SELECT * FROM f WHERE language = 'go'), nw AS ({_windows_sql("", "path", "content", 50).replace("w AS (", "WITH w AS (", 1)})
SELECT id, file_path FROM c WHERE file_path NOT IN (SELECT path FROM src) UNION ALL SELECT id, path FROM nw""")
def replace_changed_files(spark, d):
    """The stored chunks after all files of one language were cut anew."""
    changed = _files(spark, d).where("language = 'go'")
    new = C.windows(changed, 50).select("id", F.col("path").alias("file_path"))
    return store.replace_files(_chunks(spark, d).select("id", "file_path").where("file_path is not null"), new, changed)


@query("SELECT name, name IN (SELECT namespace FROM vectors WHERE namespace IS NOT NULL) AS present FROM namespace_owner")
def namespaces_present(spark, d):
    known = table(spark, d, "vectors").where("namespace is not null").select(F.col("namespace").alias("name")).distinct().withColumn("present", F.lit(True))
    return table(spark, d, "namespace_owner").select("name").join(known, "name", "left").select("name", F.coalesce("present", F.lit(False)).alias("present"))


@query(f"WITH {_EVENTS_SQL} SELECT type, status_code, count(*) AS events, count(DISTINCT api_key_id) AS keys, grouping(type, status_code) AS level FROM ev GROUP BY CUBE (type, status_code)")
def usage_cube(spark, d):
    return _events(spark, d).cube("type", "status_code").agg(F.count("*").alias("events"), F.count_distinct("api_key_id").alias("keys"), F.grouping_id().alias("level"))


@query("SELECT DISTINCT namespace FROM vectors WHERE regexp_matches(namespace, '^mcp_[a-f0-9]{16}$') AND namespace NOT IN (SELECT namespace FROM source_files WHERE namespace IS NOT NULL AND language = 'python')")
def orphan_antijoin(spark, d):
    return store.orphans(table(spark, d, "vectors"), table(spark, d, "source_files").where("namespace is not null and language = 'python'"))


@query("SELECT o.id, o.name, o.root_path, k.hash FROM namespace_owner o JOIN api_key k ON k.id = o.api_key_id")
def owner_keys(spark, d):
    return table(spark, d, "namespace_owner").alias("o").join(table(spark, d, "api_key").alias("k"), F.col("o.api_key_id") == F.col("k.id")).select("o.id", "o.name", "o.root_path", "k.hash")


_CATALOG_SQL = f"WITH {_FILES_SQL}, cat AS (SELECT namespace AS path, count(*) AS total_chunks, max(mtime) AS indexed_at, count(content) = 0 AS failed FROM f WHERE namespace IS NOT NULL GROUP BY namespace)"


def _catalog(spark, d):
    return _files(spark, d).where("namespace is not null").groupBy(F.col("namespace").alias("path")).agg(F.count("*").alias("total_chunks"), F.max("mtime").alias("indexed_at"), (F.count("content") == 0).alias("failed"))


@query(_CATALOG_SQL + " SELECT count(*) AS codebases, count(*) FILTER (NOT failed) AS indexed, CAST(sum(total_chunks) AS BIGINT) AS chunks, round(avg(total_chunks), 6) AS mean_chunks, CAST(epoch_us(min(indexed_at)) AS BIGINT) AS first_indexed, CAST(epoch_us(max(indexed_at)) AS BIGINT) AS last_indexed FROM cat")
def catalog_stats(spark, d):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return store.statistics(_catalog(spark, d)).select("codebases", "indexed", "chunks", "mean_chunks", micros("first_indexed"), micros("last_indexed"))


# --- usage -------------------------------------------------------------------------------



def _events(spark, d):
    return usage.distinct_events(table(spark, d, "api_event"))


@query(f"WITH {_EVENTS_SQL} SELECT type, count(*) AS events, count(*) FILTER (status_code >= 400) AS failed, count(duration_ms) AS measured, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS longest_ms FROM ev GROUP BY type")
def usage_by_type(spark, d):
    return usage.by_type(_events(spark, d)).drop("about_keys")


@query(f"WITH {_EVENTS_SQL} SELECT id, TRY_CAST(m->>'requestBodyBytes' AS BIGINT) AS request_bytes, TRY_CAST(m->>'responseBytes' AS BIGINT) AS response_bytes, TRY_CAST(m->>'success' AS BOOLEAN) AS success FROM (SELECT id, TRY_CAST(metadata AS JSON) AS m FROM ev)")
def usage_json_metadata(spark, d):
    return usage.metadata(_events(spark, d))


@query(f"WITH {_EVENTS_SQL} SELECT CAST(epoch_us(time_bucket(INTERVAL '6 hours', created_at)) AS BIGINT) AS start, type, count(*) AS events FROM ev WHERE created_at IS NOT NULL GROUP BY ALL")
def usage_windows(spark, d):
    return usage.windowed(_events(spark, d), "6 hours").select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "type", "events")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM a)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(epoch_us(min(ts)) AS BIGINT) AS first, CAST(epoch_us(max(ts)) AS BIGINT) AS last, count(*) AS events FROM b GROUP BY user_id, session""")
def usage_sessions(spark, d):
    s = usage.sessions(table(spark, d, "events"), "user_id", 6 * 3600, "ts")
    return s.select("user_id", "session", F.unix_micros(F.col("first").cast("timestamp")).alias("first"), F.unix_micros(F.col("last").cast("timestamp")).alias("last"), "events")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_type, event_id, n, t AS opened, 1 AS used, true AS allowed FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.n, CASE WHEN e.t >= r.opened + 86400000000 THEN e.t ELSE r.opened END, CASE WHEN e.t >= r.opened + 86400000000 THEN 1 ELSE least(r.used + 1, 2) END, e.t >= r.opened + 86400000000 OR r.used < 2
 FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1)
SELECT event_id, allowed, used, 2 - used AS remaining FROM r""")
def rate_limit_fixed_window(spark, d):
    return usage.fixed_windows(table(spark, d, "events"), ["user_id", "event_type"], 2, 86_400, "ts", "event_id").select("event_id", "allowed", "used", "remaining")


_LIMIT_SQL = "CASE WHEN type IN ('TURBOPUFFER_QUERY', 'TURBOPUFFER_NAMESPACE_QUERY', 'TURBOPUFFER_HYBRID') THEN 3 ELSE 5 END"


@query(f"""WITH RECURSIVE {_EVENTS_SQL}, now_ AS (SELECT epoch_us(max(created_at)) AS now FROM api_event), e AS (SELECT api_key_id, type, epoch_us(created_at) AS t, {_LIMIT_SQL} AS lim, row_number() OVER (PARTITION BY api_key_id, type ORDER BY created_at, id) AS n FROM ev WHERE created_at IS NOT NULL),
r AS (SELECT api_key_id, type, n, lim, t AS opened, 1 AS used FROM e WHERE n = 1 UNION ALL SELECT e.api_key_id, e.type, e.n, e.lim, CASE WHEN e.t >= r.opened + 86400000000 THEN e.t ELSE r.opened END, CASE WHEN e.t >= r.opened + 86400000000 THEN 1 ELSE least(r.used + 1, e.lim) END
 FROM r JOIN e ON e.api_key_id IS NOT DISTINCT FROM r.api_key_id AND e.type IS NOT DISTINCT FROM r.type AND e.n = r.n + 1),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY api_key_id, type ORDER BY n DESC) = 1), o AS (SELECT *, now < opened + 86400000000 AS open FROM l, now_)
SELECT api_key_id, type, lim AS "limit", CASE WHEN open THEN used ELSE 0 END AS used, lim - CASE WHEN open THEN used ELSE 0 END AS remaining, CASE WHEN open THEN opened + 86400000000 END AS resets_at,
CASE WHEN open AND used >= lim THEN CAST(greatest(1, ceil((opened + 86400000000 - now) / 1000000)) AS BIGINT) END AS retry_after FROM o""")
def rate_limit_status(spark, d):
    """The open windows of every key and type at the time of the last event, a day long, with small limits."""
    rows = table(spark, d, "api_event")
    now = rows.agg(F.unix_micros(F.max("created_at").cast("timestamp"))).scalar()
    most = F.when(F.col("type").isin(*usage.SEARCHES), 3).otherwise(5)
    return usage.limit_status(_events(spark, d), ["api_key_id", "type"], most, 86_400, now)


@query("SELECT k.id AS api_key_id, t.type, CASE WHEN t.type IN ('TURBOPUFFER_QUERY', 'TURBOPUFFER_NAMESPACE_QUERY', 'TURBOPUFFER_HYBRID') THEN 200 ELSE 10000 END AS \"limit\", 86400 AS window_seconds FROM api_key k, (VALUES " + ", ".join(f"('{t}')" for t in usage.EVENT_TYPES) + ") t(type)")
def key_limits(spark, d):
    return usage.default_limits(table(spark, d, "api_key"), list(usage.EVENT_TYPES))


@query(f"WITH {_EVENTS_SQL} SELECT DISTINCT duration_ms, CASE WHEN duration_ms < 1000 THEN duration_ms || 'ms' WHEN duration_ms < 60000 THEN (duration_ms // 1000) || 's' ELSE (duration_ms // 60000) || 'm ' || (duration_ms // 1000 % 60) || 's' END AS words FROM ev WHERE duration_ms IS NOT NULL")
def durations_in_words(spark, d):
    return _events(spark, d).where("duration_ms is not null").select("duration_ms", X.duration(F.col("duration_ms")).alias("words")).distinct()


_STAMP = "regexp_extract(value, '^\\[([^\\]]+)\\]', 1)"
_DONE = "regexp_matches(value, 'Batch \\d+/\\d+ completed successfully')"


@query(f"""WITH g AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
a AS (SELECT file, bool_or(contains(value, 'Process completed with code: 0')) AS completed, bool_or(regexp_matches(value, 'No chunks generated|all files filtered out|parsing failures|Failed indexing attempt registered')) AS failed,
 arg_min({_STAMP}, line_no) FILTER ({_STAMP} <> '') AS started, arg_max({_STAMP}, line_no) FILTER ({_STAMP} <> '') AS ended, coalesce(max(TRY_CAST(regexp_extract(value, 'Uploaded (\\d+) chunks to namespace', 1) AS BIGINT)), 0) AS chunks,
 count(*) FILTER ({_DONE}) AS batches_done, coalesce(max(TRY_CAST(regexp_extract(value, 'Batch \\d+/(\\d+) completed successfully', 1) AS BIGINT)), 0) AS batches FROM g GROUP BY file),
b AS (SELECT * REPLACE (CASE WHEN batches = 0 AND chunks > 0 THEN CAST(ceil(chunks / 50) AS BIGINT) ELSE batches END AS batches) FROM a)
SELECT file, completed, failed, started, ended, chunks, batches_done, batches, coalesce(round(100.0::DOUBLE * batches_done / nullif(batches, 0), 2), 0) AS rate FROM b""")
def log_stats(spark, d):
    """Every document read as an indexing log; few are."""
    lines = C.line_rows(table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")), ["file"])
    return usage.log_statistics(lines.withColumnRenamed("line", "value"))


QUERIES.update(goldens.QUERIES)
ORACLE.update(goldens.ORACLE)
