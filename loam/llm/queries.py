"""The registered queries of the training-data operators and the SQL of those that have one."""

from __future__ import annotations

from loam.llm import docpairs, mixing, neighbours, percentiles, provenance, residue, split, syntax, tokenize
from loam.sources.tables import spread, table


def p1_percentiles(spark, d):
    summary = percentiles.grouped(table(spark, d, "api_event"))
    return percentiles.percentiles(summary, percentiles.LEVELS)


def p1_exact(spark, d):
    return percentiles.exact_by_level(table(spark, d, "api_event"))


def p2_found(spark, d):
    return p2_pairs(spark, d).select("path", "name", "start_line")


def p2_pairs(spark, d):
    return docpairs.documented_functions(spread(table(spark, d, "source_files")))


def p3_found(spark, d):
    return p3_pieces(spark, d).where("id is not null").select("id").distinct()


def p3_pieces(spark, d):
    return split.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunking_config"))


def p4_found(spark, d):
    return neighbours.pairs(neighbours.nearest(table(spark, d, "vectors")))


def p5_found(spark, d):
    return p5_files(spark, d).where("not include and label is not null").select("path")


def p5_files(spark, d):
    return provenance.classify(spread(table(spark, d, "source_files")))


def p6_found(spark, d):
    return syntax.check(spread(table(spark, d, "source_files"))).where("size(parse_errors) > 0").select("path")


def p6_rates(spark, d):
    return syntax.rates(syntax.check(spread(table(spark, d, "source_files"))))


def p7_ids(spark, d):
    return tokenize.encode(table(spark, d, "documents"))


def p8_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark, d):
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark, d):
    return p9_residue(spark, d).where("residue").select("doc_id")


def p9_residue(spark, d):
    return residue.examine(spread(table(spark, d, "documents")))


def p9_clean(spark, d):
    return residue.clean(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_exact, p2_found, p2_pairs, p3_found, p3_pieces, p4_found, p5_found, p5_files, p6_found, p6_rates, p7_ids, p8_mix, p8_shares, p9_found, p9_residue, p9_clean)}

_EVENTS = """WITH ev AS (SELECT DISTINCT id, type, api_key_id, created_at, CAST(duration_ms AS BIGINT) AS v FROM api_event WHERE duration_ms >= 0)"""
_RANKED = """, g AS (
  SELECT 'type' AS level, type, CAST(NULL AS INT) AS api_key_id, v FROM ev UNION ALL
  SELECT 'key', NULL, api_key_id, v FROM ev UNION ALL SELECT 'pair', type, api_key_id, v FROM ev),
l AS (SELECT level, type, api_key_id, list_sort(list(v)) AS vs, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT level, type, api_key_id, p, n, vs[greatest(1, CAST(ceil(n * p - 1e-9) AS BIGINT))] AS v
      FROM l, (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS p)),
w AS (SELECT *, CAST(1 AS BIGINT) << greatest(0, CASE WHEN v = 0 THEN 1 ELSE length(bin(v)) END - 8) AS w FROM r)"""

ORACLE = {
    "p1_percentiles": _EVENTS + _RANKED + " SELECT level, type, api_key_id, p, n, v // w * w AS low, v // w * w + w - 1 AS high, v // w * w + (w - 1) / 2 AS value, (w - 1) / 2 AS error FROM w",
    "p1_exact": _EVENTS + _RANKED + " SELECT level, type, api_key_id, p, n, v AS value FROM r",
    "p3_found": """WITH c AS (SELECT language, max(max_chunk_size) AS m FROM chunking_config GROUP BY language)
SELECT DISTINCT id FROM chunks LEFT JOIN c USING (language)
WHERE id IS NOT NULL AND length(content) > coalesce(c.m, (SELECT m FROM c WHERE language = 'default'))""",
}
