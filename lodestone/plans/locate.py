"""Queries of the further search legs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import safety
from ..functions.text import is_noisy_path, is_test_path
from ..operators import locate as L
from ..projections import rel
from ..registry import query
from ..sources import code as C
from .search import NEAR, bm25_sql
from .sources import CALLS, OWNED


def docs(spark, sf):
    return rel(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text", "lang")


def fused_sql(a: str, b: str, wa: float, wb: float, limit: int) -> str:
    """Rank fusion of two lists if both have rows, else the one that has; a and b: queries of (key, score)."""
    return f"""a0 AS ({a}), b0 AS ({b}), a1 AS (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM a0), b1 AS (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM b0),
        nn AS (SELECT (SELECT count(*) FROM a0) AS na, (SELECT count(*) FROM b0) AS nb), u AS (SELECT key, score, {wa} / (20 + rank) AS s FROM a1 WHERE rank <= {limit} UNION ALL SELECT key, score, {wb} / (20 + rank) FROM b1 WHERE rank <= {limit})
        SELECT key, round(CASE WHEN na > 0 AND nb > 0 THEN sum(s) ELSE sum(score) END, 9) AS score, na > {limit} OR nb > {limit} AS truncated FROM u, nn GROUP BY key, na, nb ORDER BY score DESC, key LIMIT {limit}"""


@query("s02_text_search", f"WITH en AS (SELECT * FROM documents WHERE lang = 'en'), rest AS (SELECT * FROM documents WHERE lang <> 'en'), {fused_sql('SELECT key, score FROM ' + bm25_sql('en', 'doc_id', 'text', ['the', 'of']), 'SELECT key, score FROM ' + bm25_sql('rest', 'doc_id', 'text', ['the', 'of']), 1.5, 1.0, 20)}")
def s02_text_search(spark, sf):
    d = docs(spark, sf)
    return L.text_search(d.where("lang = 'en'"), d.where("lang != 'en'"), "the of")


@query("s02_both_legs", f"WITH odd AS (SELECT * FROM documents WHERE doc_id % 2 = 1), even AS (SELECT * FROM documents WHERE doc_id % 2 = 0), {fused_sql('SELECT key, score FROM ' + bm25_sql('odd', 'doc_id', 'text', ['the', 'of']), 'SELECT key, score FROM ' + bm25_sql('even', 'doc_id', 'text', ['the', 'of']), 1.5, 1.0, 20)}")
def s02_both_legs(spark, sf):
    """Odd documents as docstrings, even ones as chunks."""
    d = docs(spark, sf)
    return L.text_search(d.where("key % 2 = 1"), d.where("key % 2 = 0"), "the of")


@query("s07_symbol_neighbours", f"WITH {NEAR}, t AS (SELECT *, max(place) OVER (PARTITION BY query_id) > 10 AS truncated FROM r WHERE place <= 11) SELECT query_id, qn, round(1 - distance, 9) AS score, truncated FROM t JOIN symbols ON qn = 'P' || vec_id WHERE place <= 10")
def s07_symbol_neighbours(spark, sf):
    v = rel(spark, sf, "embeddings")
    found = L.vector_results(v.where("vec_id % 100 = 0"), v, 10)
    return found.withColumn("qn", F.concat(F.lit("P"), "vec_id")).join(rel(spark, sf, "symbols").select("qn").hint("merge"), "qn").select("query_id", "qn", "score", "truncated")


@query("s08_chunk_neighbours", f"WITH {NEAR}, t AS (SELECT *, max(place) OVER (PARTITION BY query_id) > 5 AS truncated FROM r WHERE place <= 6) SELECT query_id, vec_id, source, round(1 - distance, 9) AS score, truncated FROM t JOIN documents ON doc_id = vec_id WHERE place <= 5")
def s08_chunk_neighbours(spark, sf):
    v = rel(spark, sf, "embeddings")
    found = L.vector_results(v.where("vec_id % 100 = 0"), v, 5)
    return found.join(rel(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id").select("query_id", "vec_id", "source", "score", "truncated")


@query("s09_chunk_results", """
    WITH c AS (SELECT p_partkey AS key, 'src/tests/m' || p_partkey || '.py' AS path, p_size AS line_start, CASE WHEN p_size % 3 = 0 THEN 'P' || p_partkey WHEN p_size % 3 = 1 THEN 'gone' || p_partkey END AS symbol_qn FROM part)
    SELECT key, coalesce(symbol_qn, c.path || '#' || c.line_start) AS id, coalesce(s.name, symbol_qn, 'm' || key || '.py') AS name, coalesce(s.is_test, true) AS is_test FROM c LEFT JOIN symbols s ON qn = symbol_qn""")
def s09_chunk_results(spark, sf):
    c = rel(spark, sf, "part").selectExpr("p_partkey as key", "'src/tests/m' || p_partkey || '.py' as path", "p_size as line_start", "case when p_size % 3 = 0 then 'P' || p_partkey when p_size % 3 = 1 then 'gone' || p_partkey end as symbol_qn")
    return L.chunk_results(c, rel(spark, sf, "symbols"))


_SIDE = "SELECT v.vec_id AS key, round(1 - round(1 - list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 9), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id = 0 AND v.vec_id % 2 = {} ORDER BY score DESC, key LIMIT 21"


@query("s10_semantic_search", f"WITH {fused_sql(_SIDE.format(0), _SIDE.format(1), 1.0, 1.0, 20)}")
def s10_semantic_search(spark, sf):
    """Even vectors as symbols, odd ones as chunks."""
    v = rel(spark, sf, "embeddings")
    return L.semantic_search(v.where("vec_id = 0"), v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"))


@query("s16_path_kinds", "SELECT path, regexp_matches(lower(path), '(^|/)(tests?/|test_)|_test\\.|\\.test\\.|\\.spec\\.|_spec\\.') AS is_test, regexp_matches(lower(path), '(^|/)(tests?/|test_|generated/|vendor/|dist/|node_modules/|build/|examples?/|fixtures?/|mocks?/)|_test\\.|\\.test\\.|\\.spec\\.|_spec\\.|\\.generated\\.|\\.min\\.') AS noisy FROM (SELECT path FROM files UNION ALL SELECT path FROM symbols)")
def s16_path_kinds(spark, sf):
    p = rel(spark, sf, "files").select("path").unionByName(rel(spark, sf, "symbols").select("path"))
    return p.select("path", is_test_path(F.col("path")).alias("is_test"), is_noisy_path(F.col("path")).alias("noisy"))


@query("s20_without_tests", """
    WITH t AS (SELECT p_partkey AS key, p_retailprice AS score, p_size % 3 = 0 AS is_test FROM part ORDER BY score DESC, key LIMIT 40), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS place FROM t WHERE NOT is_test)
    SELECT *, (SELECT max(place) FROM k) > 20 AS truncated FROM k WHERE place <= 20""")
def s20_without_tests(spark, sf):
    return L.without_tests(rel(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("score"), (F.col("p_size") % 3 == 0).alias("is_test")), 20)


@query("s22_rounded_scores", "SELECT o_orderkey AS key, round(o_orderkey / 32, 4) AS score FROM orders")
def s22_rounded_scores(spark, sf):
    return rel(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), L.round_score(F.col("o_orderkey") / 32).alias("score"))


@query("s24_embedding_space", "SELECT vec_id, 'same' AS meta FROM embeddings")
def s24_embedding_space(spark, sf):
    """Stored metadata that agree keep all vectors, others none."""
    v = rel(spark, sf, "embeddings").select("vec_id")
    now = {"model": "m1", "version": "2", "dim": "64"}
    stored = spark.createDataFrame([("m1", "2", 64)], "model string, version string, dim int")
    other = stored.withColumn("dim", F.lit(32))
    return L.same_space(v, stored, now).withColumn("meta", F.lit("same")).unionByName(L.same_space(v, other, now).withColumn("meta", F.lit("other")))


NOTES = "notes AS (SELECT doc_id AS key, source AS topic, text, doc_id AS updated_at, doc_id % 7 = 0 AS quarantined FROM documents)"


@query("s25_recall", f"""
    WITH {NOTES}, by_phrase AS (SELECT n.key, topic, score, updated_at FROM notes n JOIN {bm25_sql('documents', 'doc_id', 'text', ['the', 'of'])} b ON b.key = n.key WHERE NOT quarantined ORDER BY score DESC, updated_at DESC, n.key LIMIT 50),
    newest AS (SELECT key, topic, 0.0 AS score, updated_at FROM notes WHERE NOT quarantined ORDER BY updated_at DESC, key LIMIT 50),
    one AS (SELECT key, topic, 0.0 AS score, updated_at FROM notes WHERE topic = 'wiki' ORDER BY updated_at DESC, key LIMIT 50)
    SELECT 'phrase' AS how, * FROM by_phrase UNION ALL SELECT 'newest', * FROM newest UNION ALL SELECT 'topic', * FROM one""")
def s25_recall(spark, sf):
    n = rel(spark, sf, "documents").selectExpr("doc_id as key", "source as topic", "text", "doc_id as updated_at", "doc_id % 7 = 0 as quarantined")
    parts = [("phrase", L.recall(n, phrase="the of")), ("newest", L.recall(n)), ("topic", L.recall(n, topic="wiki", quarantined=True))]
    parts = [df.withColumn("how", F.lit(how)) for how, df in parts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s28_previews", f"""
    WITH {OWNED}, {CALLS}, asked AS (SELECT DISTINCT path, line_no AS line FROM sites UNION SELECT path, 1000 FROM files)
    SELECT a.path, a.line, CASE WHEN trim(l.line) <> '' THEN CASE WHEN length(trim(l.line)) > 160 THEN left(trim(l.line), 160) || '…' ELSE trim(l.line) END END AS preview FROM asked a LEFT JOIN ls l ON l.path = a.path AND l.line_no = a.line""")
def s28_previews(spark, sf):
    files = rel(spark, sf, "files")
    sites = C.calls(files).select("path", "line").unionByName(files.select("path", F.lit(1000).alias("line")))
    return L.previews(sites, C.lines(files))


@query("d25_pattern_debt", """
    WITH anchors AS (SELECT vec_id AS anchor_id FROM embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT -1), n AS (SELECT q.vec_id AS query_id, v.vec_id, round(1 - list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 9) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM n), k AS (SELECT query_id, count(*) FILTER (vec_id <> query_id AND 1 - distance >= 0.75) AS n FROM r WHERE place <= 21 GROUP BY 1)
    SELECT anchor_id, coalesce(n, 0) AS n_left, CASE WHEN anchor_id = -1 THEN 'anchor_lost' WHEN coalesce(n, 0) = 0 THEN 'resolved' ELSE 'open' END AS status FROM anchors LEFT JOIN k ON query_id = anchor_id""")
def d25_pattern_debt(spark, sf):
    v = rel(spark, sf, "embeddings")
    anchors = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("anchor_id")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("anchor_id")))
    return L.pattern_debt(anchors, v)


@query("d26_symbols_batch", """
    WITH f AS (SELECT l_suppkey AS request, 'P' || l_partkey AS qn, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY pos, qn) AS place FROM f)
    SELECT request, place, k.qn, s.kind, s.path FROM k LEFT JOIN symbols s ON s.qn = k.qn WHERE place <= 50""")
def d26_symbols_batch(spark, sf):
    ids = rel(spark, sf, "lineitem").select(F.col("l_suppkey").alias("request"), F.concat(F.lit("P"), "l_partkey").alias("qn"), F.struct(F.expr("l_orderkey * 10 + l_linenumber"), F.concat(F.lit("P"), "l_partkey")).alias("place"))
    return L.batch(ids, rel(spark, sf, "symbols").select("qn", "kind", "path"))


@query("x05_scan_text", "SELECT doc_id, coalesce(length(text), 0) AS n_chars, regexp_matches(coalesce(text, ''), '(?i)ignore\\s+(all\\s+)?previous\\s+instructions') AS asks, '<untrusted-external-content source=\"web\">' || chr(10) || left(coalesce(text, ''), 500000) || chr(10) || '</untrusted-external-content>' AS wrapped FROM documents")
def x05_scan_text(spark, sf):
    s = safety.scan_text(F.col("text"), F.lit("web"))
    # fields of the struct as it is made, so that those that nobody asks for aren't computed
    return rel(spark, sf, "documents").select("doc_id", s["n_chars"].alias("n_chars"), F.array_contains(s["injections"], "IGNORE_PRIOR_INSTRUCTIONS").alias("asks"), s["wrapped"].alias("wrapped"))
