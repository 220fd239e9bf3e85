"""Search queries over documents, symbols and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..projections import rel
from ..registry import query

TOK = r"regexp_extract_all(lower(coalesce({}, '')), '([\p{{L}}\p{{N}}]+)')"


def bm25_sql(source: str, key: str, text: str, words: list[str]) -> str:
    """BM25 of a phrase of two words, by pairs of neighbouring tokens."""
    return f"""(WITH t AS (SELECT {key} AS key, {TOK.format(text)} AS toks FROM {source}), u AS (SELECT key, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM t),
        p AS (SELECT key, tok, lead(tok) OVER (PARTITION BY key ORDER BY i) AS nx FROM u), h AS (SELECT key, count(*) AS tf FROM p WHERE tok = '{words[0]}' AND nx = '{words[1]}' GROUP BY key),
        s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t), f AS (SELECT count(*) AS df FROM h)
        SELECT t.key, tf, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl)), 6) AS score FROM t JOIN h ON h.key = t.key, s, f)"""


def docs(spark, sf):
    return rel(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")


@query("s15_phrase_bm25", f"SELECT * FROM {bm25_sql('documents', 'doc_id', 'text', ['the', 'of'])}")
def s15_phrase_bm25(spark, sf):
    return S.phrase_bm25(docs(spark, sf), "the of")


CHUNKS = """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), w AS (SELECT doc_id, ls, unnest(CASE WHEN len(ls) <= 30 THEN [1::BIGINT] ELSE range(1, greatest(ceil((len(ls) - 30) / 20.0), 0)::BIGINT * 20 + 2, 20) END) AS a FROM d),
    c AS (SELECT doc_id || '#' || a AS key, array_to_string(ls[a:least(a + 29, len(ls))], chr(10)) AS text FROM w), chunk_rows AS (SELECT * FROM c WHERE regexp_replace(text, '\\s', '', 'g') <> '')"""


@query("s06_chunk_search", f"{CHUNKS} SELECT * FROM {bm25_sql('chunk_rows', 'key', 'text', ['de', 'la'])}")
def s06_chunk_search(spark, sf):
    from ..operators.text import chunks

    c = chunks(docs(spark, sf), "key").select(F.concat_ws("#", "key", "line_start").alias("key"), F.col("chunk").alias("text"))
    return S.phrase_bm25(c, "de la")


FACTS = "s AS (SELECT qn, name, path, signature, is_test, price / 2000 AS churn, length(kind) AS coreness FROM symbols)"


def symbols(spark, sf):
    return rel(spark, sf, "symbols").select("qn", "name", "path", "signature", "is_test", (F.col("price") / 2000).alias("churn"), F.length("kind").alias("coreness"))


@query("s01_symbol_search", f"""
    WITH {FACTS}, names AS (SELECT qn, replace(name, '_', ' ') AS words FROM s),
    a AS (SELECT key, score * 1.5 AS score FROM {bm25_sql('s', 'qn', 'signature', ['red', 'widget'])} ORDER BY score DESC, key LIMIT 40), b AS (SELECT key, score FROM {bm25_sql('names', 'qn', 'words', ['red', 'widget'])} ORDER BY score DESC, key LIMIT 40),
    e AS (SELECT qn AS key, 0.0 AS score FROM s WHERE lower(name) = 'red_widget' ORDER BY coreness DESC, qn LIMIT 40),
    t AS (SELECT key, sum(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY key),
    n AS (SELECT s.*, t.score, lower(name) = 'red_widget' AS exact, is_test OR regexp_matches(path, '(^|/)(tests?/|test_|vendor/)') AS noisy FROM s JOIN t ON key = qn)
    SELECT qn, round(CASE WHEN exact THEN greatest(score, 1.0) ELSE score END * CASE WHEN noisy THEN 0.6 ELSE 1 + 0.15 * churn END * CASE WHEN noisy THEN 1.0 ELSE 1 + 0.06 * coreness END * CASE WHEN exact AND NOT noisy THEN 4.0 ELSE 1 END, 4) AS score FROM n ORDER BY score DESC, qn LIMIT 20""")
def s01_symbol_search(spark, sf):
    return S.symbol_search(symbols(spark, sf), "red_widget")


DIST = "round(1 - list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 9)"
NEAR = f"""n AS (SELECT q.vec_id AS query_id, v.vec_id, {DIST} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM n)"""


@query("s13_nearest", f"WITH {NEAR} SELECT * FROM r WHERE place <= 10")
def s13_nearest(spark, sf):
    v = rel(spark, sf, "embeddings")
    return S.nearest(v.where("vec_id % 100 = 0"), v, 10)


@query("s12_similar", f"""
    WITH {NEAR}, c AS (SELECT query_id, distance, vec_id, label FROM r JOIN embeddings USING (vec_id) WHERE place <= 20 AND vec_id <> query_id),
    b AS (SELECT query_id, label, distance, vec_id, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS k FROM c) SELECT query_id, label, vec_id, distance FROM b WHERE k = 1""")
def s12_similar(spark, sf):
    """The overfetched neighbours of each anchor, without itself, then the best of each owner."""
    from pyspark.sql import Window

    v = rel(spark, sf, "embeddings")
    near = S.nearest(v.where("vec_id % 100 = 0"), v, 20).where("vec_id != query_id").join(v.select("vec_id", "label"), "vec_id")
    w = Window.partitionBy("query_id", "label").orderBy("distance", "vec_id")
    return near.withColumn("k", F.row_number().over(w)).where("k = 1").select("query_id", "label", "vec_id", "distance")


@query("s14_rank_fusion", f"""
    WITH x AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rank FROM {bm25_sql('documents', 'doc_id', 'text', ['the', 'of'])}), y AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rank FROM {bm25_sql('documents', 'doc_id', 'text', ['of', 'the'])})
    SELECT key, round(sum(s), 9) AS score FROM (SELECT key, 1.5 / (20 + rank) AS s FROM x UNION ALL SELECT key, 1.0 / (20 + rank) FROM y) GROUP BY key""")
def s14_rank_fusion(spark, sf):
    counts = S.phrase_counts(docs(spark, sf), ["the of", "of the"])
    return S.fuse([(S.ranked(S.bm25(counts, 0)), 1.5), (S.ranked(S.bm25(counts, 1)), 1.0)])


@query("s11_hybrid_search", f"""
    WITH {NEAR}, x AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rank FROM (SELECT key, score FROM {bm25_sql('documents', 'doc_id', 'text', ['the', 'of'])} ORDER BY score DESC, key LIMIT 40)),
    y AS (SELECT vec_id AS key, place AS rank FROM r WHERE query_id = 0 AND place <= 40)
    SELECT key, round(sum(s), 9) AS score FROM (SELECT key, 1.5 / (20 + rank) AS s FROM x UNION ALL SELECT key, 1.0 / (20 + rank) FROM y) GROUP BY key ORDER BY score DESC, key LIMIT 20""")
def s11_hybrid_search(spark, sf):
    v = rel(spark, sf, "embeddings")
    words = S.ranked(S.phrase_bm25(docs(spark, sf), "the of").orderBy(F.desc("score"), "key").limit(40))
    vectors = S.nearest(v.where("vec_id = 0"), v, 40).select(F.col("vec_id").alias("key"), F.col("place").alias("rank"))
    return S.fuse([(words, 1.5), (vectors, 1.0)], limit=20)


@query("s19_personalized", """
    WITH i AS (SELECT DISTINCT from_path, to_path FROM imports WHERE to_path IS NOT NULL), near AS (SELECT * FROM i UNION ALL SELECT to_path, from_path FROM i),
    touched AS (SELECT 'm' || n_nationkey AS path, n_nationkey AS touch FROM nation WHERE n_regionkey = 1), b AS (SELECT from_path AS path, max(1.0 / (1 + 30 - touch)) AS boost FROM near JOIN touched ON path = to_path GROUP BY 1),
    r AS (SELECT s_suppkey AS key, 'm' || s_nationkey AS path, s_acctbal AS score FROM supplier), j AS (SELECT key, r.path, score, coalesce(boost, 0) AS boost FROM r LEFT JOIN b ON r.path = b.path)
    SELECT key, path, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) + 0.15 * boost, 6) AS score FROM j""")
def s19_personalized(spark, sf):
    touched = rel(spark, sf, "nation").where("n_regionkey = 1").select(F.concat(F.lit("m"), "n_nationkey").alias("path"), F.col("n_nationkey").alias("touch"))
    results = rel(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.concat(F.lit("m"), "s_nationkey").alias("path"), F.col("s_acctbal").alias("score"))
    return S.personalized(results, S.proximity_boosts(rel(spark, sf, "imports"), touched, 30))


@query("s21_resolution", """
    WITH r AS (SELECT p_brand || p_type AS query, p_partkey AS key, p_retailprice / 1000 AS score FROM part), k AS (SELECT query, score, lead(score) OVER w AS nx, row_number() OVER w AS place FROM r WINDOW w AS (PARTITION BY query ORDER BY score DESC, key))
    SELECT query, CASE WHEN nx >= 0.99 * score THEN 'ambiguous' WHEN score >= 1 THEN 'confident' ELSE 'weak' END AS verdict FROM k WHERE place = 1""")
def s21_resolution(spark, sf):
    p = rel(spark, sf, "part").select(F.concat("p_brand", "p_type").alias("query"), F.col("p_partkey").alias("key"), (F.col("p_retailprice") / 1000).alias("score"))
    return S.resolution(p, 0.99)


@query("s23_pending_vectors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def s23_pending_vectors(spark, sf):
    return rel(spark, sf, "documents").select("doc_id").join(rel(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
