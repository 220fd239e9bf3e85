"""Change-impact queries over the projections. A change is an order; its hunks are its line items on the files of their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import risk as R
from ..operators.edits import kinds_mismatch
from ..projections import rel
from ..registry import query
from .analytics import DEAD, COVERED, FACTS, RARE, dead, facts, lines

HUNKS = """hunks AS (SELECT l_orderkey AS change_id, path, l_linenumber * 20 AS new_start, l_linenumber * 20 + CAST(l_quantity AS INT) % 9 AS new_end FROM lineitem JOIN symbols ON qn = 'P' || l_partkey)"""


def hunks(spark, sf):
    li = rel(spark, sf, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("qn"), F.col("l_orderkey").alias("change_id"), (F.col("l_linenumber") * 20).alias("new_start"), (F.col("l_linenumber") * 20 + F.col("l_quantity").cast("int") % 9).alias("new_end"))
    # shuffled: texts that a projection makes are larger than Spark's estimate of them, and symbols have no size bound
    return li.join(rel(spark, sf, "symbols").select("qn", "path").hint("merge"), "qn").drop("qn")


@query("r01_diff_impact", f"""
    WITH {FACTS}, {HUNKS}, m AS (SELECT change_id, qn, caller_count, max(new_start <= line_start) AS signature_changed FROM hunks JOIN facts USING (path) WHERE NOT (new_end < line_start OR new_start > line_end) GROUP BY ALL),
    k AS (SELECT *, CASE WHEN signature_changed OR caller_count > 10 THEN 2 WHEN caller_count > 3 THEN 1 ELSE 0 END AS r FROM m),
    p AS (SELECT change_id, qn, caller_count, signature_changed, ['low', 'medium', 'high'][r + 1] AS risk, ['low', 'medium', 'high'][max(r) OVER w + 1] AS aggregate, count(*) OVER w AS n_affected,
        row_number() OVER (PARTITION BY change_id ORDER BY r DESC, signature_changed DESC, caller_count DESC, qn) AS place FROM k WINDOW w AS (PARTITION BY change_id))
    SELECT * FROM p WHERE place <= 20""")
def r01_diff_impact(spark, sf):
    return R.diff_impact(hunks(spark, sf), facts(spark, sf))


@query("r02_base_risk", f"WITH {FACTS} SELECT qn, CASE WHEN caller_count > 10 THEN 'high' WHEN caller_count > 3 THEN 'medium' ELSE 'low' END AS risk FROM facts")
def r02_base_risk(spark, sf):
    return facts(spark, sf).select("qn", R.base_risk(F.col("caller_count")).alias("risk"))


@query("r03_signature_changed", """
    WITH s AS (SELECT qn, signature || ' a: int, b :str' AS o, CASE WHEN language = 'go' THEN signature || ' x: int,  y :str' WHEN language = 'java' THEN signature || ' a: long, b: str' ELSE signature || ' a: int, b :str' END AS n FROM symbols)
    SELECT qn, o <> n AS touched, trim(regexp_replace(regexp_replace(o, '[A-Za-z_][A-Za-z0-9_]*\\s*:\\s*', ': ', 'g'), '\\s+', ' ', 'g')) <> trim(regexp_replace(regexp_replace(n, '[A-Za-z_][A-Za-z0-9_]*\\s*:\\s*', ': ', 'g'), '\\s+', ' ', 'g')) AS changed FROM s""")
def r03_signature_changed(spark, sf):
    s = rel(spark, sf, "symbols")
    o = F.concat("signature", F.lit(" a: int, b :str"))
    n = F.when(F.col("language") == "go", F.concat("signature", F.lit(" x: int,  y :str"))).when(F.col("language") == "java", F.concat("signature", F.lit(" a: long, b: str"))).otherwise(o)
    return s.select("qn", (o != n).alias("touched"), (R.normalized_signature(o) != R.normalized_signature(n)).alias("changed"))


@query("r06_escalation", f"WITH {FACTS} SELECT qn, CASE WHEN is_entry OR caller_count > 10 THEN 'high' WHEN caller_count > 3 THEN 'medium' ELSE 'low' END AS risk FROM facts")
def r06_escalation(spark, sf):
    return facts(spark, sf).select("qn", R.escalated(R.base_risk(F.col("caller_count")), F.col("is_entry")).alias("risk"))


@query("r09_change_kind", """
    WITH c AS (SELECT qn, path, CASE WHEN price % 7 < 1 THEN '' ELSE signature || ' {\n  x = 1\n}' END AS o, CASE WHEN price % 7 BETWEEN 1 AND 2 THEN '' WHEN price % 7 < 3 THEN signature || ' {\n\n  x=1 }' WHEN price % 7 < 4 THEN '# note\n' || signature || ' {\n  x = 1\n}'
        WHEN price % 7 < 5 THEN replace(signature, '(x)', '(y)') || ' {\n  x = 1\n}' WHEN price % 7 < 6 THEN replace(signature, 'pub ', '') || ' {\n  x = 1\n}' ELSE signature || ' {\n  x = 2\n}' END AS n FROM symbols)
    SELECT qn, CASE WHEN o = '' AND n <> '' THEN 'add' WHEN n = '' AND o <> '' THEN 'delete' WHEN regexp_matches(path, '(^|/)tests?/') THEN 'test_only'
        WHEN regexp_replace(o, '\\s+', '', 'g') = regexp_replace(n, '\\s+', '', 'g') THEN 'whitespace'
        WHEN regexp_replace(regexp_replace(o, '(?m)^\\s*#.*$', '', 'g'), '\\s+', '', 'g') = regexp_replace(regexp_replace(n, '(?m)^\\s*#.*$', '', 'g'), '\\s+', '', 'g') THEN 'comment'
        WHEN replace(regexp_extract(o, '(fn [^{\n]*)', 1), 'pub ', '') <> replace(regexp_extract(n, '(fn [^{\n]*)', 1), 'pub ', '') THEN 'signature'
        WHEN contains(o, 'pub ') <> contains(n, 'pub ') THEN 'visibility' ELSE 'body' END AS kind FROM c""")
def r09_change_kind(spark, sf):
    s, m, body = rel(spark, sf, "symbols"), F.col("price") % 7, F.lit(" {\n  x = 1\n}")
    o = F.when(m < 1, "").otherwise(F.concat("signature", body))
    n = (
        F.when(m.between(1, 2), "").when(m < 3, F.concat("signature", F.lit(" {\n\n  x=1 }"))).when(m < 4, F.concat(F.lit("# note\n"), "signature", body))
        .when(m < 5, F.concat(F.replace("signature", F.lit("(x)"), F.lit("(y)")), body)).when(m < 6, F.concat(F.replace("signature", F.lit("pub "), F.lit("")), body)).otherwise(F.concat("signature", F.lit(" {\n  x = 2\n}")))
    )
    return s.withColumns({"old": o, "new": n}).select("qn", R.change_kind().alias("kind"))


@query("r10_intent_mismatch", """
    WITH c AS (SELECT qn, path, CASE floor(price)::INT % 4 WHEN 0 THEN NULL WHEN 1 THEN 'body' WHEN 2 THEN 'add' ELSE 'test_only' END AS declared FROM symbols)
    SELECT qn, declared IS NOT NULL AND declared <> CASE WHEN regexp_matches(path, '(^|/)tests?/') THEN 'test_only' ELSE 'body' END AS mismatch FROM c""")
def r10_intent_mismatch(spark, sf):
    """The declared kind against the one that is observed in the texts before and after."""
    declared = F.element_at(F.array(F.lit(None), F.lit("body"), F.lit("add"), F.lit("test_only")), F.floor("price").cast("int") % 4 + 1)
    s = rel(spark, sf, "symbols").withColumns({"old": F.concat("signature", F.lit(" { 1 }")), "new": F.concat("signature", F.lit(" { 2 }"))})
    return s.select("qn", kinds_mismatch(declared, R.change_kind()).alias("mismatch"))


VECTOR = """v AS (SELECT qn, CASE WHEN caller_count > 10 THEN 2 WHEN caller_count > 3 THEN 1 ELSE 0 END AS a, CASE WHEN is_entry THEN 2 ELSE 0 END AS b, CASE WHEN is_test THEN 1 ELSE 0 END AS c FROM facts)"""


def _vector(spark, sf):
    f = facts(spark, sf)
    return f.select("qn", R.base_risk(F.col("caller_count")).alias("a"), F.when(F.col("is_entry"), "high").otherwise("low").alias("b"), F.when(F.col("is_test"), "medium").otherwise("low").alias("c"))


@query("r11_policy_level", f"WITH {FACTS}, {VECTOR} SELECT qn, ['low', 'medium', 'high'][greatest(a, b, c) + 1] AS level, greatest(a, b, c) = 2 AS human FROM v")
def r11_policy_level(spark, sf):
    return _vector(spark, sf).select("qn", R.policy_level(["a", "b", "c"]).alias("level")).withColumn("human", F.col("level") == "high")


@query("r12_vector_coverage", f"WITH {FACTS}, {VECTOR} SELECT qn, a <= 1 AND b <= 0 AND c <= 1 AS covered FROM v")
def r12_vector_coverage(spark, sf):
    v = _vector(spark, sf).withColumns({"la": F.lit("medium"), "lb": F.lit("low"), "lc": F.lit("medium")})
    return v.select("qn", R.covered_by(["a", "b", "c"], ["la", "lb", "lc"]).alias("covered"))


@query("r14_gate", f"""
    WITH {FACTS} SELECT qn, CASE WHEN coreness >= 4 AND hub_kind IS NULL AND NOT caller_count > 10 AND NOT (caller_count = 0) THEN 'confirm' WHEN hub_kind IS NOT NULL OR caller_count > 10 OR caller_count = 0 THEN 'block' ELSE 'pass' END AS gate FROM facts""")
def r14_gate(spark, sf):
    c = F.col("caller_count")
    return facts(spark, sf).select("qn", R.gate(F.col("hub_kind").isNotNull(), R.base_risk(c), c == 0, (F.col("coreness") >= 4) & F.col("hub_kind").isNull()).alias("gate"))


@query("r15_all_confident", "SELECT dst AS qn, bool_and(confidence IN ('formal', 'resolved')) AS confident FROM edges WHERE NOT ruled_out GROUP BY dst")
def r15_all_confident(spark, sf):
    return R.all_confident(rel(spark, sf, "edges"))


@query("r16_uncertain_zero_caller", f"""
    WITH {RARE}, {COVERED}, {DEAD} SELECT f.qn, CASE WHEN dead_code IN ('none', 'low') THEN CASE WHEN is_entry THEN 'entry_point' WHEN is_test THEN 'test_only' ELSE 'low_confidence' END END AS why FROM facts f JOIN dead USING (qn) WHERE caller_count = 0""")
def r16_uncertain_zero_caller(spark, sf):
    return dead(spark, sf).where("caller_count = 0").select("qn", R.uncertain_zero_caller(F.col("dead_code"), F.col("is_entry"), F.col("is_test")).alias("why"))


@query("r19_overlapping_hunks", f"""
    WITH {HUNKS}, n AS (SELECT change_id, path, new_end, lead(new_start) OVER (PARTITION BY change_id, path ORDER BY new_start, new_end) AS nx FROM hunks) SELECT DISTINCT change_id, path FROM n WHERE nx <= new_end""")
def r19_overlapping_hunks(spark, sf):
    return R.overlapping_hunks(hunks(spark, sf))


@query("r20_ndcg", """
    WITH r AS (SELECT source AS query, doc_id AS item, n_chars % 997 AS score, quality + toxic AS grade FROM documents JOIN labels USING (doc_id)),
    p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS at_, row_number() OVER (PARTITION BY query ORDER BY grade DESC, item) AS best FROM r)
    SELECT query, round(coalesce(sum(CASE WHEN at_ <= 10 THEN (2.0 ** grade - 1) / log2(at_ + 1) END) / nullif(sum(CASE WHEN best <= 10 THEN (2.0 ** grade - 1) / log2(best + 1) END), 0), 0), 6) AS ndcg FROM p GROUP BY query""")
def r20_ndcg(spark, sf):
    d = rel(spark, sf, "documents").join(rel(spark, sf, "labels"), "doc_id")
    return R.ndcg(d.select(F.col("source").alias("query"), F.col("doc_id").alias("item"), (F.col("n_chars") % 997).alias("score"), (F.col("quality") + F.col("toxic")).alias("grade")))


@query("r23_path_floor", """
    WITH rules(rule_no, regex, severity) AS (VALUES (1, '^src/', 1), (2, '^tests/', 0), (3, '^src/brand1/', 2), (4, '\\.py$', 0), (5, '^src/brand[12]/small', 2))
    SELECT path, arg_max(severity, severity * 100 + rule_no) AS severity, arg_max(rule_no, severity * 100 + rule_no) AS rule_no FROM (SELECT DISTINCT path FROM symbols) LEFT JOIN rules ON regexp_matches(path, regex) GROUP BY path""")
def r23_path_floor(spark, sf):
    rules = spark.createDataFrame([(1, "^src/", 1), (2, "^tests/", 0), (3, "^src/brand1/", 2), (4, r"\.py$", 0), (5, "^src/brand[12]/small", 2)], "rule_no int, regex string, severity int")
    return R.path_floor(rel(spark, sf, "symbols").select("path").distinct(), rules)


@query("r24_touched_symbols", f"WITH {HUNKS} SELECT DISTINCT change_id, qn FROM hunks JOIN symbols USING (path) WHERE NOT (new_end < line_start OR new_start > line_end)")
def r24_touched_symbols(spark, sf):
    return R.touched_symbols(hunks(spark, sf), rel(spark, sf, "symbols"))


@query("r25_uncovered_hunks", f"""
    WITH {HUNKS}, {COVERED} SELECT change_id, bool_or(NOT EXISTS (SELECT 1 FROM lines l WHERE l.path = h.path AND l.line BETWEEN h.new_start AND h.new_end)) AS uncovered FROM hunks h GROUP BY change_id""")
def r25_uncovered_hunks(spark, sf):
    return R.uncovered_hunks(hunks(spark, sf), lines(spark, sf))


@query("r26_cited", """
    WITH c AS (SELECT qn, name, 'see ' || name || CASE language WHEN 'go' THEN '_x' WHEN 'java' THEN '.' ELSE ', ok' END AS reason FROM symbols)
    SELECT qn, regexp_matches(reason, '(^|[^A-Za-z0-9_])' || regexp_escape(name) || '($|[^A-Za-z0-9_])') AS cited FROM c""")
def r26_cited(spark, sf):
    tail = F.when(F.col("language") == "go", "_x").when(F.col("language") == "java", ".").otherwise(", ok")
    return rel(spark, sf, "symbols").select("qn", R.cites(F.concat(F.lit("see "), "name", tail), F.col("name")).alias("cited"))
