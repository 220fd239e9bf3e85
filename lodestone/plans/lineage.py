"""Queries of digests, ancestors, references, and proofs laid over edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lineage as N
from ..operators import overlay as O
from ..projections import rel
from ..registry import query
from ..sources import code as C
from .sources import CALLS, LINES, OWNED, by_language


def symbols_called(spark, sf):
    """Callers and callees in one name space: suppliers call parts, and a part calls the supplier of its number."""
    e = rel(spark, sf, "edges").select("src", "dst", "confidence", "ruled_out")
    p = rel(spark, sf, "part").selectExpr("'P' || p_partkey as src", "'S' || p_partkey as dst", "'resolved' as confidence", "false as ruled_out")
    return e.unionByName(p)


BOTH = "both_edges AS (SELECT src, dst, confidence, ruled_out FROM edges UNION ALL SELECT 'P' || p_partkey, 'S' || p_partkey, 'resolved', false FROM part)"


@query("g14_digests", f"""
    WITH RECURSIVE {BOTH}, names AS (SELECT 'S' || s_suppkey AS qn, s_name || '_x_y' AS name FROM supplier UNION ALL SELECT qn, name FROM symbols), e AS (SELECT * FROM both_edges WHERE NOT ruled_out AND confidence IN ('formal', 'resolved', 'inferred')),
    p AS (SELECT src, dst, max(confidence <> 'inferred') AS sure FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY src, sure ORDER BY dst) AS k FROM p),
    d AS (SELECT src, string_agg(dst, ',' ORDER BY dst) FILTER (sure AND k <= 8) AS verified, string_agg(dst, ',' ORDER BY dst) FILTER (NOT sure AND k <= 5) AS inferred FROM k GROUP BY src),
    v AS (SELECT DISTINCT src, dst FROM e WHERE confidence <> 'inferred'), trimmed AS (SELECT v.src, v.dst FROM v WHERE v.src IN (SELECT dst FROM v) AND v.dst IN (SELECT src FROM v)),
    walk AS (SELECT src AS origin, dst AS node FROM trimmed UNION SELECT w.origin, t.dst FROM walk w JOIN trimmed t ON t.src = w.node), cyc AS (SELECT DISTINCT origin FROM walk WHERE origin = node)
    SELECT qn, regexp_extract(name, '^[^_]*(_[^_]*)?') AS tags, coalesce(verified, '') AS verified, coalesce(inferred, '') AS inferred, qn IN (SELECT origin FROM cyc) AS cyclic FROM names LEFT JOIN d ON src = qn""")
def g14_digests(spark, sf):
    e = symbols_called(spark, sf)
    names = rel(spark, sf, "supplier").selectExpr("'S' || s_suppkey as qn", "s_name || '_x_y' as name").unionByName(rel(spark, sf, "symbols").select("qn", "name"))
    return N.digests(names, e, G.cycles(e))


PARENTS = "parents AS (SELECT 's' || s_suppkey AS cls, 's' || (s_suppkey // 3) AS parent FROM supplier UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey // 5) FROM supplier UNION ALL SELECT 's0', 's2')"
CLOSURE = f"""{PARENTS}, steps AS (SELECT DISTINCT cls, parent FROM parents WHERE cls <> parent), walk AS (SELECT cls, parent AS ancestor, 1 AS level FROM steps UNION SELECT w.cls, s.parent, w.level + 1 FROM walk w JOIN steps s ON s.cls = w.ancestor WHERE w.level < 12),
    closure AS (SELECT cls, ancestor, min(level) AS level FROM walk WHERE cls <> ancestor GROUP BY ALL)"""


def parents(spark, sf):
    s = rel(spark, sf, "supplier")
    tree = s.selectExpr("'s' || s_suppkey as cls", "'s' || (s_suppkey div 3) as parent").unionByName(s.selectExpr("'s' || s_suppkey as cls", "'s' || (s_suppkey div 5) as parent"))
    return tree.unionByName(spark.createDataFrame([("s0", "s2")], "cls string, parent string"))


@query("g16_ancestors", f"WITH RECURSIVE {CLOSURE} SELECT * FROM closure")
def g16_ancestors(spark, sf):
    return N.ancestors(parents(spark, sf))


@query("g17_inherited_methods", f"""
    WITH RECURSIVE {CLOSURE}, methods AS (SELECT 's' || s_suppkey AS cls, 'm' || (s_suppkey % 4) AS method FROM supplier), asked AS (SELECT 's' || s_suppkey AS cls, 'm' || (s_suppkey % 3) AS method FROM supplier),
    m AS (SELECT a.cls, a.method, level, count(*) AS n, min(ancestor) AS owner FROM asked a JOIN closure c ON c.cls = a.cls JOIN methods t ON t.cls = ancestor AND t.method = a.method GROUP BY ALL), f AS (SELECT cls, method, min(struct_pack(level := level, n := n, owner := owner)) AS f FROM m GROUP BY ALL)
    SELECT a.cls, a.method, CASE WHEN f.f.n = 1 THEN f.f.owner END AS owner FROM asked a LEFT JOIN f ON f.cls = a.cls AND f.method = a.method""")
def g17_inherited_methods(spark, sf):
    s = rel(spark, sf, "supplier")
    asked, methods = s.selectExpr("'s' || s_suppkey as cls", "'m' || (s_suppkey % 3) as method"), s.selectExpr("'s' || s_suppkey as cls", "'m' || (s_suppkey % 4) as method")
    return N.inherited(asked, methods, N.ancestors(parents(spark, sf)))


@query("g19_reference_impact", f"""
    WITH {OWNED}, {CALLS}, c AS (SELECT path, line_no AS line, CASE WHEN ends_with(path, '.py') THEN 'resolved' WHEN ends_with(path, '.go') THEN 'textual' ELSE 'ambiguous' END AS confidence FROM sites WHERE callee = 'run'),
    r AS (SELECT path, line, 0 AS p, 'call' AS source, CASE WHEN confidence = 'resolved' THEN 'must' WHEN confidence = 'textual' THEN 'likely' ELSE 'review' END AS verdict FROM c UNION ALL SELECT path, line_no, 1, 'import', 'likely' FROM own WHERE regexp_matches(line, 'import .*\\brun\\b') OR regexp_matches(line, '::run;')
        UNION ALL SELECT path, line_no, 2, 'text', 'review' FROM own WHERE regexp_matches(line, '\\brun\\b') AND name IS DISTINCT FROM 'run'), f AS (SELECT path, line, min(struct_pack(p := p, source := source, verdict := verdict)) AS f FROM r GROUP BY ALL)
    SELECT path, line, f.source AS source, f.verdict AS verdict FROM f ORDER BY path, line LIMIT 200""")
def g19_reference_impact(spark, sf):
    files = rel(spark, sf, "files")
    language = F.when(F.col("path").endswith(".py"), "resolved").when(F.col("path").endswith(".go"), "textual").otherwise("ambiguous")
    calls = C.calls(files).where("callee = 'run'").select("path", "line", language.alias("confidence"))
    own = C.owned_lines(files).withColumn("no", F.col("line_no"))
    imports = own.where(F.col("line").rlike(r"import .*\brun\b") | F.col("line").rlike("::run;")).select("path", F.col("no").alias("line"))
    mentions = own.where(F.col("line").rlike(r"\brun\b") & ~F.col("name").eqNullSafe(F.lit("run"))).select("path", F.col("no").alias("line"))
    return N.reference_impact(calls, imports, mentions)


@query("g22_health", """
    WITH e AS (SELECT dst, confidence, CASE WHEN line % 3 = 0 THEN 'tests/' || src_path ELSE src_path END AS src_path FROM edges WHERE NOT ruled_out)
    SELECT dst, count(*) FILTER (confidence = 'formal') AS formal, count(*) FILTER (confidence = 'resolved') AS resolved, count(*) FILTER (confidence = 'inferred') AS inferred, count(*) FILTER (confidence = 'textual') AS textual, count(*) FILTER (confidence = 'ambiguous') AS ambiguous, count(*) FILTER (confidence = 'unresolved') AS unresolved,
        count(DISTINCT src_path) FILTER (starts_with(src_path, 'tests/')) AS n_test_files FROM e GROUP BY dst""")
def g22_health(spark, sf):
    e = rel(spark, sf, "edges")
    return N.health(e.withColumn("src_path", F.when(F.col("line") % 3 == 0, F.concat(F.lit("tests/"), "src_path")).otherwise(F.col("src_path"))))


@query("g23_unresolved_groups", """
    WITH c AS (SELECT DISTINCT site_id AS group_id, dst AS qn FROM edges WHERE confidence IN ('ambiguous', 'textual')), n AS (SELECT group_id, count(*) AS n FROM c GROUP BY 1) SELECT qn, count(*) AS n_groups, max(n) AS most_candidates FROM c JOIN n USING (group_id) GROUP BY qn""")
def g23_unresolved_groups(spark, sf):
    return N.unresolved_groups(rel(spark, sf, "edges").where("confidence in ('ambiguous', 'textual')").select(F.col("site_id").alias("group_id"), F.col("dst").alias("qn")))


@query("d23_package_dependencies", f"""
    WITH {LINES}, i AS (SELECT path, {by_language(C.IMPORTS)} AS module FROM ls), p AS (SELECT regexp_replace(path, '/[^/]*$', '') AS package, regexp_replace(module, '(\\.|::|/)[^./:]+$', '') AS depends_on FROM i WHERE module <> '')
    SELECT package, depends_on, count(*) AS n_imports FROM p WHERE package <> depends_on GROUP BY ALL""")
def d23_package_dependencies(spark, sf):
    return N.package_dependencies(C.imports(rel(spark, sf, "files")))


_REFS = """refs AS (SELECT DISTINCT site_id, 'sym' || substr(dst, 2) AS symbol, CASE WHEN line = 7 THEN 1 ELSE 2 END AS generation FROM edges WHERE confidence IN ('formal', 'textual')), defs AS (SELECT 'sym' || p_partkey AS symbol, 'P' || p_partkey AS target FROM part WHERE p_size % 10 <> 0),
    m AS (SELECT DISTINCT site_id, target FROM refs JOIN defs USING (symbol) WHERE generation = 2), proofs AS (SELECT site_id, min(target) AS target FROM m GROUP BY site_id HAVING count(*) = 1)"""


def _proofs(spark, sf):
    e = rel(spark, sf, "edges").where("confidence in ('formal', 'textual')")
    refs = e.select("site_id", F.concat(F.lit("sym"), F.expr("substr(dst, 2)")).alias("symbol"), F.when(F.col("line") == 7, 1).otherwise(2).alias("generation")).distinct()
    defs = rel(spark, sf, "part").where("p_size % 10 != 0").selectExpr("'sym' || p_partkey as symbol", "'P' || p_partkey as target")
    return O.proven_targets(refs, defs, 2)


@query("e07_overlay", f"WITH {_REFS} SELECT e.site_id, dst, CASE WHEN dst = target THEN 'formal' ELSE confidence END AS confidence FROM edges e LEFT JOIN proofs p ON p.site_id = e.site_id")
def e07_overlay(spark, sf):
    return O.overlaid(rel(spark, sf, "edges").select("site_id", "dst", "confidence"), _proofs(spark, sf))


@query("e07_match_rate", f"WITH {_REFS} SELECT count(*) AS n_targets, count(*) FILTER (EXISTS (SELECT 1 FROM edges e WHERE e.site_id = p.site_id AND e.dst = p.target AND e.confidence = 'textual')) AS n_satisfied FROM proofs p")
def e07_match_rate(spark, sf):
    return O.match_rate(rel(spark, sf, "edges").where("confidence = 'textual'"), _proofs(spark, sf))


_GIVEN = "given AS (SELECT site_id, dst, confidence FROM edges WHERE confidence IN ('resolved', 'inferred'))"


@query("e09_e15_insertions", f"""
    WITH {_REFS}, {_GIVEN}, s AS (SELECT site_id FROM (SELECT l_orderkey AS site_id FROM lineitem) GROUP BY 1 HAVING count(*) <= 4), t AS (SELECT qn FROM symbols GROUP BY 1 HAVING count(*) = 1),
    o AS (SELECT * FROM proofs p WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.site_id = p.site_id AND g.dst = p.target)), a AS (SELECT site_id, target, CASE WHEN site_id IN (SELECT site_id FROM given WHERE confidence = 'resolved') THEN 'excluded' WHEN site_id IN (SELECT site_id FROM s) AND target IN (SELECT qn FROM t) THEN 'inserted' END AS action FROM o)
    SELECT * FROM a WHERE action IS NOT NULL""")
def e09_e15_insertions(spark, sf):
    few = rel(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("site_id")).agg(F.count("*").alias("n")).where("n <= 4").select("site_id")
    return O.insertions(rel(spark, sf, "edges").where("confidence in ('resolved', 'inferred')").select("site_id", "dst", "confidence"), _proofs(spark, sf), few, rel(spark, sf, "symbols"))


@query("d27_ledger", "WITH n AS (SELECT event_type AS status, user_id % 3 = 0 AS disposition, count(*) AS n FROM events GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY status), 6) AS rate FROM n")
def d27_ledger(spark, sf):
    return O.ledger_summary(rel(spark, sf, "events").select(F.col("event_type").alias("status"), (F.col("user_id") % 3 == 0).alias("disposition")))
