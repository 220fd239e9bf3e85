"""Graph queries over the projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..projections import rel
from ..registry import query

CALLERS = """
    counts AS (SELECT qn, count(DISTINCT CASE WHEN confidence <> 'ambiguous' THEN src END) AS caller_count,
        count(DISTINCT CASE WHEN confidence IN ('formal', 'resolved') THEN src END) AS verified_caller_count
        FROM symbols LEFT JOIN edges ON dst = qn AND NOT ruled_out GROUP BY qn)"""


@query("g01_callers", """
    WITH e AS (SELECT dst, src, src_path, line, confidence, row_number() OVER (PARTITION BY dst ORDER BY confidence = 'ambiguous', src_path, line, src, confidence) AS place,
        count(*) OVER (PARTITION BY dst) AS n_edges FROM edges WHERE NOT ruled_out) SELECT * FROM e WHERE place <= 25""")
def g01_callers(spark, sf):
    return G.callers(rel(spark, sf, "edges"), cap=25)


@query("g02_callees", """
    SELECT src, dst, confidence, count(*) AS n FROM edges WHERE NOT ruled_out GROUP BY ALL""")
def g02_callees(spark, sf):
    return G.live(rel(spark, sf, "edges")).groupBy("src", "dst", "confidence").agg(F.count("*").alias("n"))


@query("g03_confidence_breakdown", "SELECT dst, " + ", ".join(f"count(*) FILTER (confidence = '{c}') AS {c}" for c in G.RANK) + " FROM edges WHERE NOT ruled_out GROUP BY dst")
def g03_confidence_breakdown(spark, sf):
    return G.confidence_breakdown(rel(spark, sf, "edges"))


@query("g04_batched_neighbours", """
    SELECT DISTINCT e.src, e.dst FROM edges e JOIN (SELECT DISTINCT 'S' || s_suppkey AS node FROM supplier WHERE s_acctbal < 0) f ON e.src = f.node WHERE NOT ruled_out""")
def g04_batched_neighbours(spark, sf):
    frontier = rel(spark, sf, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("S"), "s_suppkey").alias("src")).distinct()
    return G.live(rel(spark, sf, "edges")).join(frontier, "src").select("src", "dst").distinct()


#: All imports between nations; four fifths of the pairs are ruled out, which the walks must heed.
HOPS = """
    hops AS (SELECT from_path AS src, to_path AS dst, CASE WHEN (length(from_path) + length(to_path)) % 2 = 0 THEN 'ambiguous' ELSE 'textual' END AS confidence, (CAST(substr(from_path, 2) AS INT) * 7 + CAST(substr(to_path, 2) AS INT)) % 5 <> 0 AS ruled_out
        FROM imports WHERE to_path IS NOT NULL)"""


def _hops(spark, sf):
    i = rel(spark, sf, "imports").where("to_path is not null")
    c = F.when((F.length("from_path") + F.length("to_path")) % 2 == 0, "ambiguous").otherwise("textual")
    return i.select(F.col("from_path").alias("src"), F.col("to_path").alias("dst"), c.alias("confidence"), F.expr("(cast(substr(from_path, 2) as int) * 7 + cast(substr(to_path, 2) as int)) % 5 <> 0").alias("ruled_out"))


def _nodes(spark, sf):
    return rel(spark, sf, "nation").select(F.concat(F.lit("m"), "n_nationkey").alias("node"))


@query("g05_transitive_reach", f"""
    WITH RECURSIVE {HOPS}, starts AS (SELECT 'm' || n_nationkey AS node FROM nation),
    walk AS (SELECT node AS origin, node, 0 AS depth, true AS sure FROM starts
        UNION SELECT w.origin, h.dst, w.depth + 1, h.confidence <> 'ambiguous' FROM walk w JOIN hops h ON h.src = w.node AND NOT h.ruled_out WHERE w.sure AND w.depth < 4)
    SELECT origin, node, min(depth) AS depth, max(sure) AS sure FROM walk GROUP BY origin, node HAVING min(depth) > 0""")
def g05_transitive_reach(spark, sf):
    return G.transitive(_hops(spark, sf), _nodes(spark, sf))


@query("g06_shortest_paths", f"""
    WITH RECURSIVE {HOPS}, starts AS (SELECT 'm' || n_nationkey AS node FROM nation),
    walk AS (SELECT node AS origin, node, 0 AS hops FROM starts
        UNION SELECT w.origin, h.dst, w.hops + 1 FROM walk w JOIN hops h ON h.src = w.node AND NOT h.ruled_out WHERE w.hops < 6)
    SELECT origin, node, min(hops) AS hops FROM walk GROUP BY origin, node""")
def g06_shortest_paths(spark, sf):
    return G.shortest_path_lengths(_hops(spark, sf), _nodes(spark, sf))


@query("g07_route_confidence", """
    WITH routes AS (SELECT site_id, list(CASE confidence WHEN 'formal' THEN 4 WHEN 'resolved' THEN 3 WHEN 'inferred' THEN 2 WHEN 'textual' THEN 1 ELSE 0 END) AS ranks FROM edges WHERE NOT ruled_out GROUP BY site_id)
    SELECT site_id, list_min(ranks) AS weakest, list_min(ranks) >= 3 AS certain FROM routes""")
def g07_route_confidence(spark, sf):
    weakest = F.min(G.rank_of(F.col("confidence")))
    return G.live(rel(spark, sf, "edges")).groupBy("site_id").agg(weakest.alias("weakest"), (weakest >= 3).alias("certain"))


@query("g08_coreness")
def g08_coreness(spark, sf):
    return G.coreness(rel(spark, sf, "edges"))


@query("g09_hubs", f"""
    WITH {CALLERS}, c AS (SELECT qn, caller_count, verified_caller_count AS coreness FROM counts),
    pct AS (SELECT qn, cume_dist() OVER (ORDER BY caller_count) AS pct FROM c WHERE caller_count >= 1),
    p75 AS (SELECT (list(coreness ORDER BY coreness))[greatest(floor(count(*) * 0.75)::INT - 1, 0) + 1] AS p75 FROM c WHERE coreness > 0)
    SELECT c.qn, caller_count, coreness, CASE WHEN caller_count >= 5 AND pct >= 0.95 THEN 'degree'
        WHEN caller_count >= 4 AND coreness >= greatest(p75, 4) THEN 'bridge' END AS hub_kind FROM c LEFT JOIN pct USING (qn), p75""")
def g09_hubs(spark, sf):
    counts = G.caller_counts(rel(spark, sf, "symbols"), rel(spark, sf, "edges"))
    return G.hubs(counts.select("qn", "caller_count", F.col("verified_caller_count").alias("coreness")))


@query("g10_caller_counts", f"WITH {CALLERS} SELECT * FROM counts")
def g10_caller_counts(spark, sf):
    return G.caller_counts(rel(spark, sf, "symbols"), rel(spark, sf, "edges"))


@query("g11_cycles", f"""
    WITH RECURSIVE {HOPS}, v AS (SELECT src, dst FROM hops WHERE confidence <> 'ambiguous' AND NOT ruled_out),
    walk AS (SELECT src AS origin, dst AS node FROM v UNION SELECT w.origin, v.dst FROM walk w JOIN v ON v.src = w.node)
    SELECT DISTINCT origin AS node FROM walk WHERE origin = node""")
def g11_cycles(spark, sf):
    hops = _hops(spark, sf).withColumn("confidence", F.when(F.col("confidence") == "textual", "resolved").otherwise("ambiguous"))
    return G.cycles(hops)


@query("g12_boundary_ambiguity", """
    WITH n AS (SELECT qn, line_start, line_end, lead(qn) OVER w AS nx, lead(line_start) OVER w AS s, lead(line_end) OVER w AS e
        FROM symbols WINDOW w AS (PARTITION BY path ORDER BY line_start, line_end, qn)),
    m AS (SELECT * FROM n WHERE line_end >= s AND NOT (s > line_start AND e <= line_end))
    SELECT qn FROM m UNION SELECT nx FROM m""")
def g12_boundary_ambiguity(spark, sf):
    return G.boundary_ambiguous(rel(spark, sf, "symbols"))


@query("g13_churn", """
    WITH n AS (SELECT path, count(DISTINCT commit_id) AS commits FROM commits GROUP BY path)
    SELECT path, commits, round(commits / greatest(max(commits) OVER (), 1), 6) AS churn FROM n""")
def g13_churn(spark, sf):
    return G.churn_scores(rel(spark, sf, "commits"))


@query("g15_unique_types", """
    WITH r AS (SELECT DISTINCT qn AS from_qn, name || '' AS target_name, language FROM symbols),
    one AS (SELECT name AS target_name, language, min(qn) AS target_qn FROM symbols WHERE kind = 'class' GROUP BY ALL HAVING count(*) = 1)
    SELECT from_qn, target_name, language, target_qn FROM r LEFT JOIN one USING (target_name, language)""")
def g15_unique_types(spark, sf):
    s = rel(spark, sf, "symbols")
    return G.unique_type_targets(s.select(F.col("qn").alias("from_qn"), F.col("name").alias("target_name"), "language").distinct(), s.where("kind = 'class'"))


@query("g18_file_dependencies", """
    SELECT DISTINCT from_path AS path, 'imports' AS direction, to_path AS other FROM imports WHERE to_path IS NOT NULL
    UNION ALL SELECT DISTINCT to_path, 'imported_by', from_path FROM imports WHERE to_path IS NOT NULL""")
def g18_file_dependencies(spark, sf):
    return G.file_dependencies(rel(spark, sf, "imports"))


@query("g20_frontier", """
    WITH explored AS (SELECT 'm' || n_nationkey AS path FROM nation WHERE n_regionkey = 0),
    i AS (SELECT DISTINCT from_path AS path FROM imports WHERE to_path IN (SELECT path FROM explored)),
    c AS (SELECT DISTINCT to_path AS path FROM imports WHERE from_path IN (SELECT path FROM explored) AND to_path IS NOT NULL)
    SELECT path, CASE WHEN i.path IS NOT NULL AND c.path IS NOT NULL THEN 'both' WHEN i.path IS NOT NULL THEN 'imported_by' ELSE 'callers' END AS reason
    FROM i FULL JOIN c USING (path) WHERE path NOT IN (SELECT path FROM explored)""")
def g20_frontier(spark, sf):
    imports = rel(spark, sf, "imports").where("to_path is not null")
    explored = rel(spark, sf, "nation").where("n_regionkey = 0").select(F.concat(F.lit("m"), "n_nationkey").alias("path"))
    return G.frontier(imports, imports.select(F.col("to_path").alias("src_path"), F.col("from_path").alias("dst_path")), explored)


@query("g21_co_changes", """
    WITH c AS (SELECT DISTINCT commit_id, day, path FROM commits),
    p AS (SELECT a.path, b.path AS other, count(*) AS n, max(a.day) AS last FROM c a JOIN c b ON a.commit_id = b.commit_id AND a.path <> b.path GROUP BY ALL HAVING count(*) >= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, other) AS place FROM p)
    SELECT * FROM r WHERE place <= 5""")
def g21_co_changes(spark, sf):
    return G.co_changes(rel(spark, sf, "commits"))


@query("w10_etag", """
    SELECT dst, sha256(string_agg(src || chr(1) || line || chr(1) || confidence || chr(2), '' ORDER BY src_path, line, src, confidence)) AS etag FROM edges WHERE NOT ruled_out GROUP BY dst""")
def w10_etag(spark, sf):
    return G.etag(G.live(rel(spark, sf, "edges")), "dst", ["src_path", "line", "src", "confidence"], ["src", "line", "confidence"])
