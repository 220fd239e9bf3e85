"""Analytics queries over the projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import graph as G
from ..projections import rel
from ..registry import query

#: Symbols with caller counts, coreness standing in as verified callers, and the kind of hub.
FACTS = """
    facts AS (SELECT s.*, c.caller_count, c.verified_caller_count AS coreness, CASE WHEN c.caller_count >= 9 THEN 'degree' END AS hub_kind FROM symbols s JOIN
        (SELECT qn, count(DISTINCT CASE WHEN confidence <> 'ambiguous' THEN src END) AS caller_count, count(DISTINCT CASE WHEN confidence IN ('formal', 'resolved') THEN src END) AS verified_caller_count
         FROM symbols LEFT JOIN edges ON dst = qn AND NOT ruled_out GROUP BY qn) c ON c.qn = s.qn)"""
COMPLEXITY = f"""{FACTS},
    cx AS (SELECT path, count(*) AS symbols, count(hub_kind) AS hubs, count(*) FILTER (coreness > 0) AS connected, round(avg(caller_count), 6) AS avg_callers, max(language) AS language FROM facts WHERE NOT is_test GROUP BY path)"""
#: A file's churn: orders of the customers that bought its parts.
CHURN = """churn AS (SELECT path, count(DISTINCT l_orderkey) AS commits FROM lineitem JOIN symbols ON qn = 'P' || l_partkey GROUP BY path)"""


def facts(spark, sf):
    s = rel(spark, sf, "symbols")
    c = G.caller_counts(s, rel(spark, sf, "edges")).withColumnRenamed("verified_caller_count", "coreness")
    return s.join(c.hint("merge"), "qn").withColumn("hub_kind", F.when(F.col("caller_count") >= 9, "degree"))


def churn(spark, sf):
    li = rel(spark, sf, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("qn"), "l_orderkey")
    return li.join(rel(spark, sf, "symbols").select("qn", "path"), "qn").groupBy("path").agg(F.count_distinct("l_orderkey").alias("commits"))


@query("d01_complexity", f"WITH {COMPLEXITY} SELECT * FROM cx")
def d01_complexity(spark, sf):
    return A.complexity_per_file(facts(spark, sf))


@query("d02_complexity_score", f"WITH {COMPLEXITY} SELECT path, round(0.3 * symbols + 3.0 * hubs + 1.5 * connected + 0.5 * avg_callers, 4) AS complexity FROM cx")
def d02_complexity_score(spark, sf):
    return A.complexity_per_file(facts(spark, sf)).select("path", F.round(A.complexity_score(), 4).alias("complexity"))


@query("d03_file_signals", """
    SELECT path, count(DISTINCT commit_id) AS commits, count(DISTINCT author) AS authors, count(DISTINCT CASE WHEN contains(author, '[bot]') THEN commit_id END) AS bot_commits, max(day) AS last_changed FROM commits GROUP BY path""")
def d03_file_signals(spark, sf):
    return A.file_signals(rel(spark, sf, "commits"))


@query("d05_hotspots", f"""
    WITH {COMPLEXITY}, {CHURN}, r AS (SELECT path, commits, 0.3 * symbols + 3.0 * hubs + 1.5 * connected + 0.5 * avg_callers AS complexity FROM cx JOIN churn USING (path)),
    s AS (SELECT path, commits, round(complexity, 4) AS complexity, round(complexity / greatest(max(complexity) OVER (), 1) * commits / greatest(max(commits) OVER (), 1), 4) AS score FROM r)
    SELECT *, CASE WHEN score >= 0.75 THEN 'critical' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END AS level FROM s""")
def d05_hotspots(spark, sf):
    return A.hotspots(A.complexity_per_file(facts(spark, sf)), churn(spark, sf))


@query("d06_top_symbols", f"""
    WITH {FACTS}, r AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY caller_count DESC, coreness DESC, qn) AS place, qn, caller_count, coreness FROM facts) SELECT * FROM r WHERE place <= 5""")
def d06_top_symbols(spark, sf):
    return A.top_symbols(facts(spark, sf))


@query("d07_absolute_risk", f"""
    WITH {COMPLEXITY}, {CHURN} SELECT round(max(least(commits / 50, 1.0) * least((0.3 * symbols + 3.0 * hubs + 1.5 * connected + 0.5 * avg_callers) / 150, 1.0)), 6) AS risk FROM cx JOIN churn USING (path)""")
def d07_absolute_risk(spark, sf):
    return A.absolute_hotspot_risk(A.complexity_per_file(facts(spark, sf)), churn(spark, sf))


@query("d08_coupling", """
    WITH i AS (SELECT DISTINCT * FROM imports WHERE to_path IS NOT NULL), ce AS (SELECT from_path AS path, count(*) AS ce FROM i GROUP BY 1), ca AS (SELECT to_path AS path, count(*) AS ca FROM i GROUP BY 1),
    t AS (SELECT 'm' || s_nationkey AS path, count(*) AS types, count(*) FILTER (s_acctbal < 2000) AS abstract_types FROM supplier GROUP BY 1),
    b AS (SELECT path, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM ca FULL JOIN ce USING (path))
    SELECT path, ca, ce, round(ce / (ca + ce), 6) AS instability, round(abstract_types / types, 6) AS abstractness, round(abs(abstract_types / types + ce / (ca + ce) - 1), 6) AS distance FROM b LEFT JOIN t USING (path)""")
def d08_coupling(spark, sf):
    types = rel(spark, sf, "supplier").groupBy(F.concat(F.lit("m"), "s_nationkey").alias("path")).agg(F.count("*").alias("types"), F.count_if(F.col("s_acctbal") < 2000).alias("abstract_types"))
    return A.coupling(rel(spark, sf, "imports"), types)


@query("d09_boundary_violations", """
    WITH rules(from_prefix, to_prefix) AS (VALUES ('m1', 'm2'), ('m', 'm7'), ('m0', 'm0'))
    SELECT DISTINCT from_path, to_path, from_prefix, to_prefix FROM imports JOIN rules ON starts_with(from_path, from_prefix) AND starts_with(to_path, to_prefix) WHERE to_path IS NOT NULL""")
def d09_boundary_violations(spark, sf):
    rules = spark.createDataFrame([("m1", "m2"), ("m", "m7"), ("m0", "m0")], "from_prefix string, to_prefix string")
    return A.boundary_violations(rel(spark, sf, "imports"), rules)


PRIVATE = "CASE language WHEN 'python' THEN starts_with(name, '_') WHEN 'rust' THEN NOT contains(signature, 'pub ') WHEN 'go' THEN regexp_matches(name, '^[a-z]') WHEN 'java' THEN contains(signature, 'private ') ELSE false END"
#: A file's covered lines: line numbers of its parts' returned items.
COVERED = """lines AS (SELECT DISTINCT path, l_linenumber * 20 AS line FROM lineitem JOIN symbols ON qn = 'P' || l_partkey WHERE l_returnflag = 'R' AND l_discount >= 0.08),
    cov AS (SELECT DISTINCT qn FROM symbols JOIN lines USING (path) WHERE line BETWEEN line_start AND line_end)"""
DEAD = f"""dead AS (SELECT f.qn, CASE WHEN kind NOT IN ('function', 'method') OR is_entry OR is_test OR caller_count > 0 THEN 'none' WHEN f.qn IN (SELECT qn FROM cov) THEN 'low'
    WHEN {PRIVATE} THEN 'high' WHEN price > 1000 THEN 'medium' ELSE 'low' END AS dead_code FROM facts f)"""


def lines(spark, sf):
    li = rel(spark, sf, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.08").select(F.concat(F.lit("P"), "l_partkey").alias("qn"), (F.col("l_linenumber") * 20).alias("line"))
    return li.join(rel(spark, sf, "symbols").select("qn", "path").hint("merge"), "qn").select("path", "line").distinct()


#: Edges thinned further, so that some symbols have no caller.
RARE = FACTS.replace("NOT ruled_out", "NOT ruled_out AND line = 7")


def rare_facts(spark, sf):
    s = rel(spark, sf, "symbols")
    c = G.caller_counts(s, rel(spark, sf, "edges").where("line = 7")).withColumnRenamed("verified_caller_count", "coreness")
    return s.join(c.hint("merge"), "qn").withColumn("hub_kind", F.when(F.col("caller_count") >= 9, "degree"))


def dead(spark, sf):
    f = rare_facts(spark, sf)
    cov = A.covered(f, lines(spark, sf)).withColumn("covered", F.lit(True))
    full = f.join(cov, "qn", "left").withColumn("covered", F.coalesce("covered", F.lit(False))).withColumn("scope_clear", F.col("price") > 1000)
    return full.join(A.dead_code(full), "qn")


@query("d10_dead_code", f"WITH {RARE}, {COVERED}, {DEAD} SELECT * FROM dead")
def d10_dead_code(spark, sf):
    return dead(spark, sf).select("qn", "dead_code")


@query("d11_private_symbols", f"SELECT qn, {PRIVATE} AS private FROM symbols")
def d11_private_symbols(spark, sf):
    return rel(spark, sf, "symbols").select("qn", A.is_private().alias("private"))


@query("d12_covered_symbols", f"WITH {COVERED} SELECT qn FROM cov")
def d12_covered_symbols(spark, sf):
    return A.covered(rel(spark, sf, "symbols"), lines(spark, sf))


@query("d13_ownership_entropy", """
    WITH a AS (SELECT path, author, count(DISTINCT commit_id) AS n FROM commits GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY path) AS p FROM a),
    h AS (SELECT path, sum(n)::BIGINT AS commits, count(*) AS authors, sum(-p * log2(p)) AS h FROM p GROUP BY path)
    SELECT path, commits, round(CASE WHEN commits < 2 THEN NULL WHEN authors <= 1 THEN 0.0 ELSE least(1.0, greatest(0.0, h / log2(authors))) END, 6) AS entropy FROM h""")
def d13_ownership_entropy(spark, sf):
    return A.ownership_entropy(rel(spark, sf, "commits"))


OWNERS = (("*.py", "@py"), ("src/", "@src"), ("src/brand1/", "@one"), ("tests/", "@qa"), ("small_*.py", "@small"), ("src/brand2/*", "@two"))


@query("d14_owners", """
    WITH rules(line_no, regex, owner) AS (VALUES (1, '^(?:.*/)?[^/]*\\.py$', '@py'), (2, '^(?:.*/)?src/', '@src'), (3, '^src/brand1/', '@one'), (4, '^(?:.*/)?tests/', '@qa'), (5, '^(?:.*/)?small_[^/]*\\.py$', '@small'), (6, '^src/brand2/[^/]*$', '@two'))
    SELECT path, max_by(owner, line_no) AS owners FROM (SELECT DISTINCT path FROM symbols) LEFT JOIN rules ON regexp_matches(path, regex) GROUP BY path""")
def d14_owners(spark, sf):
    rules = spark.createDataFrame([(i, A.owner_pattern(p), o) for i, (p, o) in enumerate(OWNERS, 1)], "line_no int, regex string, owners string")
    return A.owners_of(rel(spark, sf, "symbols").select("path").distinct(), rules)


FITNESS = f"""WITH {RARE}, s AS (SELECT count(hub_kind) AS hub_count, count(*) FILTER (kind <> 'class') AS callables, avg(coreness) FILTER (coreness > 0) AS core,
        count(*) FILTER (kind <> 'class' AND caller_count = 0 AND NOT is_test AND NOT is_entry) AS dead FROM facts), e AS (SELECT count(DISTINCT dst) AS with_edges FROM edges WHERE NOT ruled_out),
    m AS (SELECT hub_count, round(100.0 * hub_count / callables, 4) AS hub_pct, round(coalesce(core, 0), 4) AS avg_coreness, round(100.0 * dead / callables, 4) AS dead_code_pct, round(100.0 * with_edges / callables, 4) AS edge_coverage_pct FROM s, e)"""


@query("d16_fitness_metrics", f"{FITNESS} SELECT * FROM m")
def d16_fitness_metrics(spark, sf):
    return A.fitness_metrics(rare_facts(spark, sf), G.live(rel(spark, sf, "edges")))


@query("d17_fitness_check", f"""{FITNESS}, t(metric, threshold) AS (VALUES ('hub_count', 1000.0), ('hub_pct', 20.0), ('avg_coreness', 15.0), ('dead_code_pct', 10.0), ('edge_coverage_pct', 60.0)),
    u AS (UNPIVOT (SELECT hub_count::DOUBLE AS hub_count, hub_pct::DOUBLE AS hub_pct, avg_coreness::DOUBLE AS avg_coreness, dead_code_pct::DOUBLE AS dead_code_pct, edge_coverage_pct::DOUBLE AS edge_coverage_pct FROM m) ON hub_count, hub_pct, avg_coreness, dead_code_pct, edge_coverage_pct INTO NAME metric VALUE value)
    SELECT metric, value, threshold::DOUBLE AS threshold, CASE metric WHEN 'edge_coverage_pct' THEN value >= threshold ELSE value <= threshold END AS passed FROM u JOIN t USING (metric)""")
def d17_fitness_check(spark, sf):
    return A.fitness(d16_fitness_metrics(spark, sf))


@query("d18_trend", """
    WITH now AS (SELECT symbol, snapshot_at AS today, callers, hub FROM metrics),
    b AS (SELECT n.symbol, n.today, n.callers, n.hub, max(m.snapshot_at) AS baseline FROM now n LEFT JOIN metrics m ON m.symbol = n.symbol AND m.snapshot_at <= n.today - 7 GROUP BY ALL)
    SELECT b.symbol, today, baseline, round(b.callers - m.callers, 4) AS delta, b.hub <> m.hub AS hub_changed FROM b LEFT JOIN metrics m ON m.symbol = b.symbol AND m.snapshot_at = b.baseline""")
def d18_trend(spark, sf):
    m = rel(spark, sf, "metrics")
    return A.trend(m.select("symbol", F.col("snapshot_at").alias("today"), "callers", "hub"), m)


@query("d19_retention", "SELECT symbol, snapshot_at, callers FROM metrics WHERE snapshot_at >= DATE '1998-01-01' - 180")
def d19_retention(spark, sf):
    return A.retained(rel(spark, sf, "metrics"), F.lit("1998-01-01").cast("date")).select("symbol", "snapshot_at", "callers")


@query("a19_new_snapshots", """
    SELECT symbol, snapshot_at, callers FROM metrics m WHERE NOT EXISTS (SELECT 1 FROM metrics h WHERE h.symbol = m.symbol AND h.snapshot_at = m.snapshot_at AND h.hub = 'F')""")
def a19_new_snapshots(spark, sf):
    m = rel(spark, sf, "metrics")
    return A.new_snapshots(m, m.where("hub = 'F'").select("symbol", "snapshot_at")).select("symbol", "snapshot_at", "callers")


@query("d20_test_gaps", f"""
    WITH {RARE}, {COVERED}, {DEAD}, pool AS (SELECT f.*, dead_code FROM facts f JOIN dead USING (qn) WHERE NOT is_test AND kind IN ('function', 'method') AND coreness > 0 ORDER BY coreness DESC, caller_count DESC, qn LIMIT 300),
    t AS (SELECT DISTINCT dst AS qn FROM edges WHERE NOT ruled_out AND src_path LIKE 'src/s3/%')
    SELECT qn, coreness, caller_count FROM pool WHERE dead_code IN ('medium', 'high') OR qn NOT IN (SELECT qn FROM t) ORDER BY coreness DESC, caller_count DESC, qn LIMIT 20""")
def d20_test_gaps(spark, sf):
    tested = G.live(rel(spark, sf, "edges")).where(F.col("src_path").startswith("src/s3/")).select(F.col("dst").alias("qn"))
    return A.test_gaps(dead(spark, sf), tested)


@query("d21_overview", """
    SELECT split_part(path, '/', 1) AS module, language, count(DISTINCT path) AS files, count(*) AS symbols, count(*) FILTER (is_test) AS tests, count(*) FILTER (is_entry) AS entries FROM symbols GROUP BY ALL""")
def d21_overview(spark, sf):
    return rel(spark, sf, "symbols").groupBy(F.split("path", "/")[0].alias("module"), "language").agg(F.count_distinct("path").alias("files"), F.count("*").alias("symbols"), F.count_if("is_test").alias("tests"), F.count_if("is_entry").alias("entries"))


@query("d22_file_overview", "WITH r AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY line_start, qn) AS place, count(*) OVER (PARTITION BY path) AS n_symbols, qn, kind FROM symbols) SELECT * FROM r WHERE place <= 40")
def d22_file_overview(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("path")
    out = rel(spark, sf, "symbols").select("path", F.row_number().over(w.orderBy("line_start", "qn")).alias("place"), F.count("*").over(w).alias("n_symbols"), "qn", "kind")
    return out.where("place <= 40")


@query("d24_log_report", """
    WITH l AS (SELECT CASE WHEN event_type = 'error' THEN 'broken ' || props ELSE '{"kind": "' || event_type || '", ' || substr(props, 2) END AS line FROM events)
    SELECT CASE WHEN NOT json_valid(line) THEN 'unreadable' WHEN line->>'$.kind' = 'purchase' THEN 'target' ELSE 'other' END AS bucket, count(*) AS n, sum(CASE WHEN json_valid(line) THEN (line->>'$.k')::BIGINT END)::BIGINT AS total FROM l GROUP BY 1""")
def d24_log_report(spark, sf):
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), "props")).otherwise(F.concat(F.lit('{"kind": "'), "event_type", F.lit('", '), F.expr("substr(props, 2)")))
    return A.log_report(rel(spark, sf, "events").select(line.alias("line")), "purchase")


HASHES = """o AS (SELECT doc_id AS path, md5(coalesce(text, '')) AS hash FROM documents WHERE lang <> 'fr'), n AS (SELECT doc_id AS path, md5(CASE WHEN source = 'src3' THEN 'x' ELSE '' END || coalesce(text, '')) AS hash FROM documents WHERE lang <> 'es')"""


def _hashes(spark, sf):
    d = rel(spark, sf, "documents").select(F.col("doc_id").alias("path"), "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    old = d.where("lang <> 'fr'").select("path", F.md5("text").alias("hash"))
    return old, d.where("lang <> 'es'").select("path", F.md5(F.concat(F.when(F.col("source") == "src3", "x").otherwise(""), "text")).alias("hash"))


@query("a06_change_set", f"""
    WITH {HASHES} SELECT path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'changed' ELSE 'unchanged' END AS change FROM o FULL JOIN n USING (path)""")
def a06_change_set(spark, sf):
    return A.change_set(*_hashes(spark, sf))


@query("d28_freshness", f"""
    WITH {HASHES}, c AS (SELECT count(*) FILTER (o.hash = n.hash) AS same, count(*) FILTER (o.hash IS DISTINCT FROM n.hash) AS drift FROM o FULL JOIN n USING (path)), i AS (SELECT count(*) AS indexed FROM o)
    SELECT CASE WHEN indexed = 0 THEN 'needs_baseline' WHEN drift > 0 THEN 'stale' ELSE 'ready' END AS status, indexed, same, drift FROM c, i""")
def d28_freshness(spark, sf):
    return A.freshness(*_hashes(spark, sf))


@query("d29_recent_authors", """
    WITH c AS (SELECT path, commit_id, author, max(event_id) AS ev FROM commits GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ev DESC, commit_id) AS place FROM c),
    b AS (SELECT path, author, min(place) AS place FROM l WHERE place <= 10 GROUP BY ALL), r AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY place) AS rank, author FROM b)
    SELECT * FROM r WHERE rank <= 3""")
def d29_recent_authors(spark, sf):
    return A.recent_authors(rel(spark, sf, "commits"))


@query("d30_returns_option", """
    WITH s AS (SELECT qn, 'fn f(x) -> ' || CASE language WHEN 'rust' THEN 'std::Option<' || name || '>' WHEN 'go' THEN 'Result (' || name || ')' WHEN 'java' THEN 'OptionX<T>' ELSE name END AS signature FROM symbols)
    SELECT qn, regexp_extract(regexp_extract(signature, '.*->\\s*([^<\\s(]*)', 1), '([^:]*)$', 1) IN ('Option', 'Result') AS fallible FROM s""")
def d30_returns_option(spark, sf):
    base = F.when(F.col("language") == "rust", F.concat(F.lit("std::Option<"), "name", F.lit(">"))).when(F.col("language") == "go", F.concat(F.lit("Result ("), "name", F.lit(")"))).when(F.col("language") == "java", F.lit("OptionX<T>")).otherwise(F.col("name"))
    return rel(spark, sf, "symbols").withColumn("signature", F.concat(F.lit("fn f(x) -> "), base)).select("qn", A.returns_option_or_result().alias("fallible"))
