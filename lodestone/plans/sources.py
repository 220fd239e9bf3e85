"""Queries over source texts and report files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..loops import shared
from ..projections import rel
from ..registry import query
from ..sources import code as C
from ..sources import readers as R


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def by_language(patterns: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN language = '{k}' THEN regexp_extract(line, {q(p)}, 1)" for k, p in patterns.items()) + " ELSE '' END"


_EACH = [(language, kind, p) for language, patterns in C.SYMBOLS.items() for kind, p in patterns.items()]
_KIND = "CASE " + " ".join(f"WHEN language = '{a}' AND regexp_matches(line, {q(p)}) THEN '{k}'" for a, k, p in _EACH) + " END"
_NAME = "CASE " + " ".join(f"WHEN language = '{a}' AND regexp_matches(line, {q(p)}) THEN regexp_extract(line, {q(p)}, 1)" for a, _, p in _EACH) + " END"
LINES = "ls AS (SELECT path, language, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM files)"
OWNED = f"""{LINES}, named AS (SELECT *, {_KIND} AS kind, {_NAME} AS name FROM ls),
    own AS (SELECT *, last_value(name IGNORE NULLS) OVER w AS owner, last_value(CASE WHEN name IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS owner_line FROM named WINDOW w AS (PARTITION BY path ORDER BY line_no))"""
SYMBOLS = f"""{OWNED}, syms AS (SELECT path, language, max(kind) AS kind, owner AS name, owner_line AS line_start, max(line_no) AS line_end, 1 + sum(len(regexp_extract_all(line, {q(C.BRANCH)}))) AS complexity
    FROM own WHERE owner IS NOT NULL GROUP BY path, language, owner, owner_line)"""
CALLS = f"""made AS (SELECT path, owner, owner_line, line_no, name, unnest(regexp_extract_all(line, {q(C.CALL)}, 1)) AS callee FROM own WHERE language <> 'sql'),
    sites AS (SELECT * FROM made WHERE callee NOT IN ({", ".join(map(q, C.NO_CALLS))}) AND callee IS DISTINCT FROM name)"""


@query("b03_symbols", f"WITH {SYMBOLS} SELECT path, language, kind, name, line_start, line_end FROM syms")
def b03_symbols(spark, sf):
    return C.symbols(rel(spark, sf, "files")).drop("complexity")


@query("b07_complexity", f"WITH {SYMBOLS} SELECT path, name, line_start, complexity FROM syms")
def b07_complexity(spark, sf):
    return C.symbols(rel(spark, sf, "files")).select("path", "name", "line_start", "complexity")


@query("b05_calls", f"WITH {OWNED}, {CALLS} SELECT path, owner AS caller, line_no AS line, callee FROM sites")
def b05_calls(spark, sf):
    return C.calls(rel(spark, sf, "files"))


@query("b06_imports", f"WITH {LINES} SELECT * FROM (SELECT path, language, line_no AS line, {by_language(C.IMPORTS)} AS module FROM ls) WHERE module <> ''")
def b06_imports(spark, sf):
    return C.imports(rel(spark, sf, "files"))


@query("b08_b09_marks", f"""
    WITH {OWNED} SELECT path, name, line_no AS line,
        regexp_matches(lower(path), '(^|/)(tests?/|test_)') OR CASE language WHEN 'go' THEN regexp_matches(name, '^(Test|Benchmark)[A-Z0-9]') WHEN 'java' THEN name LIKE '%Test' ELSE starts_with(name, 'test_') END AS is_test,
        CASE language WHEN 'python' THEN regexp_matches(name, '^__.+__$') WHEN 'go' THEN name IN ('main', 'init') WHEN 'rust' THEN name = 'main' WHEN 'java' THEN contains(line, 'public static void main')
            WHEN 'typescript' THEN name = 'main' OR starts_with(ltrim(line), 'export default') ELSE false END AS is_entry
    FROM own WHERE name IS NOT NULL AND language <> 'sql'""")
def b08_b09_marks(spark, sf):
    return C.marked_symbols(rel(spark, sf, "files"))


@query("b10_type_relations", f"""
    WITH {LINES}, r AS (SELECT path, line_no AS line, 'extends' AS relation, {by_language(C.EXTENDS)} AS names FROM ls UNION ALL SELECT path, line_no, 'implements', {by_language(C.IMPLEMENTS)} FROM ls)
    SELECT * FROM (SELECT path, line, relation, trim(unnest(string_split(names, ','))) AS target FROM r WHERE names <> '') WHERE target <> ''""")
def b10_type_relations(spark, sf):
    return C.type_relations(rel(spark, sf, "files"))


@query("b11_effects", f"""
    WITH {OWNED}, e AS (SELECT path, line_no AS line, owner, 'explicit_throw' AS effect, {by_language(C.THROWS)} AS target FROM own UNION ALL SELECT path, line_no, owner, 'write_field', {by_language(C.WRITES)} FROM own)
    SELECT * FROM e WHERE target <> ''""")
def b11_effects(spark, sf):
    return C.effects(rel(spark, sf, "files"))


@query("b13_sql_uses", f"""
    WITH {SYMBOLS}, u AS (SELECT path, line_no AS line, 'reference' AS use, unnest(regexp_extract_all(line, {q(C.SQL_USES['reference'])}, 1)) AS target FROM ls WHERE language = 'sql'
        UNION ALL SELECT path, line_no, 'call', unnest(regexp_extract_all(line, {q(C.SQL_USES['call'])}, 1)) FROM ls WHERE language = 'sql')
    SELECT u.path, u.line, use, target, CASE WHEN EXISTS (SELECT 1 FROM syms s WHERE s.path = u.path AND s.name = u.target) THEN 'resolved' ELSE 'textual' END AS confidence FROM u""")
def b13_sql_uses(spark, sf):
    return C.sql_uses(rel(spark, sf, "files"))


@query("b01_extraction", f"""
    WITH {SYMBOLS}, {CALLS}, n AS (SELECT path, owner_line, count(*) AS n FROM sites WHERE owner IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY line_start) AS k FROM syms)
    SELECT k.path, k.path || '::' || name || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS qn, kind, line_start, coalesce(n, 0) AS n_calls FROM k LEFT JOIN n ON k.path = n.path AND owner_line = line_start""")
def b01_extraction(spark, sf):
    return C.extracted(rel(spark, sf, "files"))


@query("b16_module_targets", f"""
    WITH {LINES}, i AS (SELECT * FROM (SELECT path, language, line_no AS line, {by_language(C.IMPORTS)} AS module FROM ls) WHERE module <> ''),
    m AS (SELECT *, regexp_replace(regexp_replace(module, '^\\./', ''), '\\.|::', '/', 'g') AS base FROM i), b AS (SELECT *, regexp_replace(base, '/[^/]+$', '') AS above FROM m),
    ends AS (SELECT * FROM (VALUES ('python', '.py', 0), ('python', '/__init__.py', 1), ('rust', '.rs', 0), ('rust', '/mod.rs', 1), ('go', '.go', 0), ('java', '.java', 0), ('typescript', '.ts', 0), ('typescript', '/index.ts', 1)) AS t(lang, suffix, place)),
    o AS (SELECT b.*, 'src/' || base || suffix AS option, place AS priority FROM b JOIN ends ON lang = language UNION ALL SELECT b.*, 'src/' || above || suffix, 10 + place FROM b JOIN ends ON lang = language)
    SELECT o.path, language, line, module, min_by(option, priority) FILTER (EXISTS (SELECT 1 FROM files f WHERE f.path = option)) AS target FROM o GROUP BY ALL""")
def b16_module_targets(spark, sf):
    files = rel(spark, sf, "files")
    return C.module_targets(C.imports(files), files)


@query("s05_enclosing_symbol", """
    WITH asked AS (SELECT DISTINCT path, line_start + 3 AS line FROM symbols), m AS (SELECT a.path, a.line, min(struct_pack(span := line_end - line_start, qn := qn)) AS best FROM asked a JOIN symbols s ON s.path = a.path AND a.line BETWEEN line_start AND line_end GROUP BY ALL)
    SELECT a.path, a.line, best.qn AS qn FROM asked a LEFT JOIN m ON a.path = m.path AND a.line = m.line""")
def s05_enclosing_symbol(spark, sf):
    s = rel(spark, sf, "symbols")
    return C.enclosing(s.select("path", (F.col("line_start") + 3).alias("line")), s)


@query("a01_walk")
def a01_walk(spark, sf):
    """The files of the tables' folder; sizes are the file system's, so there is no SQL for it."""
    return R.walk(spark, sf).select(F.element_at(F.split("path", "/"), -1).alias("name"), "size")


@query("a05_file_index", """
    WITH i AS (SELECT o_orderkey AS path, md5(o_orderstatus) AS hash FROM orders), c AS (SELECT l_orderkey + 1 AS path, md5(l_linestatus || l_linenumber) AS hash, l_linenumber AS seq FROM lineitem WHERE l_returnflag = 'R'), last AS (SELECT path, max_by(hash, struct_pack(a := seq, b := hash)) AS hash FROM c GROUP BY path)
    SELECT * FROM i WHERE path NOT IN (SELECT path FROM last) UNION ALL SELECT * FROM last""")
def a05_file_index(spark, sf):
    index = rel(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.md5("o_orderstatus").alias("hash"))
    changes = rel(spark, sf, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") + 1).alias("path"), F.md5(F.concat("l_linestatus", "l_linenumber")).alias("hash"), F.col("l_linenumber").alias("seq"))
    return R.upserted(index, changes)


@query("a10_numbits", """
    WITH b AS (SELECT doc_id, substr(md5(coalesce(text, '')), 1, 8) AS h FROM documents), bytes AS (SELECT doc_id, i, ('0x' || substr(h, 2 * i::INT + 1, 2))::INT AS v FROM b, range(0, 4) t(i))
    SELECT doc_id, (i * 8 + k + 1)::INT AS line FROM bytes, range(0, 8) u(k) WHERE (v >> k::INT) & 1 = 1""")
def a10_numbits(spark, sf):
    return R.numbits(rel(spark, sf, "documents").select("doc_id", F.unhex(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 8)).alias("numbits")))


@query("a13_coverage_discovery", "SELECT l_orderkey AS root, min_by(l_linestatus || l_suppkey, struct_pack(a := l_linenumber, b := l_linestatus || l_suppkey)) AS path FROM lineitem WHERE l_quantity >= 20 GROUP BY 1")
def a13_coverage_discovery(spark, sf):
    c = rel(spark, sf, "lineitem").select(F.col("l_orderkey").alias("root"), F.col("l_linenumber").alias("priority"), F.concat("l_linestatus", "l_suppkey").alias("path"), (F.col("l_quantity") >= 20).alias("readable"))
    return R.discovered(c)


@query("a14_code_owners", r"""
    WITH f AS (SELECT user_id AS root, event_id AS priority, '# owners' || chr(10) || '*.py   @u' || user_id || ' @all' || chr(10) || chr(10) || event_type || '/ @' || event_type AS text FROM events), first AS (SELECT root, min_by(text, priority) AS text FROM f GROUP BY root),
    l AS (SELECT root, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM first), t AS (SELECT root, line_no, string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') AS w FROM l WHERE trim(line) <> '' AND NOT starts_with(line, '#'))
    SELECT root, line_no, w[1] AS pattern, array_to_string(w[2:], ',') AS owners FROM t""")
def a14_code_owners(spark, sf):
    text = F.concat(F.lit("# owners\n*.py   @u"), "user_id", F.lit(" @all\n\n"), "event_type", F.lit("/ @"), "event_type")
    out = R.code_owners(rel(spark, sf, "events").select(F.col("user_id").alias("root"), F.col("event_id").alias("priority"), text.alias("text")))
    return out.withColumn("owners", F.array_join("owners", ","))


@query("a15_toml_manifests", """
    SELECT s_suppkey || '/Cargo.toml' AS path, 'cargo' AS ecosystem, unnest(['serde', 'dep' || s_nationkey, 'mock']) AS name, unnest(['1.' || s_suppkey, '0.' || s_nationkey, '2']) AS version, unnest(['normal', 'normal', 'dev']) AS kind FROM supplier
    UNION ALL SELECT s_suppkey || '/pyproject.toml', 'pypi', unnest(['numpy', 'lib' || s_nationkey]), unnest(['2.' || s_suppkey, '']), 'normal' FROM supplier""")
def a15_toml_manifests(spark, sf):
    s = rel(spark, sf, "supplier")
    cargo = F.concat(F.lit('[package]\nname = "x"\n[dependencies]\nserde = "1.'), "s_suppkey", F.lit('"\ndep'), "s_nationkey", F.lit(' = { version = "0.'), "s_nationkey", F.lit('", features = ["a"] }\n[dev-dependencies]\nmock = "2"\n[features]\nmore = "1"'))
    project = F.concat(F.lit('[project]\nname = "y"\ndependencies = [\n  "numpy>=2.'), "s_suppkey", F.lit('",\n  "lib'), "s_nationkey", F.lit('",\n]\n[tool.other]\n"not" = 1'))
    each = s.select(F.concat("s_suppkey", F.lit("/Cargo.toml")).alias("path"), cargo.alias("text")).unionByName(s.select(F.concat("s_suppkey", F.lit("/pyproject.toml")).alias("path"), project.alias("text")))
    return R.toml_dependencies(each)


@query("a16_thresholds", "SELECT * FROM (VALUES ('max_complexity', 20.0), ('max_callers', 50.0), ('max_cycles', 2.0), ('min_coverage', 0.0)) AS t(name, value)")
def a16_thresholds(spark, sf):
    found = R.thresholds("[thresholds]\nmax_complexity = 20\nmax_cycles = 2\nunknown = 7\n")
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, value double")


@query("a18_bundle", "SELECT 'n' || n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region")
def a18_bundle(spark, sf):
    place = f"{shared(spark)}/bundle-{uuid.uuid4().hex}"
    R.export_bundle({"nation": rel(spark, sf, "nation"), "region": rel(spark, sf, "region")}, place)
    t = R.import_bundle(spark, place)
    return t["nation"].select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_name").alias("name")).unionByName(t["region"].select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.col("r_name").alias("name")))
