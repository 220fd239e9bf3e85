"""Test tables seen as the relations of a code-intelligence store.

Each projection is a SELECT in SQL that Spark and other engines share; operators
never depend on it, only the queries do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # call edges: suppliers call parts; the pair of flags gives the confidence, small quantities are ruled out
    "edges": """
        SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_linenumber AS line, l_orderkey AS site_id,
            CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'formal' WHEN l_returnflag = 'A' THEN 'resolved'
                 WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'inferred' WHEN l_returnflag = 'N' THEN 'textual'
                 WHEN l_linestatus = 'F' THEN 'ambiguous' ELSE 'unresolved' END AS confidence,
            l_quantity < 41 AS ruled_out, 'src/s' || (l_suppkey % 7) || '/s' || l_suppkey || '.py' AS src_path
        FROM lineitem""",
    "symbols": """
        SELECT 'P' || p_partkey AS qn, replace(p_name, ' ', '_') AS name, CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS kind,
            CASE p_size % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'go' ELSE 'java' END AS language,
            CASE WHEN p_size % 10 = 0 THEN 'tests/' WHEN p_size % 11 = 0 THEN 'vendor/' ELSE 'src/' END || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '_') || '.py' AS path,
            (p_partkey % 40) * 5 + 1 AS line_start, (p_partkey % 40) * 5 + 1 + p_size AS line_end,
            CASE WHEN p_size % 5 = 0 THEN 'private fn ' ELSE 'pub fn ' END || replace(p_name, ' ', '_') || '(x)' AS signature,
            p_size % 10 = 0 AS is_test, p_size % 13 = 0 AS is_entry, p_retailprice AS price
        FROM part""",
    # one file per props key; a commit is a user's day
    "commits": """
        SELECT user_id || '@' || CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS commit_id, CASE WHEN user_id % 9 = 0 THEN 'bot' || user_id || '[bot]' ELSE 'u' || user_id END AS author,
            CAST(ts AS DATE) AS day, event_type || '/f' || regexp_extract(props, '([0-9]+)', 1) || '.py' AS path, event_id
        FROM events""",
    "imports": """
        SELECT DISTINCT 'm' || c_nationkey AS from_path, CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE 'm' || s_nationkey END AS to_path
        FROM orders, lineitem, customer, supplier
        WHERE o_orderkey = l_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey""",
    "metrics": """
        SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS snapshot_at, max(o_totalprice) AS callers, count(*) AS coreness, max(o_orderstatus) AS hub
        FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)""",
    # source texts in six languages, a file for each row of the catalogue
    "files": """
        SELECT 'src/' || CASE WHEN k % 3 = 0 THEN 'pkg/' ELSE '' END || CASE WHEN k % 7 = 0 THEN 'tests/' ELSE '' END || 'm' || n || '.' || CASE size % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'rs' WHEN 2 THEN 'go' WHEN 3 THEN 'java' WHEN 4 THEN 'ts' ELSE 'sql' END AS path,
            CASE size % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'go' WHEN 3 THEN 'java' WHEN 4 THEN 'typescript' ELSE 'sql' END AS language, k, n,
            replace(CASE size % 6
                WHEN 0 THEN 'import os~from pkg.m' || k || ' import run~~class Box' || n || '(Base' || k || ', Shape):~    def test_' || k || '(self, x):~        if x and os.path(x):~            raise ValueError(x)~        self.total = run(x)~    def __call__(self):~        return step_' || k || '(self.total == 1)~    def __call__(self):~        return 0'
                WHEN 1 THEN 'use pkg::m' || k || '::run;~~impl Shape for Box' || n || ' {}~pub fn main() {~    if ready() && open_' || k || '(1) { run(2); }~}~fn test_' || k || '() { match step() { _ => done() } }'
                WHEN 2 THEN 'package m' || n || '~import "pkg/m' || k || '"~~type Box' || n || ' struct {}~func Test' || k || '(x int) int {~    for x > 0 || done(x) { x = m.Step(x) }~    return x~}~func (b Box) init() { run() }'
                WHEN 3 THEN 'import pkg.m' || k || '.Run;~~public class Box' || n || 'Test extends Base' || k || ' implements Shape, Named {~    public static void main(String[] a) {~        if (a.size() > 0) { throw new IllegalStateException(a); }~        this.total = Run.go(a);~    }~}'
                WHEN 4 THEN 'import { run } from "./m' || k || '";~~export class Box' || n || ' extends Base' || k || ' implements Shape {~}~export function main(x: number) {~  while (x > 0) { x = run(x); }~  throw new RangeError("x");~}'
                ELSE 'CREATE TABLE t' || k || ' (x INT);~CREATE VIEW v' || n || ' AS SELECT * FROM t' || k || ' JOIN u' || n || ' USING (x);~CREATE PROCEDURE p' || k || ' ();~CALL p' || (k % 5) || '();' END, '~', chr(10)) AS text
        FROM (SELECT p_partkey AS n, p_partkey % 50 AS k, p_size AS size FROM part)""",
    "doc_lines": """SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents""",
}


def expand(sql: str) -> str:
    """SQL with the projections that it names as its first common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    sql = sql.strip()
    if not used:
        return sql
    if m := re.match(r"WITH(\s+RECURSIVE)?\s", sql):
        return f"WITH{m[1] or ''} {ctes}, {sql[m.end():]}"
    return f"WITH {ctes} {sql}"


def rel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a projection."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}
    for t in used:
        sql = re.sub(rf"(FROM|,)(\s+){t}\b", rf"\1\2{{{t}}}", sql)
    return spark.sql(sql, **used)
