"""Queries of edits: texts before and after, hunks applied, replacements, syntax, risk of touched places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as E
from ..operators import graph as G
from ..projections import rel
from ..registry import query
from .analytics import FACTS, facts
from .risk import HUNKS, hunks

DOCS = "d AS (SELECT doc_id AS path, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)"


def docs(spark, sf):
    return rel(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))


@query("r04_signature_texts", """
    WITH diff AS (SELECT l_orderkey AS change_id, path, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS sign, line_start AS line, signature || l_linenumber AS text FROM lineitem JOIN symbols ON qn = 'P' || l_partkey)
    SELECT change_id, s.qn, coalesce(string_agg(text, chr(10) ORDER BY line, text) FILTER (sign = '-'), '') AS before, coalesce(string_agg(text, chr(10) ORDER BY line, text) FILTER (sign = '+'), '') AS after FROM diff JOIN symbols s ON s.path = diff.path AND s.line_start = diff.line GROUP BY ALL""")
def r04_signature_texts(spark, sf):
    s = rel(spark, sf, "symbols")
    li = rel(spark, sf, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("qn"), F.col("l_orderkey").alias("change_id"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("sign"), "l_linenumber")
    diff = li.join(s.hint("merge"), "qn").select("change_id", "path", "sign", F.col("line_start").alias("line"), F.concat("signature", "l_linenumber").alias("text"))
    return E.signature_texts(diff, s)


@query("r05_new_symbol", f"""
    WITH {FACTS} SELECT qn, CASE WHEN starts_with(path, 'tests/') THEN true WHEN caller_count > 0 OR line_start % 4 = 0 THEN false ELSE language <> 'go' END AS is_new FROM facts""")
def r05_new_symbol(spark, sf):
    added = F.when(F.col("language") == "go", F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.col("signature")))
    new = E.is_new_symbol(F.col("path").startswith("tests/"), F.col("caller_count"), F.col("line_start") % 4 == 0, F.array("signature"), added)
    return facts(spark, sf).select("qn", new.alias("is_new"))


@query("r09_doc_only", r"""
    WITH c AS (SELECT qn, CASE WHEN price % 3 < 1 THEN 'docs/' || name || '.md' ELSE path END AS path, '/// old' || chr(10) || signature AS o, CASE WHEN price % 5 < 2 THEN '/// new' || chr(10) || signature ELSE '/// old' || chr(10) || signature || 'x' END AS n FROM symbols)
    SELECT qn, ends_with(path, '.md') OR regexp_replace(regexp_replace(o, '(?m)^\s*///.*$', '', 'g'), '\s+', '', 'g') = regexp_replace(regexp_replace(n, '(?m)^\s*///.*$', '', 'g'), '\s+', '', 'g') AS doc_only FROM c""")
def r09_doc_only(spark, sf):
    s = rel(spark, sf, "symbols")
    path = F.when(F.col("price") % 3 < 1, F.concat(F.lit("docs/"), "name", F.lit(".md"))).otherwise(F.col("path"))
    old = F.concat(F.lit("/// old\n"), "signature")
    new = F.when(F.col("price") % 5 < 2, F.concat(F.lit("/// new\n"), "signature")).otherwise(F.concat(old, F.lit("x")))
    return s.select("qn", E.observed_doc_only(old, new, path).alias("doc_only"))


@query("r13_touch_risk", f"""
    WITH {FACTS}, {HUNKS}, m AS (SELECT change_id, f.qn, caller_count, hub_kind IS NOT NULL AS is_hub, new_start <= line_start AS signature FROM hunks h JOIN facts f USING (path) WHERE NOT (new_end < line_start OR new_start > line_end))
    SELECT change_id, count(DISTINCT qn) AS n_symbols, max(caller_count) AS max_callers, max(is_hub) AS touches_hub, CASE WHEN max(caller_count) > 10 OR max(is_hub) OR max(signature) THEN 'high' WHEN max(caller_count) > 3 THEN 'medium' ELSE 'low' END AS risk FROM m GROUP BY change_id""")
def r13_touch_risk(spark, sf):
    return E.touch_risk(hunks(spark, sf), facts(spark, sf).withColumn("is_hub", F.col("hub_kind").isNotNull()))


@query("r17_blast_radius", "SELECT dst, count(DISTINCT src) AS n_callers, count(DISTINCT src_path) AS n_files FROM edges WHERE NOT ruled_out AND confidence <> 'ambiguous' GROUP BY dst")
def r17_blast_radius(spark, sf):
    return E.blast_radius(rel(spark, sf, "edges"))


@query("r18_edit_risk", f"""
    WITH {FACTS} SELECT qn, CASE WHEN caller_count > 10 THEN 'high' WHEN caller_count > 3 OR (caller_count = 0 AND line_start % 2 = 0) OR kind = 'class' THEN 'medium' ELSE 'low' END AS risk FROM facts""")
def r18_edit_risk(spark, sf):
    return facts(spark, sf).select("qn", E.edit_risk(F.col("caller_count"), F.col("line_start") % 2 == 0, F.when(F.col("kind") == "class", 0.0).otherwise(1.0)).alias("risk"))


@query("r19_apply_hunks", f"""
    WITH {DOCS}, k AS (SELECT *, CASE WHEN len(ls) < 3 THEN 'invalid' WHEN path % 5 = 0 THEN 'conflict' ELSE 'applied' END AS status FROM d)
    SELECT path, status, CASE WHEN status = 'applied' THEN array_to_string(list_concat(list_concat(['first', 'more'], ls[2:2]), list_concat(['third'], ls[4:])), chr(10)) ELSE text END AS text FROM k""")
def r19_apply_hunks(spark, sf):
    """Line 1 becomes two lines, line 3 another; a fifth of the documents expects another line."""
    d = docs(spark, sf)
    lines = F.split("text", "\n")
    hunk = lambda at, expected, new: F.struct(F.lit(at).alias("start"), F.lit(at).alias("end"), expected.alias("expected"), F.array(*map(F.lit, new)).alias("lines"))
    third = F.coalesce(F.get(lines, F.lit(2)), F.lit(""))
    first = F.when(F.col("path") % 5 == 0, F.concat(lines[0], F.lit("?"))).otherwise(lines[0])
    return E.apply_hunks(d.withColumn("hunks", F.array(hunk(3, third, ["third"]), hunk(1, first, ["first", "more"]))))


@query("r21_find_and_replace", f"""
    WITH {DOCS}, w AS (SELECT *, array_to_string(ls[2:5], chr(10)) AS win FROM d), p AS (SELECT *, string_split(win, 'the ') AS ps FROM w)
    SELECT path, CASE len(ps) - 1 WHEN 0 THEN 'not_found' WHEN 1 THEN 'replaced' ELSE 'ambiguous' END AS status,
        CASE WHEN len(ps) > 2 THEN array_to_string(list_transform(range(1, len(ps)), lambda k: len(string_split(array_to_string(ps[1:k], 'the '), chr(10))) + 1), ',') END AS match_lines,
        CASE WHEN len(ps) = 2 THEN array_to_string(list_concat(list_concat(ls[1:1], [replace(win, 'the ', 'a ')]), ls[6:]), chr(10)) END AS text FROM p""")
def r21_find_and_replace(spark, sf):
    d = docs(spark, sf).select("path", E.find_and_replace(F.col("text"), 2, 5, "the ", "a ").alias("r"))
    return d.select("path", "r.status", F.array_join("r.match_lines", ",").alias("match_lines"), F.col("r.text").alias("text"))


@query("r27_syntax_verdict", """
    WITH z AS (SELECT o_orderkey AS path, 20 AS first, 25 AS last FROM orders), a AS (SELECT l_orderkey AS path, l_linenumber * 9 AS s, l_linenumber * 9 + 2 AS e FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey AS path, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
    m AS (SELECT path, count(*) FILTER (e >= 19 AND s <= 26) AS i, count(*) FILTER (NOT (e >= 19 AND s <= 26)) AS o FROM a GROUP BY 1)
    SELECT z.path, coalesce(i, 0) AS n_inside, coalesce(n, 0) AS n_before, coalesce(o, 0) AS n_outside, coalesce(i, 0) = 0 AND coalesce(o, 0) <= coalesce(n, 0) AS ok FROM z LEFT JOIN m ON m.path = z.path LEFT JOIN b ON b.path = z.path""")
def r27_syntax_verdict(spark, sf):
    li, at = rel(spark, sf, "lineitem"), F.col("l_linenumber") * 9
    ranges = [F.col("l_orderkey").alias("path"), at.alias("start"), (at + 2).alias("end")]
    zones = rel(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.lit(20).alias("first"), F.lit(25).alias("last"))
    return E.syntax_verdict(li.where("l_linestatus = 'F'").select(*ranges), li.where("l_returnflag = 'R'").select(*ranges), zones)
