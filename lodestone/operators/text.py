"""Operators on lines and chunks of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line_no, line), numbered from 1; a null text has no lines."""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def chunks(files: DataFrame, key: str = "path", size: int = 30, stride: int = 20) -> DataFrame:
    """Windows of ``size`` lines every ``stride`` lines; the last one ends with the file. One window if there are no more lines; blank windows are dropped."""
    ls = F.split("text", "\n")
    n = F.size("ls")
    starts = F.when(n <= size, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.greatest(F.ceil((n - size) / stride).cast("int"), F.lit(0)) * stride + 1, F.lit(stride)))
    rows = files.select(key, ls.alias("ls")).where(F.col("ls").isNotNull()).withColumn("line_start", F.explode(starts))
    rows = rows.withColumn("line_end", F.least(F.col("line_start") + size - 1, n))
    rows = rows.withColumn("chunk", F.array_join(F.slice("ls", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n"))
    return rows.where(F.trim(F.regexp_replace("chunk", r"\s", "")) != "").select(key, "line_start", "line_end", "chunk")


def grep(files: DataFrame, pattern: str, key: str = "path", context: int = 1) -> DataFrame:
    """Each line that matches, with the lines around it; the matching line has ``>`` in front, numbers are five wide."""
    def places(ls: Column) -> Column:
        return F.struct(ls.alias("ls"), F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: F.rlike(F.element_at(ls, i), F.lit(pattern))).alias("at"))

    # the lines are bound as a lambda's variable, so that they are split once for each file
    bound = files.where(F.col("text").isNotNull()).select(key, F.transform(F.array(F.split("text", "\n")), places)[0].alias("b"))
    found = bound.select(key, F.col("b.ls").alias("ls"), F.explode("b.at").alias("i"))
    lo, hi = F.greatest(F.col("i") - context, F.lit(1)), F.least(F.col("i") + context, F.size("ls"))
    mark = F.transform(F.sequence(lo, hi), lambda k: F.concat(F.when(k == F.col("i"), "> ").otherwise("  "), F.lpad(k.cast("string"), 5, " "), F.lit(" "), F.element_at("ls", k)))
    return found.select(key, F.col("i").alias("line_no"), F.array_join(mark, "\n").alias("snippet"))


def headings(files: DataFrame, key: str = "path") -> DataFrame:
    """Headings of one to six signs outside fenced code: (key, line_no, level, title)."""
    ls = lines(files, key)
    fence = F.ltrim("line").startswith("```")
    w = Window.partitionBy(key).orderBy("line_no")
    ls = ls.withColumn("inside", F.sum(fence.cast("int")).over(w) % 2 == 1)
    h = ls.where(~F.col("inside") & F.col("line").rlike(r"^#{1,6}\s+\S"))
    return h.select(key, "line_no", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", r"^#+\s+", "")).alias("title"))


def file_search(files: DataFrame, query: str, key: str = "path") -> DataFrame:
    """Paths that a glob (if the query has ``*``, ``?`` or ``[``) or else a LIKE pattern finds, ASCII case folded for the latter."""
    from ..functions.text import glob_pattern, lower_ascii

    hit = F.col(key).rlike(glob_pattern(query)) if any(c in query for c in "*?[") else lower_ascii(F.col(key)).like(f"%{query.lower()}%")
    return files.where(hit).select(key).distinct()


def git_log(lines_: DataFrame) -> DataFrame:
    """Commits from log lines (line_no, line): a header ``|||author|||date``, then one path a line. Groups come from a running count of headers within each log (log_id)."""
    w = Window.partitionBy("log_id").orderBy("line_no")
    header = F.col("line").startswith("|||")
    rows = lines_.withColumn("n", F.sum(header.cast("long")).over(w)).where("n > 0")
    rows = rows.withColumn("head", F.last(F.when(header, F.col("line")), True).over(w))
    parts = F.split("head", r"\|\|\|")
    return rows.where(~header & (F.trim("line") != "")).select("log_id", F.col("n").alias("commit_no"), parts[1].alias("author"), parts[2].alias("day"), F.trim("line").alias("path"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """The lines of unified diffs (change_id, text): path, hunk, kind (added, removed, context) and, but for removed ones, the new line number."""

    def hunks(ls: Column, at: Column, names: Column) -> Column:
        def hunk(start: Column, j: Column) -> Column:
            end = F.coalesce(F.get(at, j + 1), F.size(ls) + 1)
            return F.struct(
                (j + 1).alias("hunk_no"), F.slice(ls, start, end - start).alias("ls"), F.regexp_extract(F.get(ls, start - 1), r"\+([0-9]+)", 1).try_cast("int").alias("new_start"),
                F.element_at(ls, F.array_max(F.filter(names, lambda p: p < start))).alias("name"), F.transform(F.filter(names, lambda p: (p > start) & (p < end)), lambda p: p - start + 1).alias("names"),
            )

        return F.transform(at, hunk)

    def places(ls: Column, mark: str) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: F.startswith(F.get(ls, i - 1), F.lit(mark)))

    # what is used more than once is bound as a lambda's variable; nothing is sorted or moved by line
    marked = F.transform(F.array(F.split("text", "\n")), lambda ls: F.struct(ls.alias("ls"), places(ls, "@@ ").alias("at"), places(ls, "+++ ").alias("names")))
    each = diffs.where(F.col("text").isNotNull()).select("change_id", F.explode(F.transform(marked, lambda m: hunks(m["ls"], m["at"], m["names"]))[0]).alias("h"))

    def numbered(h: Column) -> Column:
        ls = h["ls"]
        line = lambda i: F.get(ls, i - 1)
        path = lambda i: F.when(F.size(h["names"]) == 0, h["name"]).otherwise(F.coalesce(F.get(ls, F.array_max(F.filter(h["names"], lambda p: p <= i)) - 1), h["name"]))
        is_head = lambda x: F.rlike(x, F.lit(r"^(?:\+\+\+ |--- |diff |index |@@ )"))
        first = lambda x: F.substring(x, 1, 1)
        of = lambda marks: F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: first(line(i)).isin(*marks) & ~is_head(line(i)))
        row = lambda i, kind, no: F.struct(path(i).alias("name"), kind.alias("kind"), no.cast("long").alias("new_line"), F.substring(line(i), 2, 2147483647).alias("text"))
        # the new line's number is the line's place among the added and context lines of its hunk
        new = F.transform(of("+ "), lambda i, k: row(i, F.when(first(line(i)) == "+", F.lit("added")).otherwise(F.lit("context")), h["new_start"] + k))
        return F.concat(new, F.transform(of("-"), lambda i: row(i, F.lit("removed"), F.lit(None))))

    rows = each.select("change_id", F.col("h.hunk_no").cast("long").alias("hunk_no"), F.explode(F.transform(F.array("h"), numbered)[0]).alias("r"))
    path = F.regexp_replace("r.name", r'^\+\+\+ "?(?:b/)?([^"\t]*)"?.*$', "$1")
    return rows.select("change_id", path.alias("path"), "hunk_no", "r.kind", "r.new_line", "r.text")


def lcov(reports: DataFrame) -> DataFrame:
    """Covered lines of LCOV reports (report_id, text): SF opens a file, DA with hits covers a line, end_of_record closes."""
    # a piece for each file that is opened; what comes before the first, or after a record's end, isn't one. Nothing is sorted by line
    piece = reports.select("report_id", F.explode(F.split(F.concat(F.lit("\n"), "text"), r"\n(?=SF:)|\nend_of_record(?=\n|\z)")).alias("piece")).where(F.startswith("piece", F.lit("SF:")))
    path = F.expr("substring(substring_index(piece, '\n', 1), 4)")
    hit = F.regexp_extract_all("piece", F.lit(r"\nDA:([0-9]+),0*[1-9]"), 1)
    return piece.select("report_id", path.alias("path"), F.explode(hit).alias("line")).where("path != ''").select("report_id", "path", F.col("line").try_cast("int").alias("line")).distinct()


def go_cover(reports: DataFrame) -> DataFrame:
    """Covered lines of Go profiles: ``file:l0.c0,l1.c1 statements count``."""
    ls = lines(reports, "report_id").withColumn("m", F.regexp_extract("line", r"^(.*):[0-9]+\.[0-9]+,[0-9]+\.[0-9]+ [0-9]+ [1-9][0-9]*$", 1)).where("m != ''")
    first, last = F.regexp_extract("line", r":([0-9]+)\.[0-9]+,", 1).cast("int"), F.regexp_extract("line", r",([0-9]+)\.[0-9]+ ", 1).cast("int")
    return ls.select("report_id", F.col("m").alias("path"), F.explode(F.sequence(first, F.greatest(first, last))).alias("line")).distinct()


def cobertura(reports: DataFrame) -> DataFrame:
    """Covered lines of Cobertura XML, by a scan of its attributes: a line's file is the last filename before it."""

    def pieces(tags: Column) -> Column:
        names = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.size(tags)), lambda i: F.startswith(F.get(tags, i - 1), F.lit("filename"))))
        cut = lambda at: F.transform(at, lambda s, j: F.struct(F.when(s > 0, F.regexp_extract(F.get(tags, s - 1), '"([^"]*)"', 1)).alias("path"), F.slice(tags, s + 1, F.coalesce(F.get(at, j + 1), F.size(tags) + 1) - s - 1).alias("lines")))
        return F.transform(F.array(names), cut)[0]

    # a piece for each filename and the line tags up to the next one; nothing is sorted by tag
    tags = F.regexp_extract_all("text", F.lit(r'(filename="[^"]*"|<line [^>]*>)'), 1)
    bound = F.transform(F.filter(F.array(tags), lambda t: F.size(t) > 0), pieces)
    piece = reports.select("report_id", F.explode(F.flatten(bound)).alias("p")).select("report_id", "p.path", F.explode("p.lines").alias("tag"))
    hit = piece.where(F.regexp_extract("tag", r'hits="([0-9]+)"', 1).try_cast("long") > 0)
    return hit.select("report_id", "path", F.regexp_extract("tag", r'number="([0-9]+)"', 1).try_cast("int").alias("line")).distinct()


def manifests(files: DataFrame) -> DataFrame:
    """Dependencies (path, ecosystem, name, version) of package.json, requirements and go.mod texts."""
    js = files.where(F.col("path").endswith("package.json")).select("path", F.explode(F.from_json(F.get_json_object("text", "$.dependencies"), "map<string,string>")).alias("name", "version")).withColumn("ecosystem", F.lit("npm"))
    ls = lines(files.where(~F.col("path").endswith("package.json")))
    py = ls.where(F.col("path").endswith("requirements.txt") & F.col("line").rlike(r"^\s*[A-Za-z0-9]")).select("path", F.regexp_extract("line", r"^\s*([A-Za-z0-9._-]+)", 1).alias("name"), F.regexp_extract("line", r"[=<>~!]=?\s*([0-9][^\s;,#]*)", 1).alias("version")).withColumn("ecosystem", F.lit("pypi"))
    go = ls.where(F.col("path").endswith("go.mod") & F.col("line").rlike(r"^\s*(?:require\s+)?[^\s(]+\.[^\s]+\s+v[0-9]")).select("path", F.regexp_extract("line", r"^\s*(?:require\s+)?(\S+)\s+v", 1).alias("name"), F.regexp_extract("line", r"\s(v[0-9]\S*)", 1).alias("version")).withColumn("ecosystem", F.lit("go"))
    return js.unionByName(py).unionByName(go).select("path", "ecosystem", "name", "version")


def config_drift(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc, ref) of references that are no path and no path's end. Ends are compared by equality: each path gives all of its own."""
    parts = F.split("path", "/")
    ends = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("ref")).distinct()
    return refs.select("doc", "ref").distinct().join(ends, "ref", "left_anti").select("doc", "ref")
