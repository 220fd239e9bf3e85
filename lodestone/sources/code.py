"""What source texts hold, line by line: symbols, calls, imports, relations, effects; by regular expressions for each language.

``files`` has path, language, text. A line belongs to the last symbol that begins at or before it, so symbols end where
the next one begins. Languages without a pattern give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_test_path
from ..loops import dealt

NAME = "([A-Za-z_][A-Za-z0-9_]*)"
#: Patterns of a line that begins a symbol: the first that matches tells kind and name.
SYMBOLS = {
    "python": {"class": rf"^\s*class\s+{NAME}", "function": rf"^\s*(?:async\s+)?def\s+{NAME}"},
    "rust": {"function": rf"^\s*(?:pub\s+)?(?:async\s+)?fn\s+{NAME}", "class": rf"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+{NAME}"},
    "go": {"function": rf"^func\s+(?:\([^)]*\)\s*)?{NAME}", "class": rf"^type\s+{NAME}"},
    "java": {"class": rf"^\s*(?:public\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+{NAME}", "function": rf"^\s*(?:public|private|protected)\s+(?:static\s+)?[A-Za-z<>\[\]]+\s+{NAME}\s*\("},
    "typescript": {"class": rf"^\s*(?:export\s+)?(?:class|interface)\s+{NAME}", "function": rf"^\s*(?:export\s+)?(?:async\s+)?function\s+{NAME}"},
    "sql": {"table": rf"(?i)^\s*CREATE\s+TABLE\s+{NAME}", "view": rf"(?i)^\s*CREATE\s+VIEW\s+{NAME}", "procedure": rf"(?i)^\s*CREATE\s+PROCEDURE\s+{NAME}"},
}
IMPORTS = {
    "python": r"^\s*(?:from|import)\s+([A-Za-z0-9_.]+)", "rust": r"^\s*(?:pub\s+)?use\s+([A-Za-z0-9_:]+)", "go": r"^\s*import\s+\"([^\"]+)\"",
    "java": r"^\s*import\s+(?:static\s+)?([A-Za-z0-9_.]+)", "typescript": r"from\s+[\"']([^\"']+)[\"']",
}
CALL = rf"{NAME}\s*\("
#: Words before a bracket that are no calls, and words and marks that branch.
NO_CALLS = "if for while switch catch return fn def func function match class elif except and or not in".split()
BRANCH = r"\b(?:if|elif|for|while|case|catch|except|match)\b|&&|\|\||\band\b|\bor\b"
EXTENDS = {"python": r"^\s*class\s+[A-Za-z0-9_]+\(([^)]*)\)", "java": r"\bextends\s+([A-Za-z0-9_]+)", "typescript": r"\bextends\s+([A-Za-z0-9_]+)"}
IMPLEMENTS = {"java": r"\bimplements\s+([A-Za-z0-9_, ]+)", "typescript": r"\bimplements\s+([A-Za-z0-9_, ]+)", "rust": rf"^\s*impl\s+{NAME}\s+for\b"}
THROWS = {"python": rf"\braise\s+{NAME}", "java": rf"\bthrow\s+new\s+{NAME}", "typescript": rf"\bthrow\s+new\s+{NAME}"}
WRITES = {"python": rf"\bself\.{NAME}\s*=[^=]", "java": rf"\bthis\.{NAME}\s*=[^=]", "typescript": rf"\bthis\.{NAME}\s*=[^=]"}
SQL_USES = {"reference": rf"(?i)\b(?:FROM|JOIN)\s+{NAME}", "call": rf"(?i)\b(?:CALL|EXEC)\s+{NAME}"}


def by_language(patterns: dict[str, str], line: str = "line") -> Column:
    """The first group of the language's pattern; empty without a match or pattern."""
    out = F.lit("")
    for language, pattern in patterns.items():
        out = F.when(F.col("language") == language, F.regexp_extract(line, pattern, 1)).otherwise(out)
    return out


def lines(files: DataFrame) -> DataFrame:
    """(path, language, line_no, line), from 1. A null text has no lines."""
    return files.select("path", "language", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("path", "language", (F.col("i") + 1).alias("line_no"), "line")


def owned_lines(files: DataFrame) -> DataFrame:
    """Lines with kind and name where a symbol begins, and with owner and owner_line: the last symbol that began."""
    kind = name = F.lit("")
    for language, patterns in SYMBOLS.items():
        for k, pattern in reversed(patterns.items()):
            met = (F.col("language") == language) & F.col("line").rlike(pattern)
            kind, name = F.when(met, k).otherwise(kind), F.when(met, F.regexp_extract("line", pattern, 1)).otherwise(name)
    rows = lines(files).withColumns({"kind": F.nullif(kind, F.lit("")), "name": F.nullif(name, F.lit(""))})
    w = Window.partitionBy("path").orderBy("line_no")
    begun = F.col("name").isNotNull()
    return rows.withColumns({"owner": F.last("name", True).over(w), "owner_line": F.last(F.when(begun, F.col("line_no")), True).over(w)})


def symbols(files: DataFrame) -> DataFrame:
    """(path, language, kind, name, line_start, line_end, complexity): one more than the branches of the symbol's lines."""
    own = owned_lines(files).where("owner is not null")
    # all of a symbol's own facts are on its first line, so one aggregate by owner gives them
    return own.groupBy("path", "language", F.col("owner").alias("name"), F.col("owner_line").alias("line_start")).agg(
        F.max("kind").alias("first_kind"), F.max("line_no").alias("line_end"), (1 + F.sum(F.regexp_count("line", F.lit(BRANCH)))).alias("complexity"),
    ).select("path", "language", F.col("first_kind").alias("kind"), "name", "line_start", "line_end", "complexity")


def calls(files: DataFrame) -> DataFrame:
    """(path, caller, callee, line): names before an opening bracket, but for words of the language and the symbol that begins there."""
    found = owned_lines(files).where("language != 'sql'").select("path", F.col("owner").alias("caller"), F.col("line_no").alias("line"), "name", F.explode(F.regexp_extract_all("line", F.lit(CALL), 1)).alias("callee"))
    return found.where(~F.col("callee").isin(NO_CALLS) & ~F.col("callee").eqNullSafe(F.col("name"))).drop("name")


def imports(files: DataFrame) -> DataFrame:
    """(path, language, line, module)."""
    return lines(files).select("path", "language", F.col("line_no").alias("line"), by_language(IMPORTS).alias("module")).where("module != ''")


def module_targets(found: DataFrame, known: DataFrame) -> DataFrame:
    """Imports with target: the first of the module's candidate paths that is known (path), else null."""
    plain = F.regexp_replace(F.regexp_replace("module", r"^\./", ""), r"\.|::", "/")
    above = F.regexp_replace(plain, "/[^/]+$", "")
    suffix = {"python": [".py", "/__init__.py"], "rust": [".rs", "/mod.rs"], "go": [".go"], "java": [".java"], "typescript": [".ts", "/index.ts"]}
    options = F.array().cast("array<string>")
    for language, ends in suffix.items():
        options = F.when(F.col("language") == language, F.array(*[F.concat(F.lit("src/"), base, F.lit(e)) for base in (plain, above) for e in ends])).otherwise(options)
    # each different module is looked up once; imports meet its answer unsorted, and a row that stands twice is told by its path last
    each = found.select("language", "module").distinct().select("language", "module", F.posexplode(options).alias("priority", "option"))
    met = each.join(dealt(known.select(F.col("path").alias("option")), "option").hint("merge"), "option", "left_semi")
    first = met.groupBy("language", "module").agg(F.min("priority").alias("priority"))
    out = dealt(found.join(first.hint("shuffle_hash"), ["language", "module"], "left"), "path").groupBy(*found.columns).agg(F.min("priority").alias("priority"))
    return out.select(*found.columns, F.get(options, F.col("priority")).alias("target"))


def is_test(language: Column, name: Column, path: Column) -> Column:
    """By path, or by the language's way to name tests."""
    named = F.when(language == "go", name.rlike("^(Test|Benchmark)[A-Z0-9]")).when(language == "java", name.endswith("Test")).otherwise(name.startswith("test_"))
    return is_test_path(path) | named


def is_entry(language: Column, name: Column, line: Column) -> Column:
    """Where a program or a framework enters."""
    return (
        F.when(language == "python", name.rlike("^__.+__$"))
        .when(language == "go", name.isin("main", "init"))
        .when(language == "rust", name == "main")
        .when(language == "java", F.contains(line, F.lit("public static void main")))
        .when(language == "typescript", (name == "main") | F.ltrim(line).startswith("export default"))
        .otherwise(False)
    )


def marked_symbols(files: DataFrame) -> DataFrame:
    """(path, name, line, is_test, is_entry)."""
    begun = owned_lines(files).where("name is not null and language != 'sql'")
    return begun.select("path", "name", F.col("line_no").alias("line"), is_test(F.col("language"), F.col("name"), F.col("path")).alias("is_test"), is_entry(F.col("language"), F.col("name"), F.col("line")).alias("is_entry"))


def type_relations(files: DataFrame) -> DataFrame:
    """(path, line, relation, target): extends and implements."""
    rows = lines(files).select("path", F.col("line_no").alias("line"), F.explode(F.array(*[F.struct(F.lit(k).alias("relation"), by_language(p).alias("names")) for k, p in (("extends", EXTENDS), ("implements", IMPLEMENTS))])).alias("r"))
    each = rows.where("r.names != ''").select("path", "line", "r.relation", F.explode(F.split("r.names", ",")).alias("t"))
    return each.select("path", "line", "relation", F.trim("t").alias("target")).where("target != ''")


def effects(files: DataFrame) -> DataFrame:
    """(path, line, owner, effect, target): explicit throws, and fields written."""
    rows = owned_lines(files)
    pairs = F.array(*[F.struct(F.lit(k).alias("effect"), by_language(p).alias("target")) for k, p in (("explicit_throw", THROWS), ("write_field", WRITES))])
    return rows.select("path", F.col("line_no").alias("line"), "owner", F.explode(pairs).alias("e")).where("e.target != ''").select("path", "line", "owner", "e.effect", "e.target")


def sql_uses(files: DataFrame) -> DataFrame:
    """(path, line, use, target, confidence): tables that statements read and procedures they call; resolved if the file itself creates the target."""
    rows = lines(files.where("language = 'sql'"))

    def named(use: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(SQL_USES[use]), 1), lambda t: F.struct(F.lit(use).alias("use"), t.alias("target")))

    uses = F.flatten(F.array(*map(named, SQL_USES)))
    found = rows.select("path", F.col("line_no").alias("line"), F.explode(uses).alias("u")).select("path", "line", "u.use", "u.target")
    made = symbols(files.where("language = 'sql'")).select("path", F.col("name").alias("target"), F.lit("resolved").alias("made")).distinct()
    return found.join(made, ["path", "target"], "left").select("path", "line", "use", "target", F.coalesce("made", F.lit("textual")).alias("confidence"))


def extracted(files: DataFrame) -> DataFrame:
    """(path, qn, kind, line_start, n_calls): symbols under unique names, repeated ones numbered in order of their lines, with the calls they make."""
    s = symbols(files)
    w = Window.partitionBy("path", "name").orderBy("line_start")
    named = s.withColumn("k", F.row_number().over(w))
    qn = F.concat_ws("::", "path", F.concat("name", F.when(F.col("k") > 1, F.concat(F.lit("#"), "k")).otherwise("")))
    made = owned_lines(files).where("owner is not null and language != 'sql'").select("path", F.col("owner_line").alias("line_start"), F.col("name"), F.explode(F.regexp_extract_all("line", F.lit(CALL), 1)).alias("callee"))
    made = made.where(~F.col("callee").isin(NO_CALLS) & ~F.col("callee").eqNullSafe(F.col("name"))).groupBy("path", "line_start").agg(F.count("*").alias("n"))
    out = named.join(made, ["path", "line_start"], "left")
    return out.select("path", qn.alias("qn"), "kind", "line_start", F.coalesce("n", F.lit(0).cast("long")).alias("n_calls"))


def enclosing(sites: DataFrame, found: DataFrame, bucket: int = 64) -> DataFrame:
    """Sites (path, line) with the symbol (qn) of the fewest lines that holds the line, ties by name; null without one. An equi-join on line buckets."""
    dealt = found.withColumn("b", F.explode(F.expr(f"sequence(line_start div {bucket}, line_end div {bucket})"))).select("path", "b", "qn", "line_start", "line_end")
    asked = sites.select("path", "line").distinct()
    met = asked.withColumn("b", F.expr(f"line div {bucket}")).join(dealt, ["path", "b"]).where("line between line_start and line_end")
    best = met.groupBy("path", "line").agg(F.min(F.struct(F.col("line_end") - F.col("line_start"), "qn")).alias("m"))
    return asked.join(best, ["path", "line"], "left").select("path", "line", F.col("m.qn").alias("qn"))
