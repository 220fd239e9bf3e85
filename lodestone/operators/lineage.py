"""What belongs to a symbol: digest, ancestors, references, test callers, unresolved groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_test_path
from ..loops import cut
from .graph import RANK, VERIFIED, confidence_breakdown, live

#: Names of a digest, levels of ancestors, rows of a reference impact (fixed values).
VERIFIED_NAMES, INFERRED_NAMES, LEVELS, REFERENCES = 8, 5, 12, 200


def digests(symbols: DataFrame, edges: DataFrame, on_cycle: DataFrame) -> DataFrame:
    """(qn, tags, verified, inferred, cyclic): the first names of a symbol's callees by class, sorted; tags are the first two words of its name.

    Names are distinct and ranked before they are gathered, so a symbol gathers no more than a digest holds.
    """
    pairs = live(edges).where(F.col("confidence").isin(*VERIFIED, "inferred")).select("src", "dst", F.col("confidence").isin(*VERIFIED).alias("sure"))
    pairs = pairs.groupBy("src", "dst").agg(F.max("sure").alias("sure"))
    place = F.row_number().over(Window.partitionBy("src", "sure").orderBy("dst"))
    few = pairs.withColumn("k", place).where(F.col("k") <= F.when(F.col("sure"), VERIFIED_NAMES).otherwise(INFERRED_NAMES))
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("dst")))), ",")
    by = few.groupBy(F.col("src").alias("qn")).agg(names(F.col("sure")).alias("verified"), names(~F.col("sure")).alias("inferred"))
    # shuffled: digests and cycles have no size bound, whatever Spark's estimate of them
    cyclic = on_cycle.select(F.col("node").alias("qn"), F.lit(True).alias("c"))
    out = symbols.select("qn", "name").join(by.hint("merge"), "qn", "left").join(cyclic.hint("merge"), "qn", "left")
    return out.select("qn", F.substring_index("name", "_", 2).alias("tags"), F.coalesce("verified", F.lit("")).alias("verified"), F.coalesce("inferred", F.lit("")).alias("inferred"), F.coalesce("c", F.lit(False)).alias("cyclic"))


def ancestors(parents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(cls, ancestor, level): the least level of each ancestor, up to ``levels``; cycles end by themselves. ``parents``: cls, parent."""
    step = cut(parents.where("cls != parent").select("cls", "parent").distinct())
    seen = frontier = step.select("cls", F.col("parent").alias("ancestor"), F.lit(1).alias("level"))
    for level in range(2, levels + 1):
        up = step.select(F.col("cls").alias("ancestor"), F.col("parent").alias("next"))
        found = frontier.join(up, "ancestor").where("next != cls").select("cls", F.col("next").alias("ancestor")).distinct().join(seen, ["cls", "ancestor"], "left_anti")
        frontier = cut(found.withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def inherited(calls: DataFrame, methods: DataFrame, closure: DataFrame) -> DataFrame:
    """(cls, method, owner): the one ancestor of the nearest level that has the method; null if that level has several, or none has it."""
    met = calls.join(closure, "cls").join(methods.select(F.col("cls").alias("ancestor"), "method").distinct(), ["ancestor", "method"])
    by = met.groupBy("cls", "method", "level").agg(F.count("*").alias("n"), F.min("ancestor").alias("owner"))
    first = by.groupBy("cls", "method").agg(F.min(F.struct("level", "n", "owner")).alias("f"))
    return calls.join(first, ["cls", "method"], "left").select("cls", "method", F.when(F.col("f.n") == 1, F.col("f.owner")).alias("owner"))


def reference_impact(calls: DataFrame, imports: DataFrame, mentions: DataFrame, cap: int = REFERENCES) -> DataFrame:
    """(path, line, source, verdict) of a symbol's references: call sites first, then imports, then mentions; each line once, the first ``cap`` by place.

    ``calls`` has path, line, confidence; a call is one that must, is likely to, or should be reviewed to change.
    """
    verdict = F.when(F.col("confidence").isin(*VERIFIED), "must").when(F.col("confidence").isin("inferred", "textual"), "likely").otherwise("review")
    rows = calls.select("path", "line", F.lit(0).alias("p"), F.lit("call").alias("source"), verdict.alias("verdict"))
    rows = rows.unionByName(imports.select("path", "line", F.lit(1).alias("p"), F.lit("import").alias("source"), F.lit("likely").alias("verdict")))
    rows = rows.unionByName(mentions.select("path", "line", F.lit(2).alias("p"), F.lit("text").alias("source"), F.lit("review").alias("verdict")))
    first = rows.groupBy("path", "line").agg(F.min(F.struct("p", "source", "verdict")).alias("f"))
    return first.select("path", "line", "f.source", "f.verdict").orderBy("path", "line").limit(cap)


def health(edges: DataFrame) -> DataFrame:
    """Edges of each confidence by symbol, and how many distinct test files call it."""
    files = live(edges).where(is_test_path(F.col("src_path"))).groupBy("dst").agg(F.count_distinct("src_path").alias("n_test_files"))
    return confidence_breakdown(edges).join(files, "dst", "left").select("dst", *RANK, F.coalesce("n_test_files", F.lit(0).cast("long")).alias("n_test_files"))


def unresolved_groups(candidates: DataFrame) -> DataFrame:
    """(qn, n_groups, most_candidates) over ambiguity groups (group_id, qn)."""
    c = candidates.select("group_id", "qn").distinct()
    return c.join(c.groupBy("group_id").agg(F.count("*").alias("n")), "group_id").groupBy("qn").agg(F.count("*").alias("n_groups"), F.max("n").alias("most_candidates"))


def package_dependencies(imports: DataFrame) -> DataFrame:
    """(package, depends_on, n_imports) from imports (path, module): a file's folder, and a module without its last part. The whole table is made anew."""
    package = F.regexp_replace("path", "/[^/]*$", "")
    other = F.regexp_replace("module", r"(?:\.|::|/)[^./:]+$", "")
    return imports.select(package.alias("package"), other.alias("depends_on")).where("package != depends_on").groupBy("package", "depends_on").agg(F.count("*").alias("n_imports"))
