"""Metrics, hotspots, ownership, coverage, fitness and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the hotspot levels, of the absolute risk, and the default fitness limits (fixed values).
LEVELS = ((0.75, "critical"), (0.5, "high"), (0.25, "medium"))
CHURN_CAP, COMPLEXITY_CAP = 50, 150
LIMITS = {"hub_count": 1000, "hub_pct": 20.0, "avg_coreness": 15.0, "dead_code_pct": 10.0, "hotspot_risk": 0.75, "edge_coverage_pct": 60.0, "high_complexity_pct": 15.0, "avg_distance": 1.0}


def complexity_per_file(symbols: DataFrame) -> DataFrame:
    """Of each file's symbols that aren't tests: their number, hubs, connected ones, and mean callers."""
    return symbols.where("not is_test").groupBy("path").agg(
        F.count("*").alias("symbols"), F.count_if(F.col("hub_kind").isNotNull()).alias("hubs"), F.count_if(F.col("coreness") > 0).alias("connected"), F.round(F.avg("caller_count"), 6).alias("avg_callers"), F.max("language").alias("language")
    )


def complexity_score() -> Column:
    """D02."""
    return 0.3 * F.col("symbols") + 3.0 * F.col("hubs") + 1.5 * F.col("connected") + 0.5 * F.col("avg_callers")


def file_signals(commits: DataFrame) -> DataFrame:
    """Commits of each file, distinct authors, commits by bots, and the last day."""
    c = commits.select("path", "commit_id", "author", "day").distinct()
    return c.groupBy("path").agg(F.count("*").alias("commits"), F.count_distinct("author").alias("authors"), F.count_if(F.contains("author", F.lit("[bot]"))).alias("bot_commits"), F.max("day").alias("last_changed"))


def hotspots(complexity: DataFrame, churn: DataFrame | None, min_churn: int = 1, top: int | None = None) -> DataFrame:
    """Files by normalised churn times normalised complexity; by complexity alone without churn or with min_churn 0.

    Maxima are at least 1; scores have 4 decimals; ties go by path.
    """
    gated = churn is not None and min_churn > 0
    rows = complexity.withColumn("complexity", complexity_score())
    if gated:
        rows = rows.join(churn.where(F.col("commits") >= min_churn).select("path", "commits"), "path")
    else:
        rows = rows.withColumn("commits", F.lit(0).cast("long"))
    top_of = rows.agg(F.greatest(F.max("commits"), F.lit(1)).alias("mc"), F.greatest(F.max("complexity"), F.lit(1.0)).alias("mx"))
    score = F.col("complexity") / F.col("mx")
    if gated:
        score = score * F.col("commits") / F.col("mc")
    level = F.lit("low")
    for bound, name in reversed(LEVELS):
        level = F.when(F.col("score") >= bound, name).otherwise(level)
    out = rows.crossJoin(F.broadcast(top_of)).withColumn("score", F.round(score, 4)).withColumn("level", level)
    out = out.select("path", "commits", F.round("complexity", 4).alias("complexity"), "score", "level")
    return out.orderBy(F.desc("score"), "path").limit(top) if top else out


def top_symbols(symbols: DataFrame, top: int = 5) -> DataFrame:
    """Each file's symbols with the most callers, then the largest coreness, then by name."""
    w = Window.partitionBy("path").orderBy(F.desc("caller_count"), F.desc("coreness"), "qn")
    return symbols.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("path", "place", "qn", "caller_count", "coreness")


def absolute_hotspot_risk(complexity: DataFrame, churn: DataFrame) -> DataFrame:
    """The largest product of capped churn and capped complexity."""
    rows = complexity.withColumn("complexity", complexity_score()).join(churn, "path")
    part = F.least(F.col("commits") / CHURN_CAP, F.lit(1.0)) * F.least(F.col("complexity") / COMPLEXITY_CAP, F.lit(1.0))
    return rows.agg(F.round(F.max(part), 6).alias("risk"))


def coupling(imports: DataFrame, types: DataFrame) -> DataFrame:
    """Afferent and efferent coupling, instability, abstractness and distance of each module. Null where undefined, never zero.

    ``types``: path, types, abstract_types.
    """
    known = imports.where("to_path is not null").distinct()
    ce = known.groupBy(F.col("from_path").alias("path")).agg(F.count_distinct("to_path").alias("ce"))
    ca = known.groupBy(F.col("to_path").alias("path")).agg(F.count_distinct("from_path").alias("ca"))
    zero = F.lit(0).cast("long")
    both = ca.join(ce, "path", "full").select("path", F.coalesce("ca", zero).alias("ca"), F.coalesce("ce", zero).alias("ce"))
    instability = F.col("ce") / (F.col("ca") + F.col("ce"))
    abstractness = F.try_divide(F.col("abstract_types"), F.col("types"))
    out = both.join(types, "path", "left").withColumn("instability", F.round(instability, 6)).withColumn("abstractness", F.round(abstractness, 6))
    return out.select("path", "ca", "ce", "instability", "abstractness", F.round(F.abs(abstractness + instability - 1), 6).alias("distance"))


def boundary_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Each distinct edge with each rule (from_prefix, to_prefix) it breaks. The rules are few: their number is a parameter."""
    e = edges.select("from_path", "to_path").where("to_path is not null").distinct()
    return e.join(F.broadcast(rules), F.col("from_path").startswith(F.col("from_prefix")) & F.col("to_path").startswith(F.col("to_prefix"))).select("from_path", "to_path", "from_prefix", "to_prefix")


def is_private(language: str = "language", name: str = "name", signature: str = "signature") -> Column:
    """D11."""
    n, s = F.col(name), F.col(signature)
    return (
        F.when(F.col(language) == "python", n.startswith("_"))
        .when(F.col(language) == "rust", ~s.contains("pub "))
        .when(F.col(language) == "go", n.rlike(r"^\p{Ll}"))
        .when(F.col(language) == "java", s.contains("private "))
        .when(F.col(language).isin("javascript", "typescript"), ~s.contains("export"))
        .otherwise(False)
    )


def dead_code(symbols: DataFrame) -> DataFrame:
    """(qn, dead_code): none, low, medium or high. ``symbols`` has covered and scope_clear beside the usual columns."""
    alive = ~F.col("kind").isin("function", "method") | F.col("is_entry") | F.col("is_test") | (F.col("caller_count") > 0)
    level = F.when(alive, "none").when(F.col("covered"), "low").when(is_private(), "high").when(F.col("scope_clear"), "medium").otherwise("low")
    return symbols.select("qn", level.alias("dead_code"))


def covered(symbols: DataFrame, lines: DataFrame, bucket: int = 32) -> DataFrame:
    """The symbols any of whose lines is covered. An equi-join on line buckets, then the exact range."""
    s = symbols.select("qn", "path", "line_start", "line_end").withColumn("b", F.explode(F.expr(f"sequence(line_start div {bucket}, line_end div {bucket})")))
    c = lines.select("path", "line").distinct().withColumn("b", F.expr(f"line div {bucket}"))
    return s.join(c, ["path", "b"]).where("line between line_start and line_end").select("qn").distinct()


def ownership_entropy(commits: DataFrame, least: int = 2) -> DataFrame:
    """(path, entropy): of the authors' shares, over its maximum; null with fewer than ``least`` commits, 0 for one author."""
    c = commits.select("path", "commit_id", "author").distinct().groupBy("path", "author").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("path"))
    by = c.withColumn("p", F.col("n") / total).groupBy("path").agg(F.sum("n").alias("commits"), F.count("*").alias("authors"), F.sum(-F.col("p") * F.log2("p")).alias("h"))
    entropy = F.when(F.col("commits") < least, None).when(F.col("authors") <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("h") / F.log2("authors"))))
    return by.select("path", "commits", F.round(entropy, 6).alias("entropy"))


def owners_of(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each path's owners by the last pattern (line_no, regex, owners) that matches."""
    met = paths.join(F.broadcast(patterns), F.expr("path rlike regex"), "left")
    return met.groupBy("path").agg(F.max_by("owners", "line_no").alias("owners"))


def owner_pattern(pattern: str) -> str:
    """The regular expression of an ownership pattern: a directory, a name without slash, or a path; ``*`` and ``?`` stay within a segment."""
    body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".+()[]{}^$|\\" else c for c in pattern.strip("/"))
    if pattern.endswith("/"):
        return f"^(?:.*/)?{body}/" if "/" not in pattern.strip("/") and not pattern.startswith("/") else f"^{body}/"
    return f"^(?:.*/)?{body}$" if "/" not in pattern else f"^{body}$"


def fitness(metrics: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """(metric, value, threshold, passed) of a one-row table of metrics; null metrics are left out."""
    names = [m for m in limits if m in metrics.columns]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(limits[m])).alias("threshold")) for m in names]))
    out = metrics.select(rows.alias("r")).select("r.*").where("value is not null")
    passed = F.when(F.col("metric") == "edge_coverage_pct", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return out.withColumn("passed", passed)


def fitness_metrics(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: hubs, mean coreness, share of uncalled callables, and share of callables with an outgoing edge. Empty denominators give 0, or 100 for coverage."""
    called = F.col("kind").isin("function", "method")
    s = symbols.agg(
        F.count_if(F.col("hub_kind").isNotNull()).alias("hub_count"), F.count_if(called).alias("callables"), F.avg(F.when(F.col("coreness") > 0, F.col("coreness"))).alias("core"), F.count_if(called & (F.col("caller_count") == 0) & ~F.col("is_test") & ~F.col("is_entry")).alias("dead")
    )
    e = edges.agg(F.count_distinct("dst").alias("with_edges"))
    share = lambda n, empty: F.coalesce(F.try_divide(100.0 * F.col(n), F.col("callables")), F.lit(empty))
    return s.join(F.broadcast(e)).select(F.col("hub_count"), F.round(share("hub_count", 0.0), 4).alias("hub_pct"), F.round(F.coalesce("core", F.lit(0.0)), 4).alias("avg_coreness"), F.round(share("dead", 0.0), 4).alias("dead_code_pct"), F.round(share("with_edges", 100.0), 4).alias("edge_coverage_pct"))


def trend(now: DataFrame, history: DataFrame, lookback: int = 7) -> DataFrame:
    """For each (symbol, today) the latest snapshot at least ``lookback`` days before, with deltas; null without one."""
    met = now.join(history.select(F.col("symbol").alias("s"), F.col("snapshot_at").alias("at"), F.col("callers").alias("c"), F.col("hub").alias("h")), (F.col("symbol") == F.col("s")) & (F.col("at") <= F.date_sub("today", lookback)), "left")
    out = met.groupBy("symbol", "today", "callers", "hub").agg(F.max_by(F.struct("at", "c", "h"), "at").alias("b"))
    return out.select("symbol", "today", F.col("b.at").alias("baseline"), F.round(F.col("callers") - F.col("b.c"), 4).alias("delta"), (F.col("hub") != F.col("b.h")).alias("hub_changed"))


def retained(history: DataFrame, today: Column, days: int = 180) -> DataFrame:
    """Snapshots not older than ``days``."""
    return history.where(F.col("snapshot_at") >= F.date_sub(today, days))


def new_snapshots(current: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of ``current`` whose (symbol, snapshot_at) the history doesn't have yet."""
    return current.join(history, ["symbol", "snapshot_at"], "left_anti")


def test_gaps(symbols: DataFrame, tested: DataFrame, pool: int = 300, top: int = 20) -> DataFrame:
    """Of the ``pool`` most central callables that aren't tests, the first ``top`` that look dead or have no test among their callers."""
    order = [F.desc("coreness"), F.desc("caller_count"), "qn"]
    first = symbols.where("not is_test and kind in ('function', 'method') and coreness > 0").orderBy(*order).limit(pool)
    met = first.join(tested.select("qn").distinct().withColumn("t", F.lit(True)), "qn", "left")
    return met.where(F.col("dead_code").isin("medium", "high") | F.col("t").isNull()).orderBy(*order).limit(top).select("qn", "coreness", "caller_count")


def log_report(lines: DataFrame, target: str) -> DataFrame:
    """A JSON-lines log: unreadable lines, and lines of ``target`` by kind."""
    j = lines.withColumn("j", F.expr("try_parse_json(line)"))
    kind, n = F.expr("try_variant_get(j, '$.kind', 'string')"), F.expr("try_variant_get(j, '$.k', 'long')")
    return j.select(F.when(F.col("j").isNull(), "unreadable").when(kind == target, "target").otherwise("other").alias("bucket"), n.alias("k")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def freshness(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """One row: ready, stale or needs_baseline, from the indexed (path, hash) and what is found now."""
    diff = change_set(indexed, found).agg(F.count_if(F.col("change") == "unchanged").alias("same"), F.count_if(F.col("change") != "unchanged").alias("drift"))
    n = indexed.agg(F.count("*").alias("indexed"))
    status = F.when(F.col("indexed") == 0, "needs_baseline").when(F.col("drift") > 0, "stale").otherwise("ready")
    return diff.join(F.broadcast(n)).select(status.alias("status"), "indexed", "same", "drift")


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, changed, deleted or unchanged, from (path, hash) before and after."""
    o, n = old.select("path", F.col("hash").alias("o")), new.select("path", F.col("hash").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "changed").otherwise("unchanged")
    return o.join(n, "path", "full").select("path", change.alias("change"))


def recent_authors(commits: DataFrame, window: int = 10, top: int = 3) -> DataFrame:
    """Of each file's last ``window`` commits, the distinct authors, most recent first."""
    c = commits.groupBy("path", "commit_id", "author").agg(F.max("event_id").alias("at"))
    last = c.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at"), "commit_id"))).where(F.col("place") <= window)
    by = last.groupBy("path", "author").agg(F.min("place").alias("place"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("place"))).where(F.col("rank") <= top).select("path", "rank", "author")


def returns_option_or_result(signature: str = "signature") -> Column:
    """Does the type after the last arrow, without path and parameters, read Option or Result?"""
    after = F.when(F.instr(signature, "->") > 0, F.element_at(F.split(signature, "->"), -1)).otherwise(F.lit(""))
    base = F.element_at(F.split(F.regexp_extract(F.ltrim(after), r"^([^<\s(]*)", 1), "::"), -1)
    return base.isin("Option", "Result")
