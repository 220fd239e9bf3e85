"""Graph operators on edge tables: callers, reach, paths, cores, hubs, cycles, neighbours in files and imports.

Edges have src, dst, confidence, ruled_out. Loops run over DataFrames with a
checkpoint every few rounds; nothing but counts and flags comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..loops import cut
from . import small

#: Rank of each confidence; ambiguous and unresolved edges rank last.
RANK = {"formal": 4, "resolved": 3, "inferred": 2, "textual": 1, "ambiguous": 0, "unresolved": 0}
VERIFIED = ("formal", "resolved")


def rank_of(confidence: Column) -> Column:
    """The rank of a confidence; null if it isn't one."""
    return F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[confidence]


def live(edges: DataFrame) -> DataFrame:
    return edges.where(~F.coalesce("ruled_out", F.lit(False)))


def callers(edges: DataFrame, cap: int | None = None) -> DataFrame:
    """Each symbol's callers, ambiguous ones last; ``cap`` keeps the first of each symbol, with counts taken before.

    Counts are an aggregate of their own, so that the window needs no more than the first ``cap`` rows of a symbol from each task.
    """
    out = live(edges).select("dst", "src", "src_path", "line", "confidence")
    w = Window.partitionBy("dst").orderBy(F.col("confidence") == "ambiguous", "src_path", "line", "src", "confidence")
    first = out.withColumn("place", F.row_number().over(w))
    if cap:
        first = first.where(F.col("place") <= cap)
    return first.join(out.groupBy("dst").agg(F.count("*").alias("n_edges")), "dst")


def confidence_breakdown(edges: DataFrame, key: str = "dst") -> DataFrame:
    """How many edges of each confidence a symbol has."""
    return live(edges).groupBy(key).agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in RANK])


def caller_counts(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct callers of each symbol over edges that aren't ambiguous, and over verified ones; zero without any."""
    verified = F.when(F.col("confidence").isin(*VERIFIED), F.col("src"))
    # a row for each pair first, so that a symbol with very many edges is reduced before it moves
    pairs = live(edges).where("confidence != 'ambiguous'").groupBy("dst", "src").agg(F.max(verified).alias("v"))
    counts = pairs.groupBy("dst").agg(F.count("src").alias("caller_count"), F.count("v").alias("verified_caller_count"))
    zero = F.lit(0).cast("long")
    return symbols.select("qn").join(counts.hint("merge"), F.col("qn") == F.col("dst"), "left").select("qn", F.coalesce("caller_count", zero).alias("caller_count"), F.coalesce("verified_caller_count", zero).alias("verified_caller_count"))


def transitive(edges: DataFrame, start: DataFrame, max_depth: int = 4) -> DataFrame:
    """(origin, node, depth): what the starts reach; depth is that of the first discovery.

    Ambiguous edges list their target but aren't followed from it, unless another edge reaches it later.
    """
    steps = live(edges).select("src", "dst", (F.col("confidence") != "ambiguous").alias("sure")).groupBy("src", "dst").agg(F.max("sure").alias("sure"))
    steps = cut(steps)
    seen = start.select(F.col("node").alias("origin"), "node", F.lit(0).alias("depth"), F.lit(True).alias("sure"))
    frontier = seen.select("origin", "node")
    for depth in range(1, max_depth + 1):
        found = frontier.join(steps, F.col("node") == F.col("src")).groupBy("origin", F.col("dst").alias("node")).agg(F.max("sure").alias("sure")).withColumn("depth", F.lit(depth))
        known = seen.select("origin", "node", F.col("sure").alias("was"))
        new = cut(found.join(known, ["origin", "node"], "left").where("was is null or (sure and not was)").select("origin", "node", "depth", "sure"))
        if new.isEmpty():
            break
        frontier = new.where("sure").select("origin", "node")
        both = seen.unionByName(new).groupBy("origin", "node").agg(F.min("depth").alias("depth"), F.max("sure").alias("sure"))
        seen = cut(both)
    return seen.where("depth > 0").select("origin", "node", "depth", "sure")


def shortest_path_lengths(edges: DataFrame, start: DataFrame, max_hops: int = 6) -> DataFrame:
    """(origin, node, hops): lengths of the shortest paths; the start itself has zero hops."""
    steps = cut(live(edges).select("src", "dst").distinct())
    seen = start.select(F.col("node").alias("origin"), "node", F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, max_hops + 1):
        found = frontier.select("origin", F.col("node").alias("src")).join(steps, "src").select("origin", F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, ["origin", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def coreness(edges: DataFrame, confirmed: bool = True, at_once: int = small.EDGES) -> DataFrame:
    """(node, coreness) of the undirected graph without loops.

    Each node takes the h-index of its neighbours' values until nothing changes, which gives the core numbers (Lü et
    al. 2016), however many rounds that takes. A graph of at most ``at_once`` edges is peeled in one task instead, since long paths
    need many rounds. With ``confirmed``, edges of rank 0 don't count; an unknown confidence does.
    """
    use = live(edges).where("src != dst")
    if confirmed:
        use = use.where(F.coalesce(rank_of(F.col("confidence")), F.lit(1)) > 0)
    pair = use.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pair = cut(pair)
    if pair.count() <= at_once:
        return small.whole(pair, small.core_numbers, "node string, coreness long")
    both = cut(pair.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pair.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    values = cut(both.groupBy("u").agg(F.count("*").alias("h")))
    while True:
        # the h-index from counts of each value, so that a hub's neighbours needn't meet in one group
        told = both.join(values.select(F.col("u").alias("v"), F.col("h").alias("hv")), "v").join(values, "u")
        counts = told.select("u", F.least("hv", "h").alias("hv")).groupBy("u", "hv").agg(F.count("*").alias("n"))
        w = Window.partitionBy("u").orderBy(F.desc("hv"))
        new = counts.withColumn("at_least", F.sum("n").over(w)).groupBy("u").agg(F.max(F.least("hv", "at_least")).alias("h"))
        new = cut(new)
        changed = new.join(values.withColumnRenamed("h", "old"), "u").where("h != old").isEmpty()
        values = new
        if changed:
            break
    return values.select(F.col("u").alias("node"), F.col("h").alias("coreness"))


def hubs(counts: DataFrame, degree_callers: int = 5, top_percent: float = 5.0, bridge_callers: int = 4, bridge_coreness: int = 4) -> DataFrame:
    """hub_kind of each row of (qn, caller_count, coreness): degree, bridge or null.

    The percentile of a count is the share of counted symbols with at most that count;
    the third quartile of coreness is picked by index, not interpolated. Both come from counts by value.
    """
    by = counts.where("caller_count >= 1").groupBy("caller_count").agg(F.count("*").alias("n"))
    pct = by.select("caller_count", (F.sum("n").over(Window.orderBy("caller_count")) / F.sum("n").over(Window.partitionBy())).alias("pct"))
    cores = counts.where("coreness > 0").groupBy("coreness").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    upto = F.sum("n").over(Window.orderBy("coreness"))
    index = F.greatest(F.floor(total * 0.75) - 1, F.lit(0))
    p75 = cores.select("coreness", total.alias("total"), upto.alias("upto"), index.alias("index")).where("upto > index").agg(F.min("coreness").alias("p75"))
    out = counts.join(F.broadcast(pct), "caller_count", "left").crossJoin(F.broadcast(p75))
    bridge = (F.col("caller_count") >= bridge_callers) & (F.col("coreness") >= F.greatest(F.coalesce("p75", F.lit(1 << 40)), F.lit(bridge_coreness)))
    degree = (F.col("caller_count") >= degree_callers) & (F.col("pct") >= 1 - top_percent / 100)
    return out.select("qn", "caller_count", "coreness", F.when(degree, "degree").when(bridge, "bridge").alias("hub_kind"))


def cycles(edges: DataFrame, at_once: int = small.EDGES) -> DataFrame:
    """(node): nodes on a cycle of verified edges, loops included.

    Nodes without predecessors or successors are trimmed first; of the rest, a node is on a cycle if it reaches itself. Strong
    components come from forward colouring: the least label that reaches a node, then backward from its own. Each round removes a
    component at least; joins are shuffled, since the graph has no size bound, and rounds go on until no edge is left. What is left of at most ``at_once`` edges is done in one task.
    """
    use = live(edges).where(F.col("confidence").isin(*VERIFIED)).select("src", "dst").distinct()
    loops = use.where("src = dst").select(F.col("src").alias("node"))
    rest = cut(use.where("src != dst"))
    found = None
    while True:
        n = rest.count()
        if 0 < n <= at_once:
            own = small.whole(rest, small.cyclic_nodes, "node string")
            found = own if found is None else found.unionByName(own)
            break
        while n:  # trim
            kept = cut(rest.join(rest.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi").join(rest.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").select("src", "dst"))
            m = kept.count()
            rest, done, n = kept, m == n, m
            if done or n <= at_once:
                break
        if not n:
            break
        if n <= at_once:
            continue
        color = cut(rest.select(F.col("src").alias("node")).unionByName(rest.select(F.col("dst").alias("node"))).distinct().withColumn("c", F.col("node")))
        while True:  # the least node that reaches each
            told = rest.join(color.withColumnRenamed("node", "src").hint("merge"), "src").groupBy("dst").agg(F.min("c").alias("m"))
            new = cut(color.join(told.hint("merge"), F.col("node") == F.col("dst"), "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c")))
            same = new.join(color.withColumnRenamed("c", "o").hint("merge"), "node").where("c != o").isEmpty()
            color = new
            if same:
                break
        inside = rest.join(color.select(F.col("node").alias("src"), F.col("c").alias("cs")).hint("merge"), "src").join(color.select(F.col("node").alias("dst"), F.col("c").alias("cd")).hint("merge"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        inside = cut(inside)
        back = color.where("node = c").select("node")
        reached = back
        while True:  # backward from the label's own node, within the colour
            step = inside.join(reached.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct().join(reached, "node", "left_anti")
            step = cut(step)
            if step.isEmpty():
                break
            reached = cut(reached.unionByName(step))
        members = reached.join(color.hint("merge"), "node")
        large = members.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
        own = cut(members.join(large, "c", "left_semi").select("node"))
        found = own if found is None else found.unionByName(own)
        rest = cut(rest.join(reached.select(F.col("node").alias("src")), "src", "left_anti").join(reached.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return (loops if found is None else loops.unionByName(found)).distinct()


def boundary_ambiguous(symbols: DataFrame) -> DataFrame:
    """(qn): both of two neighbours in a file, by start, whose lines meet without one being inside the other."""
    w = Window.partitionBy("path").orderBy("line_start", "line_end", "qn")
    near = symbols.select("qn", "line_start", "line_end", F.lead("qn").over(w).alias("next"), F.lead("line_start").over(w).alias("s"), F.lead("line_end").over(w).alias("e"))
    meet = near.where((F.col("line_end") >= F.col("s")) & ~((F.col("s") > F.col("line_start")) & (F.col("e") <= F.col("line_end"))))
    return meet.select(F.explode(F.array("qn", "next")).alias("qn")).distinct()


def churn_scores(commits: DataFrame) -> DataFrame:
    """(path, commits, churn): commits of a file over the largest number of any."""
    n = commits.select("path", "commit_id").distinct().groupBy("path").agg(F.count("*").alias("commits"))
    top = n.agg(F.max("commits").alias("top"))
    return n.join(F.broadcast(top)).select("path", "commits", F.round(F.col("commits") / F.greatest("top", F.lit(1)), 6).alias("churn"))


def unique_type_targets(relations: DataFrame, types: DataFrame) -> DataFrame:
    """Relations (from_qn, target_name, language) with the one type of that name and language; null where there are none or several."""
    one = types.groupBy(F.col("name").alias("target_name"), "language").agg(F.count("*").alias("n"), F.min("qn").alias("target_qn")).where("n = 1").drop("n")
    return relations.join(one, ["target_name", "language"], "left").select("from_qn", "target_name", "language", "target_qn")


def file_dependencies(imports: DataFrame) -> DataFrame:
    """(path, direction, other): imports and importers of each file."""
    known = imports.where("to_path is not null").distinct()
    return known.select(F.col("from_path").alias("path"), F.lit("imports").alias("direction"), F.col("to_path").alias("other")).unionByName(known.select(F.col("to_path").alias("path"), F.lit("imported_by").alias("direction"), F.col("from_path").alias("other")))


def frontier(imports: DataFrame, calls: DataFrame, explored: DataFrame) -> DataFrame:
    """Files next to explored ones: their importers, and files that call into them, with the reason."""
    by_import = imports.join(explored.select(F.col("path").alias("to_path")), "to_path").select(F.col("from_path").alias("path")).distinct().withColumn("i", F.lit(True))
    by_call = calls.join(explored.select(F.col("path").alias("dst_path")), "dst_path").select(F.col("src_path").alias("path")).distinct().withColumn("c", F.lit(True))
    both = by_import.join(by_call, "path", "full").join(explored, "path", "left_anti")
    return both.select("path", F.when(F.col("i") & F.col("c"), "both").when(F.col("i"), "imported_by").otherwise("callers").alias("reason"))


def co_changes(commits: DataFrame, least: int = 3, top: int = 5) -> DataFrame:
    """For each file the ``top`` files that changed in the same commits at least ``least`` times, with the last day."""
    c = commits.select("commit_id", "day", "path").distinct()
    # a file with fewer commits than that has no partner; ordered halves are joined, each pair of a commit once
    often = c.groupBy("path").agg(F.count_distinct("commit_id").alias("n")).where(F.col("n") >= least).select("path")
    c = c.join(often, "path", "left_semi")
    half = c.join(c.select("commit_id", F.col("path").alias("other")), "commit_id").where("path < other").groupBy("path", "other").agg(F.count("*").alias("n"), F.max("day").alias("last")).where(F.col("n") >= least)
    pairs = half.unionByName(half.select(F.col("other").alias("path"), F.col("path").alias("other"), "n", "last"))
    w = Window.partitionBy("path").orderBy(F.desc("n"), "other")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def etag(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """A digest of each key's rows in their order: fields joined by U+0001, rows ended by U+0002."""
    row = F.struct(*order, F.concat(F.concat_ws("\u0001", *[F.col(f).cast("string") for f in fields]), F.lit("\u0002")).alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["text"]), "")
    return rows.groupBy(key).agg(F.sha2(whole, 256).alias("etag"))
