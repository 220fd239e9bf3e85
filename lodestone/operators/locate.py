"""Search legs beside the basic ones: text, symbols and chunks by vector, recall of notes, previews, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safety import redact
from ..functions.text import is_test_path
from .search import FUSION_K, nearest, phrase_bm25

#: Characters of a preview, notes of a recall, and the least similarity of a pattern's neighbours (fixed values).
PREVIEW, RECALL, PATTERN_SCORE = 160, 50, 0.75


def round_score(score: Column) -> Column:
    """Four decimals, halves away from zero."""
    return F.round(score, 4)


def fused_or_passed(legs: list[tuple[DataFrame, float]], limit: int) -> DataFrame:
    """(key, score, truncated) of result lists (key, score): rank fusion if all have rows, else the rows of those that have, as they are.

    Each list is cut to one more than ``limit``, which tells whether it goes on.
    """
    rows = None
    for k, (leg, weight) in enumerate(legs):
        top = leg.select("key", "score").orderBy(F.desc("score"), "key").limit(limit + 1)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key"))).withColumns({"leg": F.lit(k), "weight": F.lit(weight)})
        rows = ranked if rows is None else rows.unionByName(ranked)
    # limit + 1 rows of each leg at most, so these windows are small
    everything = Window.partitionBy()
    rows = rows.withColumns({"n_legs": F.size(F.collect_set("leg").over(everything)), "truncated": F.max(F.col("rank") > limit).over(everything)}).where(F.col("rank") <= limit)
    score = F.when(F.first("n_legs") == len(legs), F.sum(F.col("weight") / (FUSION_K + F.col("rank")))).otherwise(F.sum("score"))
    return rows.groupBy("key").agg(F.round(score, 9).alias("score"), F.first("truncated").alias("truncated")).orderBy(F.desc("score"), "key").limit(limit)


def text_search(symbols: DataFrame, chunks: DataFrame, phrase: str, limit: int = 20) -> DataFrame:
    """A phrase in docstrings with signatures, and in body chunks (both key, text), fused with weights 1.5 and 1."""
    return fused_or_passed([(phrase_bm25(symbols, phrase), 1.5), (phrase_bm25(chunks, phrase), 1.0)], limit)


def vector_results(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """(query_id, vec_id, score, truncated): the nearest ``limit`` with one minus the distance; one more tells whether there are more."""
    found = nearest(queries, vectors, limit + 1)
    more = F.max(F.col("place") > limit).over(Window.partitionBy("query_id"))
    return found.withColumn("truncated", more).where(F.col("place") <= limit).select("query_id", "vec_id", F.round(1 - F.col("distance"), 9).alias("score"), "truncated")


def semantic_search(query: DataFrame, symbols: DataFrame, chunks: DataFrame, limit: int = 20) -> DataFrame:
    """Symbols and chunks near one query vector, fused with equal weights; a side without vectors leaves the other as it is."""

    def leg(vectors: DataFrame) -> DataFrame:
        return vector_results(query, vectors, limit + 1).select(F.col("vec_id").alias("key"), "score")

    return fused_or_passed([(leg(symbols), 1.0), (leg(chunks), 1.0)], limit)


def chunk_results(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks (key, path, line_start, symbol_qn) as results: the symbol's identity if it is known, its name alone if it is gone, else the file's name."""
    s = symbols.select(F.col("qn").alias("symbol_qn"), F.col("name").alias("known"), F.col("is_test").alias("known_test"))
    met = chunks.join(s, "symbol_qn", "left")
    base = F.element_at(F.split("path", "/"), -1)
    return met.select(
        "key", F.coalesce("symbol_qn", F.concat("path", F.lit("#"), "line_start")).alias("id"), F.coalesce("known", "symbol_qn", base).alias("name"),
        F.coalesce("known_test", is_test_path(F.col("path"))).alias("is_test"),
    )


def without_tests(results: DataFrame, limit: int) -> DataFrame:
    """Of a list (key, score, is_test) cut to max(2 * limit, limit + 5), the first ``limit`` that are no tests; truncated if more were left."""
    fetched = results.orderBy(F.desc("score"), "key").limit(max(2 * limit, limit + 5)).where(~F.col("is_test"))
    rows = fetched.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "key")))
    return rows.withColumn("truncated", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)


def same_space(vectors: DataFrame, stored: DataFrame, current: dict[str, str]) -> DataFrame:
    """The vectors, or none if the stored model, version or dimension isn't the current one. ``stored`` is one row; without one none are kept."""
    same = F.lit(True)
    for name, value in current.items():
        same = same & F.col(name).cast("string").eqNullSafe(F.lit(value))
    return vectors.join(F.broadcast(stored.where(same).select(F.lit(True).alias("__same")).limit(1))).drop("__same")


def recall(notes: DataFrame, phrase: str | None = None, topic: str | None = None, quarantined: bool = False, limit: int = RECALL) -> DataFrame:
    """Notes (key, topic, text, updated_at, quarantined): of a topic, or by a phrase's BM25, or the latest; at most ``limit``."""
    shown = notes if quarantined else notes.where(~F.col("quarantined"))
    if topic is not None:
        rows = shown.where(F.col("topic") == topic).withColumn("score", F.lit(0.0))
    elif phrase:
        rows = shown.join(phrase_bm25(notes, phrase).select("key", "score"), "key")
    else:
        rows = shown.withColumn("score", F.lit(0.0))
    return rows.orderBy(F.desc("score"), F.desc("updated_at"), "key").limit(limit).select("key", "topic", "score", "updated_at")


def previews(sites: DataFrame, lines: DataFrame) -> DataFrame:
    """Sites (path, line) with the trimmed and redacted line, cut at ``PREVIEW`` characters; null if it is blank or out of range."""
    asked = sites.select("path", "line").distinct()
    # shuffled: lines have no size bound, and Spark's estimate of texts that are made by a plan is far too small
    found = asked.join(lines.select("path", F.col("line_no").alias("line"), F.col("line").alias("text")).hint("merge"), ["path", "line"], "left")

    def preview(text: Column) -> Column:
        return F.when(F.length(text) > PREVIEW, F.concat(F.left(text, F.lit(PREVIEW)), F.lit("…"))).otherwise(text)

    # the redacted line is bound as a lambda's variable, so that it is made once for each row
    short = F.transform(F.array(redact(F.trim("text"))), preview)[0]
    return found.select("path", "line", F.when(F.trim("text") != "", short).alias("preview"))


def pattern_debt(anchors: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """(anchor_id, n_left, status) of registered anchors (anchor_id): lost without a vector, resolved without neighbours of ``PATTERN_SCORE``, else open."""
    asked = vectors.join(anchors.select(F.col("anchor_id").alias("vec_id")), "vec_id", "left_semi")
    near = nearest(asked, vectors, k + 1).where("vec_id != query_id").where(1 - F.col("distance") >= PATTERN_SCORE).groupBy(F.col("query_id").alias("anchor_id")).agg(F.count("*").alias("n"))
    known = asked.select(F.col("vec_id").alias("anchor_id"), F.lit(True).alias("known"))
    met = anchors.select("anchor_id").join(known, "anchor_id", "left").join(near, "anchor_id", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return met.select("anchor_id", n.alias("n_left"), F.when(F.col("known").isNull(), "anchor_lost").when(n == 0, "resolved").otherwise("open").alias("status"))


def batch(ids: DataFrame, symbols: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` distinct ids (place, qn) of a request in their order, with the symbol's facts; null facts where it isn't known."""
    first = ids.groupBy("request", "qn").agg(F.min("place").alias("place"))
    kept = first.withColumn("k", F.row_number().over(Window.partitionBy("request").orderBy("place"))).where(F.col("k") <= most)
    return kept.join(symbols, "qn", "left").select("request", F.col("k").alias("place"), "qn", *[c for c in symbols.columns if c != "qn"])
