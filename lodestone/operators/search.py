"""Search and ranking: phrase BM25, exact names, nearest vectors, fusion, personal boosts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import coreness_boost, rank_multiplier
from ..loops import cut

K1, B = 1.2, 0.75
#: Weights of the legs, the constant of rank fusion, the exact name's bonus and floor.
NAME_WEIGHT, TOKEN_WEIGHT, FUSION_K, EXACT_BONUS, EXACT_FLOOR = 1.5, 1.0, 20, 4.0, 1.0


def phrase_counts(docs: DataFrame, phrases: list[str], key: str = "key", text: str = "text") -> DataFrame:
    """(key, dl, tf): each row's number of tokens (lower-cased runs of letters and digits), and how often it holds each phrase: adjacent tokens, wherever they start.

    Texts are read once: what is counted of them is cut.
    """
    letter = r"[\p{L}\p{N}]"

    def pattern(phrase: str) -> str | None:
        words = phrase.lower().split()
        if not words or any(unicodedata.category(c)[0] not in "LN" for w in words for c in w):
            return None  # no token is like that
        # the first word is taken and the rest looked at, so that phrases may overlap
        rest = "".join(rf"[^\p{{L}}\p{{N}}]+{w}" for w in words[1:])
        return rf"(?<!{letter}){words[0]}(?={rest}(?!{letter}))"

    patterns = [pattern(p) for p in phrases]
    # the lower-cased text is bound as a lambda's variable, so that it is made once for each row
    counted = F.transform(F.array(F.lower(F.coalesce(F.col(text), F.lit("")))), lambda t: F.struct(F.regexp_count(t, F.lit(letter + "+")).alias("dl"), F.array(*[F.lit(0) if p is None else F.regexp_count(t, F.lit(p)) for p in patterns]).alias("tf")))[0]
    return cut(docs.select(key, counted.alias("c")).select(key, "c.dl", "c.tf"))


def bm25(counts: DataFrame, which: int = 0, key: str = "key") -> DataFrame:
    """(key, tf, score) of the rows that hold one of the phrases counted. Rows and mean length come from one aggregate of the counts."""
    rows = counts.select(key, "dl", F.col("tf")[which].alias("tf"))
    stats = rows.agg(F.count("*").alias("n"), F.count_if(F.col("tf") > 0).alias("df"), F.avg("dl").alias("avgdl"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.where(F.col("tf") > 0).join(F.broadcast(stats)).select(key, "tf", F.round(score, 6).alias("score"))


def phrase_bm25(docs: DataFrame, phrase: str, key: str = "key", text: str = "text") -> DataFrame:
    """(key, tf, score) of the rows that hold the phrase: adjacent tokens, counted as one term."""
    return bm25(phrase_counts(docs, [phrase], key, text), 0, key)


def symbol_search(symbols: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Two BM25 legs (signature; name tokens), each cut to twice the limit, an exact-name leg with a floor, and the rank factors."""
    cut = 2 * limit
    legs = [
        phrase_bm25(symbols, name.replace("_", " "), "qn", "signature").withColumn("score", F.col("score") * NAME_WEIGHT).orderBy(F.desc("score"), "qn").limit(cut),
        phrase_bm25(symbols.withColumn("words", F.replace("name", F.lit("_"), F.lit(" "))), name.replace("_", " "), "qn", "words").withColumn("score", F.col("score") * TOKEN_WEIGHT).orderBy(F.desc("score"), "qn").limit(cut),
        symbols.where(F.lower("name") == name.lower()).orderBy(F.desc("coreness"), "qn").limit(cut).select("qn", F.lit(0).alias("tf"), F.lit(0.0).alias("score")),
    ]
    met = legs[0].select("qn", "score").unionByName(legs[1].select("qn", "score")).unionByName(legs[2].select("qn", "score"))
    total = met.groupBy("qn").agg(F.sum("score").alias("text_score")).join(symbols, "qn")
    exact = F.lower("name") == name.lower()
    noisy = F.col("is_test") | (rank_multiplier(F.col("path"), F.lit(False), F.lit(0.0)) < 1)
    score = F.when(exact, F.greatest("text_score", F.lit(EXACT_FLOOR))).otherwise(F.col("text_score"))
    score = score * rank_multiplier(F.col("path"), F.col("is_test"), F.col("churn")) * coreness_boost(F.col("path"), F.col("is_test"), F.col("coreness")) * F.when(exact & ~noisy, EXACT_BONUS).otherwise(1.0)
    return total.select("qn", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "qn").limit(limit)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, size: int = 2) -> DataFrame:
    """(query_id, vec_id, distance, place): the ``k`` vectors with the smallest one minus dot product, ties by id; others dimensions are passed over.

    All pairs are compared: the stated queries are a block that every task gets, and a task multiplies it with blocks of its own vectors, keeping of each block the best
    ``k`` for each query. Vectors that are empty or hold something else than finite numbers go by Spark's own expressions.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e100)
    plain = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", finite), F.lit(False))
    pairs = lambda q, v: v.join(F.broadcast(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))), F.size("embedding") == F.size("q")).select("query_id", "vec_id", (1 - dot).alias("d"))
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    asked, numbers = queries.select("vec_id", "embedding"), vectors.select("vec_id", "embedding")
    met = _best_of_blocks(asked.where(plain & F.col("vec_id").isNotNull()), numbers.where(plain), k).unionByName(pairs(asked, numbers.where(~plain | F.col("vec_id").isNull()))).unionByName(pairs(asked.where(~plain | F.col("vec_id").isNull()), numbers.where(plain & F.col("vec_id").isNotNull())))
    met = met.select("query_id", "vec_id", F.round("d", 9).alias("distance"))
    # the best k of each slice of a query first, so that no query's rows all meet in one task
    best = F.row_number().over(Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(32))).orderBy("distance", "vec_id"))
    some = met.withColumn("place", best).where(F.col("place") <= k)
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return some.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


#: Vectors and queries that are multiplied at once.
BLOCK, ASKED = 8192, 512


def _best_of_blocks(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, d): of each block of vectors at least those that may be among the best ``k`` of a query by distance rounded to nine decimals, then id."""
    blocks: dict[int, tuple[list, list]] = {}
    for r in queries.toLocalIterator():
        ids, rows = blocks.setdefault(len(r["embedding"]), ([], []))
        ids.append(r["vec_id"])
        rows.append(np.array(r["embedding"], float))
    sent = vectors.sparkSession.sparkContext.broadcast({n: (np.array(ids), np.stack(rows)) for n, (ids, rows) in blocks.items()})
    schema = StructType([StructField("query_id", queries.schema["vec_id"].dataType), StructField("vec_id", vectors.schema["vec_id"].dataType), StructField("d", DoubleType())])

    def first(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of equal vectors those with the ``k`` smallest ids."""
        key = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((ids, key))
        at = key[order]
        keep = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
        return ids[keep], rows[keep]

    def best(ids: np.ndarray, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        names, asked = sent.value[rows.shape[1]]
        ids, rows = first(ids, rows)
        longest = np.sqrt((rows * rows).sum(1)).max()
        for lo in range(0, len(asked), ASKED):
            q = asked[lo : lo + ASKED]
            d = 1 - q @ rows.T
            if len(ids) > k:
                # a product differs from the sum in order by rounding alone; what it may decide, or rounding to nine decimals, is kept
                slack = 3e-9 + 1e-12 * np.sqrt((q * q).sum(1)) * longest
                i, j = np.nonzero(d <= (np.partition(d, k - 1, axis=1)[:, k - 1] + slack)[:, None])
            else:
                i, j = np.nonzero(np.ones(d.shape, bool))
            total = np.zeros(len(i))
            for c in range(rows.shape[1]):
                total += q[i, c] * rows[j, c]
            yield pd.DataFrame({"query_id": names[lo + i], "vec_id": ids[j], "d": 1 - total})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for f in frames:
            for i, x in zip(f["vec_id"], f["embedding"]):
                if len(x) in sent.value:
                    rows = held.setdefault(len(x), [])
                    rows.append((i, x))
                    if len(rows) == BLOCK:
                        yield from best(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))
                        rows.clear()
        for rows in held.values():
            if rows:
                yield from best(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))

    return vectors.where(F.col("vec_id").isNotNull()).mapInPandas(run, schema)


def fuse(legs: list[tuple[DataFrame, float]], key: str = "key", k: int = FUSION_K, limit: int | None = None) -> DataFrame:
    """Rank fusion: the sum of weight / (k + rank) over the legs (key, rank from 1); ties by key."""
    rows = None
    for df, weight in legs:
        leg = df.select(key, (F.lit(weight) / (k + F.col("rank"))).alias("s"))
        rows = leg if rows is None else rows.unionByName(leg)
    out = rows.groupBy(key).agg(F.round(F.sum("s"), 9).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(limit) if limit else out


def ranked(scored: DataFrame, key: str = "key") -> DataFrame:
    """A leg's rows with their rank; a leg is a result list, whole or cut before. Ranges of it are ranked each in a task, behind the number of rows in the ranges before."""
    order = [F.desc("score"), F.col(key)]
    parts = cut(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    return parts.join(F.broadcast(before), "part").withColumn("rank", rank).drop("part", "before")


def personalized(results: DataFrame, boosts: DataFrame, weight: float = 0.15) -> DataFrame:
    """Min-max normalised scores plus weighted boosts of their paths, if any result has one; else the scores as they are."""
    b = results.join(boosts, "path", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    all_ = b.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.max("boost").alias("top"))
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    return b.join(F.broadcast(all_)).select("key", "path", F.round(F.when(F.col("top") > 0, norm + weight * F.col("boost")).otherwise(F.col("score")), 6).alias("score"))


def proximity_boosts(imports: DataFrame, touched: DataFrame, now: int) -> DataFrame:
    """(path, boost): the largest 1 / (1 + now - touch) over the explored neighbours of a file, in either direction."""
    both = imports.select("from_path", "to_path").where("to_path is not null").distinct()
    near = both.unionByName(both.select(F.col("to_path").alias("from_path"), F.col("from_path").alias("to_path")))
    return near.join(touched.select(F.col("path").alias("to_path"), "touch"), "to_path").groupBy(F.col("from_path").alias("path")).agg(F.max(1.0 / (1 + now - F.col("touch"))).alias("boost"))


def resolution(results: DataFrame, near: float = 0.9) -> DataFrame:
    """(query, verdict): none, ambiguous (the second score is ``near`` the first), confident or weak."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    top = results.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("place = 1")
    return top.select("query", F.when(F.col("next") >= near * F.col("score"), "ambiguous").when(F.col("score") >= 1, "confident").otherwise("weak").alias("verdict"))
