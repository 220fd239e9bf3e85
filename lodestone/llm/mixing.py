"""Mixing sources to target weights by Poisson replication.

A source with target weight w (shares of all weights) among N documents, of which it
has n, gets the mean repetition rate w * N * epochs / n. Each document draws its
number of copies from a Poisson distribution with that mean, by inverting its
distribution function at a number that a hash of seed, doc_id, and text gives. A mean over
``PART`` is split into equal parts of at most ``PART``, each inverted at a hashed number of its own, and
the sum is drawn: so a distribution function has few entries whatever the mean. The draw
needs no coordination, and a task that runs again draws the same. Copies then go
through a global shuffle: an order by the hash of seed, document, and copy.

Only the counts by source are aggregated, before anything moves. The shuffle's key is
a hash of each copy, so a source that holds a third of the rows is spread as
evenly as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize, sized, table, unit_hash

SEED = 17
EPOCHS = 1.0
#: Largest mean that is inverted at once; its distribution function has at most ``ENTRIES`` entries.
PART, ENTRIES = 32, 128
#: Copies that are exploded at once.
RUN = 4096

_U = "('0x' || substr(md5(concat_ws(':', {})), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"
#: Weights of the query: each source the same share.
ORACLE = {
    "op6_mixing": f"""
        WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        rate AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM n)) * (SELECT sum(n) FROM n)::DOUBLE * {EPOCHS}::DOUBLE / n AS rate FROM n),
        drawn AS (
            SELECT d.*, rate, {_U.format(f"'{SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, ''))")} AS u
            FROM documents d JOIN rate r ON d.source IS NOT DISTINCT FROM r.source),
        steps AS (
            SELECT source, rate, 0 AS k, -rate AS logp, exp(-rate) AS cdf FROM rate
            UNION ALL
            SELECT source, rate, k + 1, logp + ln(rate / (k + 1)), cdf + exp(logp + ln(rate / (k + 1))) FROM steps
            WHERE k + 1 < ceil(rate + 12 * sqrt(rate) + 24)),
        cdfs AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM steps GROUP BY source),
        copies AS (
            SELECT doc_id, text, lang, d.source, n_chars, rate, unnest(range(1, len(list_filter(cdf, lambda c: c <= u)) + 1)) AS copy
            FROM drawn d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source)
        SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, round(rate, 9) AS rate,
            {_U.format(f"'{SEED + 1}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')), copy::VARCHAR")} AS shuffle_key
        FROM copies
    """,
}


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, column: str = "source") -> DataFrame:
    """(source, rate): the mean number of copies of a document.

    ``weights`` names target weights; without it each source has the same. A
    source that isn't named has weight 0. A null source counts as a source of its own,
    named by None.
    """
    counts = docs.groupBy(F.col(column).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        spark = docs.sparkSession
        named = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "name string, weight double")
        counts = counts.join(sized(named, len(weights), 100), F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    counts = materialize(counts, "sources")
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_w"))
    share = F.try_divide(F.col("weight"), F.col("all_w"))
    return counts.join(F.broadcast(total)).select("source", F.coalesce(share * F.col("all_n").cast("double") * F.lit(epochs) / F.col("n"), F.lit(0.0)).alias("rate"))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far into the tail of a mean of at most ``PART``; terms are carried as logarithms."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct((-rate).alias("logp"), F.array(F.exp(-rate)).alias("cdf"))

    def add(a: Column, k: Column) -> Column:
        logp = a["logp"] + F.ln(rate / k)
        return F.struct(logp.alias("logp"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + F.exp(logp))).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(last - 1, F.lit(1))), start, add, lambda a: a["cdf"])


def drawn(parts: Column, cdf: Column, doc_id: str, digest: Column, seed: int) -> Column:
    """The number of copies (a long): the sum of the draws of all parts. The first part's number is hashed without the part."""

    def draw(u: Column) -> Column:
        # u is bound once; inside the inner function alone it would be hashed again for each entry
        found = F.transform(F.array(u), lambda x: F.size(F.filter(cdf, lambda c: c <= x)).cast("long"))
        return F.coalesce(F.element_at(found, 1), F.lit(0).cast("long"))

    others = F.when(parts > 1, F.sequence(F.lit(2).cast("long"), parts)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(others, draw(unit_hash(doc_id, digest, seed=seed)), lambda a, k: a + draw(unit_hash(doc_id, digest, k, seed=seed)))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: int = SEED, column: str = "source") -> DataFrame:
    """The copies of ``docs`` in shuffled order, with copy (from 1), rate and shuffle_key added.

    A document is drawn by its doc_id and text together: repeated rows draw the same
    number, and null ids or texts are fine. A source of rate 0 gives no copies. An
    empty table gives no rows. Columns of ``docs`` with the added names are replaced. A draw hashes once for
    each ``PART`` copies or fewer, and copies come in runs, so a rate of any size needs bounded memory.
    """
    spark = docs.sparkSession
    kept = columns(docs, "copy", "rate", "shuffle_key")
    table_ = rates(docs, weights, epochs, column).withColumn("__parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)))
    table_ = materialize(table_.withColumn("__cdf", F.when(F.col("rate") > 0, poisson_cdf(F.col("rate") / F.col("__parts")))), "rates")
    table_ = table_.select(F.col("source").alias("__source"), F.col("rate"), "__parts", "__cdf")
    met = docs.select(*kept).join(sized(table_, table_.count(), 8 * ENTRIES + 100), F.col(column).eqNullSafe(F.col("__source")))
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    met = met.withColumn("__text", digest)
    met = met.withColumn("__n", drawn(F.col("__parts"), F.col("__cdf"), "doc_id", F.col("__text"), seed)).where("__n > 0")
    # two steps, so that no array grows with the number of copies
    runs = met.withColumn("__from", F.explode(F.expr(f"sequence(1L, __n, {RUN}L)")))
    copies = runs.withColumn("copy", F.explode(F.expr(f"sequence(cast(__from as int), cast(least(__n, __from + {RUN - 1}) as int))")))
    copies = copies.withColumn("shuffle_key", unit_hash("doc_id", "__text", "copy", seed=seed + 1))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return copies.select(*kept, "copy", "rate", "shuffle_key").repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, each source at the same weight; null sources are a source of their own."""
    return mix(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))
