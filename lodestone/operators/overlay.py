"""Proofs from outside laid over resolved edges: upgrades, missing edges, exclusions, and what the ledger of evidence says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def proven_targets(refs: DataFrame, defs: DataFrame, generation: int) -> DataFrame:
    """(site_id, target) of references (site_id, symbol, generation) of the current generation whose symbol is defined; a site with several targets proves none."""
    met = refs.where(F.col("generation") == generation).join(defs, "symbol").select("site_id", "target").distinct()
    return met.groupBy("site_id").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1").select("site_id", "target")


def overlaid(edges: DataFrame, proofs: DataFrame) -> DataFrame:
    """Edges (site_id, dst, confidence), those that agree with their site's proof as formal ones."""
    met = edges.join(proofs, "site_id", "left")
    return met.select("site_id", "dst", F.when(F.col("dst") == F.col("target"), "formal").otherwise(F.col("confidence")).alias("confidence"))


def match_rate(edges: DataFrame, proofs: DataFrame) -> DataFrame:
    """One row (n_targets, n_satisfied): proofs, and those that an edge agrees with."""
    agree = edges.select("site_id", F.col("dst").alias("target"), F.lit(1).alias("one")).distinct()
    return proofs.join(agree, ["site_id", "target"], "left").agg(F.count("*").alias("n_targets"), F.count("one").alias("n_satisfied"))


def insertions(edges: DataFrame, proofs: DataFrame, sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(site_id, target, action) of proofs without an edge: excluded if a confident edge of the site says otherwise, inserted if the site and the target are there just once.

    ``sites``: site_id; ``symbols``: qn. Other proofs are passed over.
    """
    once = lambda df, name: df.groupBy(name).agg(F.count("*").alias("n")).where("n = 1").select(name)
    open_ = proofs.join(edges.select("site_id", F.col("dst").alias("target")), ["site_id", "target"], "left_anti")
    sure = edges.where(F.col("confidence").isin("formal", "resolved")).select("site_id", F.lit(True).alias("conflict")).distinct()
    met = open_.join(sure, "site_id", "left")
    met = met.join(once(sites, "site_id").withColumn("s", F.lit(True)), "site_id", "left").join(once(symbols.select(F.col("qn").alias("target")), "target").withColumn("t", F.lit(True)), "target", "left")
    action = F.when(F.col("conflict"), "excluded").when(F.col("s") & F.col("t"), "inserted")
    return met.select("site_id", "target", action.alias("action")).where("action is not null")


def ledger_summary(evidence: DataFrame) -> DataFrame:
    """(status, disposition, n, rate): evidence rows of each kind, and their share of the status."""
    by = evidence.groupBy("status", "disposition").agg(F.count("*").alias("n"))
    total = by.groupBy("status").agg(F.sum("n").alias("all_n"))
    return by.join(F.broadcast(total), "status").select("status", "disposition", "n", F.round(F.col("n") / F.col("all_n"), 6).alias("rate"))
