"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Everything on the way from URL to verdict is a DataFrame expression. The features
(lengths, depth, digit ratio, entropy, parameters, suffix statistics) are binned before anything moves; equal
bin vectors collapse to one row with counts, and each boosting round is one
aggregate for each level of its tree that may be split, over that table: sums of gradients and
Hessians by leaf, feature, and bin. Only these sums, at most leaves * features *
bins rows, come to the driver, which picks the splits. The finished trees are one
CASE expression, which Catalyst compiles.

Training labels are the URLs that a rule decides: its verdict is their label. A host without a path (``http://example.org``)
fits no rule, since a rule's path begins with its slash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize, sized, table

#: (rule, verdict): a host suffix, a slash, and a path prefix.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
TREES, DEPTH, RATE, RIDGE, LEAST_HESSIAN = 10, 3, 0.3, 1.0, 1.0
#: Upper bounds (exclusive) of the bins; a value at or over the last bound is in the last bin.
BINS = {
    "url_length": (20, 30, 35, 40, 45, 50, 60, 80, 120),
    "host_length": (8, 12, 16, 18, 20, 22, 24, 28, 40),
    "path_length": (1, 5, 8, 9, 10, 11, 13, 16, 24, 48),
    "depth": (1, 2, 3, 4, 5, 7),
    "host_parts": (1, 2, 3, 4, 5),
    "digit_ratio": (0.01, 0.05, 0.08, 0.11, 0.14, 0.2, 0.3),
    "entropy": (2.5, 3.0, 3.25, 3.5, 3.75, 4.0, 4.25, 4.5),
    "parameters": (1, 2, 3, 5),
    "hyphens": (1, 2, 3, 5),
    "https": (1,),
    "suffix_rate": (0.02, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.98),
}


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(__url, instr(__url, '://') + 3)"), "/", 1))
    cut = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.coalesce(F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def with_parts(pages: DataFrame, column: str = "url") -> DataFrame:
    """Adds __url, host and path."""
    rows = pages.withColumn("__url", F.col(column).cast("string"))
    rows = rows.withColumn("host", host(F.col("__url")))
    rest = F.expr("substring(__url, instr(__url, '://') + 3 + length(host))")
    path = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return rows.withColumn("path", F.when(F.instr("__url", "://") > 0, path).otherwise(F.lit("")))


def with_rule(rows: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds rule and rule_verdict: of the rules that fit, the longest (of equal length, the one that sorts first).

    A rule fits its host and all subdomains, if the path starts with the rule's.
    The rules are a parameter of bounded number, so they are one expression.
    """
    rule = verdict = F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), [-ord(c) for c in x[0]])):  # later ones win
        h, p = r.split("/", 1)
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def with_features(rows: DataFrame) -> DataFrame:
    """Adds the lexical features, but for suffix_rate, and suffix (the last label of the host)."""
    u = F.coalesce("__url", F.lit(""))
    size = F.length(u)
    query = F.when(F.instr(u, "?") > 0, F.substring_index(F.expr("substring(__url, instr(__url, '?') + 1)"), "#", 1)).otherwise(F.lit(""))

    def part(a: Column, c: Column) -> Column:
        p = (size - F.length(F.replace(u, c))) / size
        return a - p * F.log2(p)

    # in bits, over all characters, each looked at once
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(part(a, c)))
    digits = size - F.length(F.translate(u, "0123456789", ""))
    return rows.withColumns(
        {
            "url_length": size,
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
            "host_parts": F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))),
            "digit_ratio": F.coalesce(F.try_divide(digits.cast("double"), size), F.lit(0.0)),
            "entropy": F.when(size > 0, entropy).otherwise(0.0),
            "parameters": F.when(query == "", 0).otherwise(F.size(F.filter(F.split(query, "[&;]"), lambda x: x != ""))),
            "hyphens": size - F.length(F.translate(u, "-_", "")),
            "https": F.startswith(u, F.lit("https:")).cast("int"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


def binned(rows: DataFrame, names: tuple[str, ...] = tuple(BINS)) -> DataFrame:
    """Replaces each feature by its bin's number."""

    def bin_of(name: str) -> Column:
        out = F.when(F.col(name) < BINS[name][0], 0)
        for k, bound in enumerate(BINS[name][1:], 1):
            out = out.when(F.col(name) < bound, k)
        return out.otherwise(len(BINS[name]))

    return rows.withColumns({name: bin_of(name) for name in names})


@dataclass
class Node:
    """A leaf with ``value``, or a split: bins up to ``upto`` of ``feature`` go left."""

    value: float = 0.0
    feature: str | None = None
    upto: int = 0
    left: Node | None = None
    right: Node | None = None

    def expression(self) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) <= self.upto, self.left.expression()).otherwise(self.right.expression())


@dataclass
class Model:
    base: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def margin(self) -> Column:
        return sum((t.expression() for t in self.trees), F.lit(self.base))


def fit(pages: DataFrame, column: str = "url", rules: tuple[tuple[str, str], ...] = RULES, features: tuple[str, ...] = tuple(BINS)) -> tuple[Model, DataFrame, float]:
    """The trees, the suffix statistics as a written table, and the overall share of blocked URLs.

    Statistics of a suffix are smoothed with 20 URLs of the overall share, so that rare suffixes say little.
    """
    labelled = with_features(with_rule(with_parts(pages, column), rules).where("rule is not null")).withColumn("label", F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0))
    raw = tuple(c for c in BINS if c != "suffix_rate")
    labelled = materialize(binned(labelled, raw).groupBy("suffix", "label", *raw).agg(F.count("*").alias("n")), "labelled")
    totals = labelled.agg(F.sum("n"), F.sum(F.col("label") * F.col("n"))).first()
    share = (totals[1] or 0.0) / totals[0] if totals[0] else 0.5
    by = labelled.groupBy("suffix").agg(F.sum(F.col("label") * F.col("n")).alias("blocked"), F.sum("n").alias("n"))
    rates = materialize(by.select("suffix", ((F.col("blocked") + 20 * share) / (F.col("n") + 20)).alias("suffix_rate")), "suffixes")
    rows = binned(labelled.join(rates, "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(share))), ("suffix_rate",))
    rows = materialize(rows.groupBy(*BINS).agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("y")), "bins")
    p = min(max(share, 1e-3), 1 - 1e-3)
    model = Model(base=math.log(p / (1 - p)))
    if 0 < share < 1:
        for _ in range(TREES):
            model.trees.append(_grow(rows, model, features))
    return model, rates, share


def _grow(rows: DataFrame, model: Model, features: tuple[str, ...]) -> Node:
    """One tree, level by level: an aggregate finds the sums of all leaves, features and bins of a level. A split tells its leaves' values."""
    prob = 1 / (1 + F.exp(-model.margin()))
    root = Node()
    leaves = [root]
    for _ in range(DEPTH):
        told = rows.select(_leaf_of(root, leaves).alias("leaf"), (F.col("n") * prob - F.col("y")).alias("g"), (F.col("n") * prob * (1 - prob)).alias("h"), *features).where("leaf >= 0")
        bins = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(c).alias("bin")) for k, c in enumerate(features)]))
        sums: dict[int, dict[int, list]] = {}
        for r in told.select("leaf", "g", "h", bins.alias("b")).groupBy("leaf", "b.feature", "b.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums.setdefault(r["leaf"], {}).setdefault(r["feature"], []).append((r["bin"], r["g"], r["h"]))
        grown = []
        for k, node in enumerate(leaves):
            by = sums.get(k)
            if not by:
                continue
            some = by[min(by)]
            g, h = sum(x[1] for x in some), sum(x[2] for x in some)
            node.value = round(-RATE * g / (h + RIDGE), 9)
            best = None
            for feature, xs in sorted(by.items()):
                gl = hl = 0.0
                for b, dg, dh in sorted(xs)[:-1]:
                    gl, hl = gl + dg, hl + dh
                    if min(hl, h - hl) < LEAST_HESSIAN:
                        continue
                    gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = gain, feature, b, gl, hl
            if best:
                _, feature, b, gl, hl = best
                node.feature, node.upto = features[feature], b
                node.left, node.right = Node(round(-RATE * gl / (hl + RIDGE), 9)), Node(round(-RATE * (g - gl) / (h - hl + RIDGE), 9))
                grown += [node.left, node.right]
        leaves = grown
        if not leaves:
            break
    return root


def _leaf_of(root: Node, leaves: list[Node]) -> Column:
    number = {id(n): k for k, n in enumerate(leaves)}

    def at(node: Node) -> Column:
        if node.feature is None:
            return F.lit(number.get(id(node), -1))
        return F.when(F.col(node.feature) <= node.upto, at(node.left)).otherwise(at(node.right))

    return at(root)


def judge(pages: DataFrame, column: str = "url", rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and block_score.

    A rule's verdict is final; other URLs are blocked where the trees give ``threshold`` or
    more. A null URL, or one without ``://``, has an empty host and path and is
    judged by its other features. Without labelled URLs of both verdicts the score is the share of blocked ones
    (one half without any). Columns of ``pages`` with the added names are replaced; an empty table gives no rows.
    """
    model, rates, share = fit(pages, column, rules)
    keep = columns(pages, "host", "path", "rule", "verdict", "block_score")
    inner = with_features(with_rule(with_parts(pages.select(F.struct(*keep).alias("__page"), F.col(column).alias("__given")), "__given"), rules))
    scored = with_score(inner, model, rates, share)
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return scored.select("__page.*", "host", "path", "rule", verdict.alias("verdict"), F.round("block_score", 6).alias("block_score"))


def with_score(rows: DataFrame, model: Model, rates: DataFrame, share: float) -> DataFrame:
    """Adds block_score to rows that have features and suffix; the features are binned."""
    known = rates.withColumnRenamed("suffix", "__suffix")
    found = rows.join(sized(known, known.count(), 64), rows["suffix"] == known["__suffix"], "left")
    scored = binned(found.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(share))))
    return scored.withColumn("block_score", 1 / (1 + F.exp(-model.margin())))


def held_out(pages: DataFrame, column: str = "url", rules: tuple[tuple[str, str], ...] = RULES, features: tuple[str, ...] = tuple(BINS)) -> dict[str, float]:
    """How the trees judge URLs that a rule decides, a fifth by hash, when fitted on the others: n, accuracy, and the accuracy of the more frequent verdict."""
    fold = F.pmod(F.xxhash64(F.col(column), F.lit(3)), F.lit(5)) == 0
    model, rates, share = fit(pages.where(~fold), column, rules, features)
    rows = with_score(with_features(with_rule(with_parts(pages.where(fold), column), rules).where("rule is not null")), model, rates, share)
    right, block = (F.col("block_score") >= 0.5) == (F.col("rule_verdict") == "block"), F.avg((F.col("rule_verdict") == "block").cast("int"))
    n, accuracy, blocked = rows.agg(F.count("*"), F.avg(right.cast("int")), block).first()
    return {"n": n, "accuracy": accuracy or 0.0, "majority": max(blocked or 0.0, 1 - (blocked or 0.0))}


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of each page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
