"""Readers of files and texts: walks, coverage, owners, manifests, thresholds, bundles."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..loops import dealt

#: Folders that a walk leaves out (a parameter).
IGNORED = (".git", "node_modules", "target", "dist", "build", "__pycache__", ".venv")
#: Defaults of the thresholds.
THRESHOLDS = {"max_complexity": 15, "max_callers": 50, "max_cycles": 0, "min_coverage": 0.0}


def walk(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, size, modified) of all files below a folder, but for ignored folders. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.concat(F.lit("/"), F.array_join(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), "/"), F.lit("/"))
    keep = F.lit(True)
    for folder in ignored:
        keep = keep & ~F.contains(inside, F.lit(f"/{folder}/"))
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(keep)


def upserted(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index with each changed path's last row (by seq, then hash) in place of its own. Both have path, hash; changes have seq too."""
    # dealt before anything is sorted: neither a reader's task nor a merged partition sorts all its rows
    last = dealt(changes, "path").groupBy("path").agg(F.max_by("hash", F.struct("seq", "hash")).alias("hash"))
    return dealt(index.select("path", "hash"), "path").join(last.hint("merge"), "path", "left_anti").unionByName(last)


def numbits(rows: DataFrame, blob: str = "numbits") -> DataFrame:
    """A10: a line for each bit that is set: byte * 8 + bit + 1, both from 0. Other columns stay."""
    digits = F.hex(blob)
    at = F.sequence(F.lit(0), F.length(digits) * 4 - 1)
    # two hexadecimal digits are a byte; bit 0 is its lowest
    byte = lambda x: F.conv(F.substring(digits, (F.floor(x / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    on = F.filter(at, lambda x: F.getbit(byte(x), (x % 8)) == 1)
    lines = F.when(F.length(digits) > 0, F.transform(on, lambda x: x + 1)).otherwise(F.array().cast("array<int>"))
    return rows.select(*[c for c in rows.columns if c != blob], F.explode(lines).alias("line"))


def discovered(candidates: DataFrame) -> DataFrame:
    """Of a root's candidates (root, priority, path, readable) the first that can be read."""
    return candidates.where("readable").groupBy("root").agg(F.min_by("path", F.struct("priority", "path")).alias("path"))


def code_owners(files: DataFrame) -> DataFrame:
    """(root, line_no, pattern, owners) of the first of each root's files (root, priority, text); comments and blank lines are passed over."""
    first = files.where("text is not null").groupBy("root").agg(F.min_by("text", "priority").alias("text"))
    rows = first.select("root", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))
    rows = rows.where("line != '' and not startswith(line, '#')")
    words = F.split("line", " ")
    return rows.select("root", (F.col("i") + 1).alias("line_no"), words[0].alias("pattern"), F.slice(words, 2, 1 << 20).alias("owners"))


def toml_dependencies(files: DataFrame) -> DataFrame:
    """(path, ecosystem, name, version, kind) of Cargo.toml texts and of project dependencies in pyproject.toml texts.

    A line belongs to the last section header above it; version is that of a plain string or of a table's ``version``.
    """
    rows = files.select("path", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy("path").orderBy("i")
    rows = rows.withColumn("section", F.last(F.when(F.col("line").rlike(r"^\[[^\]]+\]$"), F.expr("substring(line, 2, length(line) - 2)")), True).over(w))
    cargo = rows.where(F.col("path").endswith("Cargo.toml") & F.col("section").isin("dependencies", "dev-dependencies", "build-dependencies") & F.col("line").rlike(r"^[A-Za-z0-9_-]+\s*="))
    quoted = F.regexp_extract("line", r'^[A-Za-z0-9_-]+\s*=\s*"([^"]*)"', 1)
    inner = F.regexp_extract("line", r'version\s*=\s*"([^"]*)"', 1)
    kind = F.when(F.col("section") == "dev-dependencies", "dev").when(F.col("section") == "build-dependencies", "build").otherwise("normal")
    cargo = cargo.select("path", F.lit("cargo").alias("ecosystem"), F.regexp_extract("line", r"^([A-Za-z0-9_-]+)", 1).alias("name"), F.when(quoted != "", quoted).otherwise(inner).alias("version"), kind.alias("kind"))
    py = rows.where(F.col("path").endswith("pyproject.toml") & (F.col("section") == "project") & F.col("line").rlike(r'^"[A-Za-z0-9]'))
    py = py.select("path", F.lit("pypi").alias("ecosystem"), F.regexp_extract("line", r'^"([A-Za-z0-9._-]+)', 1).alias("name"), F.regexp_extract("line", r"[=<>~!]=?\s*([0-9][^\",;\s]*)", 1).alias("version"), F.lit("normal").alias("kind"))
    return cargo.unionByName(py)


def thresholds(text: str | None) -> dict[str, float]:
    """Thresholds of a TOML text over the defaults; unknown names are passed over. The text is one small file."""
    given = tomllib.loads(text or "")
    return {k: given.get("thresholds", given).get(k, v) for k, v in THRESHOLDS.items()}


def export_bundle(tables: dict[str, DataFrame], place: str) -> None:
    """Each table as Parquet below ``place``, then a manifest with columns and rows: a bundle without one isn't complete."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{place}/{name}")
        rows.append((name, json.dumps(df.schema.jsonValue()), spark.read.parquet(f"{place}/{name}").count()))
    spark.createDataFrame(rows, "name string, schema string, n long").coalesce(1).write.json(f"{place}/manifest")


def import_bundle(spark: SparkSession, place: str) -> dict[str, DataFrame]:
    """The tables of a bundle; a table that doesn't hold what the manifest says raises."""
    out = {}
    for name, n in spark.read.schema("name string, schema string, n long").json(f"{place}/manifest").select("name", "n").collect():
        out[name] = spark.read.parquet(f"{place}/{name}")
        if out[name].count() != n:
            raise ValueError(f"{name} doesn't have the {n} rows that the manifest names")
    return out
