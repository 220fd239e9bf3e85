"""Exact deduplication of a batch against an immutable snapshot.

Digests of the snapshot's distinct texts are kept in buckets, each with a static
binary-fuse filter (Graefe and Lemire 2022) of one byte for a slot. The digests of
an incoming batch are grouped among themselves first; then each distinct one is
held against its bucket's filter. Those that the filter rules out are new. The others
join the snapshot's exact bucket, and the two texts are compared byte by byte.

A snapshot is written once (:func:`write_snapshot`): digests, groups, filters, and last a manifest, without which it
isn't complete. Later batches open it (:func:`open_snapshot`) and build nothing anew.

Digests and filters are dealt by bucket, a range of hash values, so no bucket is
hot however often a text repeats. The text itself is only moved for the byte check,
for one row on either side.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, sized, table, with_row_id

#: Digests of a bucket, about, and the least number of buckets.
BUCKET_KEYS, LEAST_BUCKETS = 1 << 17, 64
SEGMENTS = 32  # overlapping windows of three segments out of so many

ORACLE = {
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
}


# --- binary-fuse filters -------------------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _places(h: np.ndarray, segment: int) -> np.ndarray:
    """The three slots of each hash, in three segments that follow each other."""
    start = ((h >> np.uint64(40)) * np.uint64(SEGMENTS - 2) >> np.uint64(24)).astype("i8")
    within = [(h >> np.uint64(s)) % np.uint64(segment) for s in (0, 13, 26)]
    return np.stack([(start + i) * segment + within[i].astype("i8") for i in range(3)])


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype("u1")


def build_filter(keys: np.ndarray) -> bytes:
    """A filter for distinct 64-bit keys: 8 bytes of seed, 8 of segment length, then the slots."""
    keys = np.unique(np.asarray(keys, dtype="u8"))
    n = len(keys)
    for seed in range(1, 200):
        segment = max(8, int(np.ceil((1.25 + 0.02 * (seed // 8)) * n / SEGMENTS)) + 4)
        h = _mix(keys, seed)
        at = _places(h, segment)
        size = segment * SEGMENTS
        degree = np.bincount(at.reshape(-1), minlength=size)
        sums = np.zeros(size, "u8")  # of the numbers of the keys that use a slot
        for row in at:
            np.bitwise_xor.at(sums, row, np.arange(n, dtype="u8"))
        order = []
        single = np.flatnonzero(degree == 1)
        while len(single):
            key, first = np.unique(sums[single].astype("i8"), return_index=True)
            order.append((key, single[first]))
            for row in at[:, key]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(sums, row, key.astype("u8"))
            near = np.unique(at[:, key])
            single = near[degree[near] == 1]
        if sum(len(k) for k, _ in order) < n:
            continue
        slots = np.zeros(size, "u1")
        for key, own in reversed(order):
            a, b, c = at[:, key]
            slots[own] = _print(h[key]) ^ slots[a] ^ slots[b] ^ slots[c]  # its own slot is still zero
        return np.array([seed, segment], "<u8").tobytes() + slots.tobytes()
    raise RuntimeError("no filter was found")


def may_hold(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """False where the filter rules a key out; true for all keys that it was built from, and for about one in 256 others."""
    seed, segment = np.frombuffer(blob, "<u8", 2)
    slots = np.frombuffer(blob, "u1", offset=16)
    h = _mix(np.asarray(keys, dtype="u8"), int(seed))
    a, b, c = _places(h, int(segment))
    return slots[a] ^ slots[b] ^ slots[c] == _print(h)


# --- the operator --------------------------------------------------------------------------------


def normalized(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, old: bool) -> DataFrame:
    """(__row, doc_id, text_sha256); from here on no text moves but for byte checks.

    Row numbers are unique over both tables, and those of the snapshot are the smaller ones. They hold once the rows are written.
    """
    rows = with_row_id(docs.select("doc_id", F.sha2(normalized().cast("binary"), 256).alias("text_sha256")))
    return rows.withColumn("__row", F.col("__row") - (1 << 62)) if old else rows


@dataclass(frozen=True)
class Snapshot:
    """An immutable set of documents whose digests, groups and filters lie below ``place``. ``docs`` are read again for byte checks alone."""

    place: str
    docs: DataFrame
    buckets: int

    def part(self, name: str, schema: str) -> DataFrame:
        return self.docs.sparkSession.read.schema(schema).parquet(f"{self.place}/{name}")

    @property
    def rows(self) -> DataFrame:
        return self.part("digests", f"doc_id {self._id()}, text_sha256 string, __row long")

    @property
    def groups(self) -> DataFrame:
        return self.part("groups", f"text_sha256 string, first struct<no_id: boolean, doc_id: {self._id()}, __row: long>, n long, bucket int")

    @property
    def filters(self) -> DataFrame:
        return self.part("filters", "bucket int, filter binary")

    def _id(self) -> str:
        return self.docs.schema["doc_id"].dataType.simpleString()


def write_snapshot(docs: DataFrame, place: str | None = None) -> Snapshot:
    """Writes the snapshot of ``docs`` (doc_id, text) to a new folder ``place``, by default one in the shared folder."""
    spark = docs.sparkSession
    place = place or f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    digests(docs, True).write.parquet(f"{place}/digests")
    first = Snapshot(place, docs, 0)
    made = Snapshot(place, docs, max(LEAST_BUCKETS, -(-first.rows.count() // BUCKET_KEYS)))
    _groups(made.rows, made.buckets).write.parquet(f"{place}/groups")
    build_filters(made.groups).write.parquet(f"{place}/filters")
    spark.createDataFrame([(made.buckets,)], "buckets long").coalesce(1).write.json(f"{place}/manifest")
    return made


def open_snapshot(docs: DataFrame, place: str) -> Snapshot:
    """The snapshot that was written from ``docs`` to ``place``."""
    return Snapshot(place, docs, docs.sparkSession.read.schema("buckets long").json(f"{place}/manifest").first()[0])


def _groups(rows: DataFrame, buckets: int) -> DataFrame:
    """One row for each digest: its first row (smallest doc_id, nulls last) and its count."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row"))
    key = F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long")
    return rows.groupBy("text_sha256").agg(first.alias("first"), F.count("*").alias("n")).withColumn("bucket", (key * buckets / (1 << 32)).cast("int"))


def _key(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([int(x[8:24], 16) for x in column.to_pylist()], dtype="u8")


def build_filters(groups: DataFrame) -> DataFrame:
    """(bucket, filter) for the digests of a snapshot."""

    def build(t: pa.Table) -> pa.Table:
        return pa.table({"bucket": t.column("bucket")[:1], "filter": pa.array([build_filter(_key(t.column("text_sha256")))], pa.binary())})

    return groups.select("bucket", "text_sha256").groupBy("bucket").applyInArrow(build, "bucket int, filter binary")


def screen(groups: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of ``groups`` that the snapshot's filters don't rule out."""

    def ask(rows: pa.Table, blobs: pa.Table) -> pa.Table:
        if not rows.num_rows or not blobs.num_rows:
            return rows.slice(0, 0)
        return rows.filter(pa.array(may_hold(blobs.column("filter")[0].as_py(), _key(rows.column("text_sha256")))))

    left = groups.select("bucket", "text_sha256")
    return left.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(ask, "bucket int, text_sha256 string")


def dedup_against(snapshot: Snapshot | DataFrame, incoming: DataFrame) -> DataFrame:
    """One row for each row of the snapshot and of ``incoming``: doc_id, keep_id, group_size, kept, text_sha256, in_snapshot.

    A DataFrame in place of a snapshot is written as one first. Texts are equal when identical after each run of ASCII white space is
    replaced by one space; null counts as empty. Of equal texts, in both tables
    together, the row with the smallest doc_id stays; a null id counts as the largest,
    and of repeated ids one row stays. Empty tables are fine. Other columns are ignored.
    """
    if not isinstance(snapshot, Snapshot):
        snapshot = write_snapshot(snapshot)
    old_rows, old, filters = snapshot.rows, snapshot.groups, snapshot.filters
    new_rows = materialize(digests(incoming, False), "digests")
    new = materialize(_groups(new_rows, snapshot.buckets), "batch")
    asked = screen(new, filters)
    # exact buckets: the same digest on either side
    pairs = new.join(asked, ["bucket", "text_sha256"], "left_semi").join(old.select("bucket", "text_sha256", F.col("first").alias("old_first"), F.col("n").alias("old_n")), ["bucket", "text_sha256"])
    pairs = materialize(pairs, "positives")
    same = _same_bytes(pairs, snapshot.docs, incoming)
    met = pairs.join(same, "text_sha256", "left_semi").select("text_sha256", F.least("first", "old_first").alias("keep"), (F.col("n") + F.col("old_n")).alias("group_size"), F.col("old_first").isNotNull().alias("old"))
    met = materialize(met, "met")
    known = sized(met, met.count(), 100)

    def told(rows: DataFrame, groups: DataFrame, is_old: bool) -> DataFrame:
        named = groups.select("text_sha256", "first", "n").join(known, "text_sha256", "left")
        named = materialize(named.select("text_sha256", F.coalesce("keep", "first").alias("keep"), F.coalesce("group_size", "n").alias("group_size")), "groups")
        return rows.join(named, "text_sha256").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("__row") == F.col("keep.__row")).alias("kept"), "text_sha256", F.lit(is_old).alias("in_snapshot"))

    return told(old_rows, old, True).unionByName(told(new_rows, new, False))


def _same_bytes(pairs: DataFrame, snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """The digests whose first text in the snapshot and first text in the batch agree byte by byte."""
    n = pairs.count()

    def texts(docs: DataFrame, first: str) -> DataFrame:
        wanted = pairs.select("text_sha256", F.col(f"{first}.doc_id").alias("__id"))
        ids = wanted.select("__id").distinct()
        few = docs.join(sized(ids, n, 16), docs["doc_id"].eqNullSafe(ids["__id"]), "left_semi").select("doc_id", normalized().alias("t"))
        few = few.withColumn("text_sha256", F.sha2(F.col("t").cast("binary"), 256))
        wanted = wanted.withColumnRenamed("text_sha256", "sha")
        return few.join(sized(wanted, n, 100), (few["text_sha256"] == wanted["sha"]) & few["doc_id"].eqNullSafe(wanted["__id"]), "left_semi").select("text_sha256", "t")

    both = texts(snapshot, "old_first").unionByName(texts(incoming, "first"))
    return both.groupBy("text_sha256").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).where("lo = hi and n >= 2").select("text_sha256")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The lower half of the ids as the snapshot, the rest (and null ids) as the incoming batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(((lo or 0) + (hi or 0)) // 2), F.lit(False))
    return dedup_against(docs.where(old), docs.where(~old)).drop("in_snapshot")
