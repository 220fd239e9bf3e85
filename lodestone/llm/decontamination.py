"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item's words give windows of ``WINDOW`` words. A window is seen as the
set of its word shingles (``SHINGLE`` words; a shorter window is one shingle).
Shingles are ordered by rarity, and since a window must be contained whole, its
rarest shingle alone is the necessary prefix: a document without that shingle
can't hold the window.

1. The distinct windows and their prefixes form a table, and the prefixes' hashes a bit
   map of fixed size, which every task gets.
2. One pass over the documents counts words and looks each of their shingles up in
   the bit map. A shingle that may be a prefix becomes a candidate with the words
   around it; documents stay where they are.
3. Candidates join the prefix table on the shingle's hash. The window's place
   follows from the shingle's offset in it (positional bound) and must lie inside the document
   (length bound); then the words are compared one by one.
4. The windows found give each document's covered words and items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, hold, map_batches, materialize, sized, table, with_row_id

WINDOW, SHINGLE = 10, 5
#: Bits of a hash that address the bit map: 2 MB, whatever the benchmark's size.
MAP_BITS = 24
#: Words whose hashes a worker remembers, and that it adds at once. Only speed depends on it.
CACHE_WORDS = 100_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_K = 0x9E3779B97F4A7C15
_hashes: dict[str, int] = {}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op9_decontamination": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        item_windows AS (
            SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS s
            FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT m FROM item_windows),
        doc_windows AS (
            SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
            FROM (SELECT d.*, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)),
        found AS (SELECT doc_id, i, doc_windows.m, item_id FROM doc_windows JOIN item_windows USING (m, s)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM found)) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_FOLD))


def words(column: str = "text") -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = F.translate(F.coalesce(F.col(column), F.lit("")), upper, lower)
    return F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode())


def word_hashes(found: list[str]) -> np.ndarray:
    hold(_hashes)
    known, out = _hashes, np.empty(len(found), "u8")
    for i in range(0, len(found), CACHE_WORDS):
        if len(known) > CACHE_WORDS:
            known.clear()
        some = found[i : i + CACHE_WORDS]
        for w in some:
            if w not in known:
                known[w] = _word_hash(w)
        out[i : i + CACHE_WORDS] = [known[w] for w in some]
    return out


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words."""
    n = len(h) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(max(n, 0), size, dtype="u8")
        for k in range(size):
            out = (out ^ h[k : k + n]) * np.uint64(_K)
            out ^= out >> np.uint64(29)
    return out


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window_id, words): the distinct windows; and with item_id, the items of each."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words().alias("w")).where("size(w) > 0 and item_id is not null")
    starts = w.withColumn("i", F.explode(F.expr(f"sequence(1, greatest(size(w) - {window}, 0) + 1)")))
    return starts.select("item_id", F.expr(f"slice(w, i, {window})").alias("words")).distinct().withColumn("window_id", F.xxhash64("words"))


def prefixes(distinct: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(hash, window_id, words, offset): each window's rarest shingle and where it is in the window. Ties: the smaller hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs, at = [], [], []
            for wid, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = shingle_hashes(word_hashes(ws), min(size, len(ws)))
                ids += [wid] * len(h)
                hs.append(h.view("i8"))
                at += range(len(h))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(hs) if hs else [], pa.int64()), pa.array(at, pa.int32())], ["window_id", "hash", "offset"])

    cuts = materialize(map_batches(distinct, cut, "window_id long, hash long, offset int"), "shingles")
    counts = cuts.groupBy("hash").agg(F.count_distinct("window_id").alias("n"))
    best = cuts.join(counts, "hash").groupBy("window_id").agg(F.min(F.struct("n", "hash", "offset")).alias("p"))
    return best.select("window_id", "p.hash", "p.offset").join(distinct, "window_id")


def bit_map(table_: DataFrame, bits: int = MAP_BITS) -> bytes:
    """A map with the bits of the prefixes' hashes set. Parts of it are made where the rows are; the driver puts their bytes together."""
    at = F.expr(f"shiftrightunsigned(hash, {64 - bits})")
    parts = table_.select(at.alias("at")).distinct().groupBy((F.col("at") / (1 << 16)).cast("int").alias("part")).agg(F.collect_list((F.col("at") % (1 << 16)).cast("int")).alias("at"))
    out = np.zeros(1 << bits, bool)
    for r in parts.toLocalIterator():
        out[r["part"] * (1 << 16) + np.array(r["at"])] = True
    return np.packbits(out).tobytes()


def candidates(docs: DataFrame, marked, sizes: list[int], window: int = WINDOW, bits: int = MAP_BITS) -> DataFrame:
    """Each row of ``docs`` (__row, doc_id, text) with n_words and its candidates: shingle hash, place, words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(marked.value, "u1")
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("around", pa.list_(pa.string()))]))
        for b in batches:
            counts, found = [], []
            for text in b.column(2).to_pylist():
                ws = words_of(text)
                counts.append(len(ws))
                mine = []
                h = word_hashes(ws)
                for size in sizes:
                    if size > len(ws):
                        continue
                    s = shingle_hashes(h, size)
                    slot = (s >> np.uint64(64 - bits)).astype("i8")
                    for at in np.flatnonzero(on[slot >> 3] >> (7 - (slot & 7)).astype("u1") & 1).tolist():
                        lo = max(0, at - window + size)
                        mine.append({"hash": int(s[at : at + 1].view("i8")[0]), "at": at, "lead": at - lo, "around": ws[lo : at + window]})
                found.append(mine)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(found, kind)], ["__row", "doc_id", "n_words", "found"])

    schema = "__row long, doc_id long, n_words long, found array<struct<hash: long, at: int, lead: int, around: array<string>>>"
    return map_batches(docs.select("__row", F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: __row, doc_id, n_words, n_hit, n_items, items (sorted strings).

    Null texts have no words. Items that are null, without words, or without an
    item_id give no window; an item of fewer words than the window is one window. Rows
    that share a doc_id are judged one by one. Empty tables give no hits or no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    by_item = materialize(windows(benchmark, window), "windows")
    distinct = by_item.select("window_id", "words").distinct()
    first = materialize(prefixes(distinct), "prefixes")
    sizes = sorted(r[0] for r in first.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect())
    marked = spark.sparkContext.broadcast(bit_map(first))
    rows = materialize(candidates(with_row_id(docs.select("doc_id", "text")), marked, sizes, window), "candidates")
    near = rows.select("__row", F.col("n_words").alias("__n"), F.explode("found").alias("c")).select("__row", "__n", "c.*")
    n = first.count()
    met = near.join(sized(first, n, 200), "hash")
    begin, length = F.col("at") - F.col("offset"), F.size("words")
    lead = F.col("lead") - F.col("offset")
    inside = (begin >= 0) & (begin + length <= F.col("__n")) & (lead >= 0)
    same = F.slice("around", F.greatest(lead, F.lit(0)) + 1, length) == F.col("words")
    hits = materialize(met.where(inside & same).select("__row", begin.alias("begin"), length.alias("m"), "window_id").distinct(), "hits")
    # words that lie in any window: starts in order, each counts what the ones before it left
    spans = hits.groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("begin", "m"))).alias("spans"))
    covered = F.expr("""
        aggregate(spans, struct(0L AS n, 0 AS done),
            (a, x) -> struct(a.n + greatest(x.begin + x.m - greatest(x.begin, a.done), 0) AS n, greatest(a.done, x.begin + x.m) AS done), a -> a.n)
    """)
    spans = spans.select("__row", covered.alias("n_hit"))
    items = hits.select("__row", "window_id").distinct().join(sized(by_item.select("item_id", "window_id"), by_item.count(), 200), "window_id")
    items = items.groupBy("__row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    told = materialize(spans.join(items, "__row"), "told")
    out = rows.select("__row", "doc_id", "n_words").join(sized(told, told.count(), 200), "__row", "left")
    return out.select("__row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    rows = materialize(with_row_id(docs, "__row"), "rows")
    found = contamination(rows.select(F.col("__row").alias("doc_id"), "text"), benchmark)
    gone = materialize(found.where("n_hit > 0").select(F.col("doc_id").alias("__row")), "gone")
    return rows.join(sized(gone, gone.count(), 16), "__row", "left_anti").select(*columns(docs))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words, hit words and occurring items of each document, see :func:`contamination`."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
