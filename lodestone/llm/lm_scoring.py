"""Cross-entropy difference of two matched n-gram models.

Both models are interpolated bigram models over the ids of one public tokenizer, and
share its vocabulary, order, smoothing and tables. The target model is counted on documents
with a good label, the background model on all documents. Each id of a document
has a loss in either model, and the mean difference (target minus background) is
the document's score: lower is more like the target.

Counting covers whole texts of all documents, and each pair of neighbours has a count of
its own: the model grows with the pairs that the corpus holds. Each task sends, for each
of ``RANGES`` ranges of pairs by hash, the pairs it has met with both counts; a range's
blobs are merged into sorted arrays. The merged counts lie in the shared folder; none of it
passes the driver. A worker keeps a model of up to ``RESIDENT`` pairs. Of a larger one it
reads a range at a time and keeps what the documents at hand need, ``CHUNK`` ids at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, fields, hold, map_batches, materialize, shared_dir, sized, table
from .token_output import _fs, default_tokenizer, encoder

#: Ranges that pairs are dealt in, and ids of the vocabulary (rounded up; a pair of ids is a 32-bit number).
RANGES, IDS = 256, 1 << 16
#: Pairs of a model that a worker keeps (12 bytes each), and ids that are scored together with a larger, or such, a model.
RESIDENT, CHUNK, BATCH = 1 << 23, 1 << 22, 1 << 16
#: Weight of the bigram estimate, and of the uniform distribution.
BIGRAM, UNIFORM = 0.7, 0.01
_tables: dict[tuple, tuple] = {}


def pairs(ids: np.ndarray) -> np.ndarray:
    """The number of each pair of neighbours, its own for each pair."""
    return ids[:-1].astype("<u4") << np.uint32(16) | ids[1:].astype("<u4")


def ranges(keys: np.ndarray) -> np.ndarray:
    """The range of each pair."""
    return keys.astype("u8") * np.uint64(0x9E3779B1) % np.uint64(1 << 32) >> np.uint64(24)


def _counted(keys: list[np.ndarray], marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, m = np.concatenate(keys), np.concatenate(marks)
    order = np.argsort(k, kind="stable")
    k, m = k[order].astype("i8"), m[order]
    first = np.flatnonzero(np.diff(k, prepend=-1))
    return k[first], np.add.reduceat(m, first), np.diff(np.append(first, len(k)))


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs`` with ids (little-endian unsigned 32-bit integers) in place of text, written once for both passes."""
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(*columns(docs, "text", "ids"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_all
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(encode(part.column(b.num_columns - 1)), pa.binary())], [*part.schema.names[:-1], "ids"])

    return materialize(map_batches(rows, run, fields(rows, "ids binary", ("text",))), "ids")


def count_ngrams(rows: DataFrame) -> DataFrame:
    """(part, blob): the counts of each range, for the target and in all; part -1 - r holds unigrams. ``rows``: ids, is_target.

    Sums of several rows for a part are left to :func:`merge_counts`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hold()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        held: dict[str, tuple[list, list]] = {"uni": ([], []), "bi": ([], [])}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, (keys, marks) in held.items():
                if not keys:
                    continue
                k, t, b = _counted(keys, marks)
                parts = (ranges(k) if kind == "bi" else k // (IDS // 16)).astype("i8")
                order = np.argsort(parts, kind="stable")
                parts, k, t, b = (x[order] for x in (parts, k, t, b))
                starts = np.flatnonzero(np.diff(parts, prepend=-1))
                out = [[], []]
                for lo, hi in zip(starts, [*starts[1:], len(k)]):
                    part = int(parts[lo])
                    blob = np.concatenate([np.diff(k[lo:hi], prepend=0 if kind == "bi" else part * (IDS // 16)), t[lo:hi], b[lo:hi]]).astype("<u4")
                    out[0].append(part if kind == "bi" else -1 - part)
                    out[1].append(squeeze(blob.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["part", "blob"])
                keys.clear()
                marks.clear()

        for batch in batches:
            for raw, is_target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(raw, "<u4")
                if len(ids) and ids.max() >= IDS:
                    raise ValueError(f"the vocabulary has more than {IDS} ids")
                for kind, keys in (("uni", ids), ("bi", pairs(ids))):
                    held[kind][0].append(keys)
                    held[kind][1].append(np.full(len(keys), int(is_target), "i4"))
                size += len(ids)
                if size > 2_000_000:  # a bound of what a task holds, not of what it counts
                    yield from flush()
                    size = 0
        yield from flush()

    return map_batches(rows, run, "part int, blob binary")


def merge_counts(blobs: DataFrame) -> DataFrame:
    """One row for each part: (part, n, keys, target, background). Sums are little-endian 32-bit floats, of ``n`` sorted pairs or of each id (no keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[int, list[np.ndarray]] = {}

        def merged(arrays: list[np.ndarray]) -> np.ndarray:
            k, t, b = np.concatenate(arrays, axis=1)
            order = np.argsort(k, kind="stable")
            k = k[order]
            first = np.flatnonzero(np.diff(k, prepend=-1))
            return np.stack([k[first], np.add.reduceat(t[order], first), np.add.reduceat(b[order], first)])

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(unpack(blob), "<u4").reshape(3, -1).astype("i8")
                new[0] = np.cumsum(new[0])
                arrays = held.setdefault(part, [])
                arrays.append(new)
                if sum(x.shape[1] for x in arrays[1:]) > max(arrays[0].shape[1], 1 << 14):  # what is merged at least doubles
                    held[part] = [merged(arrays)]
        for part, arrays in held.items():
            k, t, b = merged(arrays)
            if part < 0:
                dense = np.zeros((2, IDS // 16), "i8")
                dense[:, k] = t, b
                k, (t, b) = k[:0], dense
            columns = pa.array([len(k)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (k.astype("<u4"), t.astype("<f4"), b.astype("<f4")))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *columns], ["part", "n", "keys", "target", "background"])

    n = int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(blobs.repartition(min(n, RANGES), "part"), run, "part int, n long, keys binary, target binary, background binary")


def fit(docs: DataFrame, targets: DataFrame) -> str:
    """Counts both models on all of ``docs`` (doc_id, ids) into a table in the shared folder; returns its place.

    ``targets`` (doc_id) names the documents of the target model. Null ids of documents are no targets.
    """
    spark = docs.sparkSession
    good = materialize(targets.where("doc_id is not null").select("doc_id").distinct().withColumn("__good", F.lit(True)), "targets")
    rows = docs.join(sized(good, good.count(), 16), "doc_id", "left").select("ids", F.coalesce("__good", F.lit(False)).alias("is_target"))
    place = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    merge_counts(count_ngrams(rows)).write.parquet(place)
    return place


def _parts(place: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, keys, counts of both models) of each part, one at a time."""
    import pyarrow.dataset as ds

    fs, path = _fs(place)
    for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches(columns=["part", "keys", "target", "background"], batch_size=1, batch_readahead=0, fragment_readahead=0):
        for p, k, *both in zip(*(c.to_pylist() for c in batch.columns)):
            yield p, np.frombuffer(k, "<u4"), np.stack([np.frombuffer(x, "<f4") for x in both])


def _model(place: str, resident: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """The unigram counts of both models, and the sorted pairs with their counts if there are at most ``resident``; read once by each worker."""
    hold(_tables)
    if (place, resident) not in _tables:
        import pyarrow.dataset as ds

        _tables.clear()
        fs, path = _fs(place)
        files = ds.dataset(path, filesystem=fs, format="parquet")
        whole = sum(files.to_table(columns=["n"])["n"].to_pylist() if files.files else []) <= resident
        uni, keys, counts = np.zeros((2, IDS), "f4"), [np.zeros(0, "<u4")], [np.zeros((2, 0), "<f4")]
        for p, k, c in _parts(place):
            if p < 0:
                n = c.shape[1]
                uni[:, (-1 - p) * n : -p * n] = c
            elif whole:
                keys.append(k)
                counts.append(c)
        if whole:
            keys = np.concatenate(keys)
            order = np.argsort(keys)
            _tables[place, resident] = uni, keys[order], np.concatenate(counts, axis=1)[:, order]
        else:
            _tables[place, resident] = uni, None, None
    return _tables[place, resident]


def _found(asked: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of the pairs asked for; 0 for a pair that the model doesn't have."""
    if not len(keys):
        return np.zeros((2, len(asked)), "f4")
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, counts[:, at], 0)


class Scorer:
    """Loss differences by id and pair."""

    def __init__(self, place: str, resident: int = RESIDENT):
        uni, self.keys, self.counts = _model(place, resident)
        self.place, self.at_once = place, CHUNK if self.keys is None else BATCH
        self.total = uni.sum(axis=1, dtype="f8")
        self.uni = (uni / np.maximum(self.total, 1)[:, None] * (1 - UNIFORM) + UNIFORM / IDS).astype("f4")
        self.count = uni

    def pair_counts(self, asked: np.ndarray) -> np.ndarray:
        """The counts of each pair in both models."""
        distinct, back = np.unique(asked, return_inverse=True)
        if self.keys is not None:
            return _found(distinct, self.keys, self.counts)[:, back.reshape(-1)]
        out = np.zeros((2, len(distinct)), "f4")
        dealt = ranges(distinct)
        order = np.argsort(dealt, kind="stable")
        bounds = np.searchsorted(dealt[order], np.arange(RANGES + 1))
        for p, keys, counts in _parts(self.place):
            if p >= 0:
                mine = order[bounds[p] : bounds[p + 1]]
                out[:, mine] = _found(distinct[mine], keys, counts)
        return out[:, back.reshape(-1)]

    def means(self, docs: list[np.ndarray]) -> list[tuple[int, float, float]]:
        """(ids, mean loss in the target, and in the background model, in nats) of each document; 0 without ids."""
        out: list[tuple[int, float, float]] = []
        i = 0
        while i < len(docs):
            j, size = i, 0
            while j < len(docs) and (j == i or size + len(docs[j]) <= self.at_once):
                size += len(docs[j])
                j += 1
            part, i = docs[i:j], j
            counts, at = self.pair_counts(np.concatenate([pairs(x) for x in part])), 0
            for ids in part:
                n = max(len(ids) - 1, 0)
                losses = self.losses(ids, counts[:, at : at + n])
                out.append((len(ids), *(float(x) for x in losses.mean(axis=1))) if len(ids) else (0, 0.0, 0.0))
                at += n
        return out

    def losses(self, ids: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The losses of each id in the target and in the background model, in nats."""
        p = self.uni[:, ids].astype("f8")
        if len(ids) > 1:
            before = self.count[:, ids[:-1]]
            seen = before > 0
            estimate = np.minimum(pair / np.maximum(before, 1), 1.0)
            p[:, 1:] = np.where(seen, BIGRAM * estimate + (1 - BIGRAM) * p[:, 1:], p[:, 1:])
        return -np.log(p)


def score(docs: DataFrame, place: str, resident: int = RESIDENT) -> DataFrame:
    """``docs`` without ids, with n_tokens, target_loss, background_loss (means) and score (their difference).

    A document without ids (a null or empty text) has losses and score 0. A null or repeated doc_id is fine; an empty table gives no rows.
    """
    new = ("n_tokens", "target_loss", "background_loss", "score")
    rows = docs.select(*columns(docs, "ids", *new), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(place, resident)
        for b in batches:
            out = [(n, t, g, t - g) for n, t, g in scorer.means([np.frombuffer(raw, "<u4").astype("i8") for raw in b.column(b.num_columns - 1).to_pylist()])]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:])], [*b.schema.names[:-1], *new])

    return map_batches(rows, run, fields(rows, "n_tokens long, target_loss double, background_loss double, score double", ("ids",)))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality. Background: all documents."""
    docs = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    place = fit(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return score(docs, place)
