"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, and one on
the words that mark toxic text alone, in pairs as they follow each other (what stands
between them is left out, so phrases of ordinary words aren't in it). A window is compressed
with the ordinary dictionary alone and with the toxic one in front of it; the bytes saved
by the second are the window's distance towards toxic text. Since the second
dictionary holds the first, what both know cancels out.

Which strings mark toxic text comes from the labelled sample too: word beginnings of
``LEAST`` to ``MOST`` characters (and whole words) that ``PURE`` or more of the documents
that hold them share the toxic label. The windows of whole texts give a document's
largest, mean and scaled total saving and how many windows pass a calibrated
threshold; a logistic regression on documents that the dictionaries haven't seen turns
these into the score.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, fields, hold, id_crc, map_batches, sized, table

#: Labelled documents that the classifier is fitted on, about; all of them where there are fewer.
SAMPLE_DOCS = 9000
#: Share of the sample (by hash) that trains the dictionaries; the rest calibrates.
DICT_SHARE = 2 / 3
#: Characters of ordinary texts that train the ordinary dictionary, about; the texts are chosen by a hash, whatever their order.
ORDINARY_CHARS = 8_000_000
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 16384, 2048, 9
#: Bytes of a window, and from one to the next.
WINDOW, STRIDE = 96, 80
LEAST, MOST, PURE = 5, 12, 0.9
_WORD = re.compile(r"[^\W\d_]+")
_squeezers: dict[bytes, object] = {}


def windows(text: str) -> list[bytes]:
    """Windows over the whole lower-cased text, as UTF-8; the last may be shorter."""
    b = text.lower().encode("utf-8", "surrogatepass")
    return [b[i : i + WINDOW] for i in range(0, max(1, len(b) - (WINDOW - STRIDE)), STRIDE)]


def beginnings(word: str) -> list[str]:
    w = " " + word
    return [*(w[:k] for k in range(LEAST, min(len(w), MOST) + 1)), w + " "]


def _start() -> None:
    hold(_squeezers)


def _squeezer(content: bytes):
    import zstandard

    if content not in _squeezers:
        kinds = {}
        if content:
            kinds["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kinds["dict_data"].precompute_compress(level=LEVEL)
        _squeezers[content] = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **kinds).compress
    return _squeezers[content]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: float = 4.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, -3.0)
    center: tuple[float, ...] = (0.0,) * 4
    scale: tuple[float, ...] = (1.0,) * 4

    def savings(self, text: str) -> np.ndarray:
        plain, other = _squeezer(self.ordinary), _squeezer(self.toxic + self.ordinary)
        return np.array([len(plain(w)) - len(other(w)) for w in windows(text)], float)

    def features(self, text: str | None) -> np.ndarray:
        g = self.savings(text or "")
        root = np.sqrt(len(g))
        return np.array([g.max(), g.mean(), g.sum() / root, (g >= self.threshold).sum() / root])

    def score(self, text: str | None) -> float:
        x = (self.features(text) - np.array(self.center)) / np.array(self.scale)
        z = float(x @ np.array(self.weights[:4]) + self.weights[4])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(dict.fromkeys(samples))[:size]  # too little text to train on


class Chosen:
    """The texts with the least hashes that together have ``chars`` characters or more; all texts if they have fewer."""

    def __init__(self, chars: int):
        self.chars, self.size, self.heap = chars, 0, []
        self.end: tuple | None = None  # the least that went

    def add(self, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        key = (-zlib.crc32(data), zlib.adler32(data), text)  # the largest hash is on top of the heap
        if self.end is not None and key <= self.end:
            return
        heapq.heappush(self.heap, key)
        self.size += len(text)
        while self.size - len(self.heap[0][2]) >= self.chars:
            self.end = heapq.heappop(self.heap)
            self.size -= len(self.end[2])

    def texts(self) -> list[str]:
        return [key[2] for key in sorted(self.heap, reverse=True)]


def train(rows: Iterator[tuple[str, int, bool]], ordinary_chars: int = ORDINARY_CHARS) -> Model:
    """Fits on (text, label, for the dictionaries?). With one label only, or none, every score is the same.

    The ordinary dictionary is trained on ordinary texts of about ``ordinary_chars`` characters, chosen by a hash of the text.
    """
    toxic_docs, ordinary, rest, seen = [], Chosen(ordinary_chars), [], Counter()
    held_by: Counter[str] = Counter()
    for text, label, first in rows:
        if not first:
            rest.append((text, label))
            continue
        seen[label] += 1
        found = {g for w in set(_WORD.findall(text.lower())) for g in beginnings(w)}
        if label:
            toxic_docs.append((text, found))
        else:
            held_by.update(found)
            ordinary.add(text)
    if not seen[1] or not seen[0]:
        return Model(b"", b"")
    toxic_by = Counter(g for _, found in toxic_docs for g in found)
    least = max(3, round(0.01 * seen[1]))
    marks = {g for g, n in toxic_by.items() if n >= least and n >= PURE * (n + held_by[g])}
    del toxic_by, held_by
    marking = []
    for text, found in toxic_docs:
        if found & marks:
            marking += [f" {w} " for w in _WORD.findall(text.lower()) if not marks.isdisjoint(beginnings(w))]
    ordinary = [w for text in ordinary.texts() for w in windows(text)]
    model = Model(_dictionary(ORDINARY_BYTES, ordinary), _dictionary(TOXIC_BYTES, [(a + b).encode() for a, b in zip(marking, marking[1:] or marking)]))
    rest = rest or [(t, 1) for t, _ in toxic_docs]
    clean = [model.savings(t) for t, label in rest if not label]
    if clean:
        model.threshold = float(max(2.0, np.quantile(np.concatenate(clean), 0.999)))
    x = np.array([model.features(t) for t, _ in rest])
    y = np.array([label for _, label in rest], float)
    if not 0 < y.sum() < len(y):
        return model
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    model.center, model.scale = tuple(center), tuple(scale)
    model.weights = tuple(_logistic((x - center) / scale, y))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, ordinary_chars: int = ORDINARY_CHARS) -> Model:
    """Fits on a bounded sample of ``docs`` (doc_id, text) with a label in ``labels`` (doc_id, toxic), chosen by a hash of doc_id.

    Of its ordinary texts, about ``ordinary_chars`` characters train the ordinary dictionary, see :func:`train`.

    Null texts count as empty; null labels and ids are passed over; of several labels of an id the largest counts.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    n = max(1, labels.count())
    at = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    chosen = at < F.lit(min(1 << 30, -(-(sample_docs << 30) // n)))
    some = labels.where(chosen)
    rows = docs.where(chosen).join(sized(some, min(n, sample_docs), 16), "doc_id")
    first = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < F.lit(round(DICT_SHARE * (1 << 30)))
    rows = rows.select(F.coalesce("text", F.lit("")), F.col("__toxic").cast("int"), first)
    return train((tuple(r) for r in rows.toLocalIterator()), ordinary_chars)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier) in place of text; each whole text is read.

    Null and empty texts have one empty window. Ids may be null or repeat; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*columns(docs, "text", "score"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _start()
        model = known.value
        for b in batches:
            scores = [model.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score"])

    return map_batches(rows, run, fields(rows, "score double", ("text",)))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Each document's toxicity: doc_id, held_out, score, predicted. Labels are learned outside the held-out fold; null ids are never learned from."""
    held_out = F.coalesce(id_crc() % 5 == 0, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = score(docs.select("doc_id", F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
