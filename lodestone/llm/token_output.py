"""Token-ID / binary output.

Documents are encoded with a public tokenizer and written as shards in
ascending ``doc_id`` order. A shard is a pair of files:

``shard-NNNNN.bin``
    one zstandard frame for each document, back to back. A frame holds the
    document's ids as little-endian unsigned 32-bit integers, the end id
    included, and is compressed on its own with the set's shared dictionary, so
    that a short document can be read without its neighbours.
``shard-NNNNN.idx``
    a 64-byte header (magic ``LTOK0001``, SHA-256 of the dictionary, number of
    documents, number of ids, 8 spare bytes), then for each document three
    little-endian 64-bit integers: doc_id (-2**63 for null), the offset just
    after its frame in the ``.bin`` file, and its number of ids.

``dictionary.zdict`` holds the dictionary; each reader checks its hash.

Shards are cut by ranges of ``doc_id`` and, among equal ids, of the text's beginning. A task
writes under a temporary name and renames the file when it is complete, and its
bytes depend on its rows alone: tasks that run again leave the same files.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, map_batches, shared_dir, table

MAGIC = b"LTOK0001"
HEADER = "<8s32sQQ8s"
NULL_ID = -(1 << 63)
END_ID = 2
#: Documents (at most) whose first ids train the dictionary, ids of each, and its size.
DICT_DOCS, DICT_IDS, DICT_BYTES = 1000, 2000, 64 << 10
#: Rows of input for each shard.
SHARD_ROWS = 20_000
#: Characters of a text by which rows with equal ids are dealt to shards; their order is that of whole texts.
KEY_CHARS = 64
#: Words and other chunks in a generation of what a worker remembers, and the longest that it remembers. Only speed depends on it.
CACHE_WORDS, CACHE_LONGEST = 300_000, 64
#: Bytes of texts that are looked up at once; a longer text is looked up on its own.
AT_ONCE = 4 << 20

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTERS = "".join(c for c in map(chr, range(256)) if re.fullmatch(f"[{_LATIN}]", c))
_MARKS = ".,!?;:|%&*#$"
_WORD = re.compile(f"[{_LATIN}]+")
_SPACE = re.compile(r"[ \t\n\v\f\r]+")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes whole texts with a tokenizer whose tokens never reach across ASCII white space.

    Such a tokenizer gives a text's ids as the concatenation of those of the
    chunks between white space. Of a batch of texts each different chunk is looked up once,
    one of Latin letters and trailing marks as its lower-case word and its
    marks, which the tokenizer separates and folds anyway. New words go straight
    to the tokenizer's model where a probe shows that this gives the same ids.

    Whether a tokenizer is of this kind is probed with texts of both cases, marks, and several
    white spaces; one that isn't gets each text whole.

    What is remembered has two generations: when the young one is full it
    becomes the old one, and what is met again moves back.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.spelled = str.maketrans({chr(c): "".join(as_char[b] for b in chr(c).encode()) for c in range(256)})
        tries = ("The Quick  brown\nFOX, jumps\tOVER. the 12 lazy dogs!", " leading and trailing ", "ÀÉÎõü ÑANDÚ Straße (x)%% $$a b.c", "it's we'LL  \r\n\v\f end")
        self.whole = any(self._encode(t) != b"".join(map(self._encode, _SPACE.split(t))) or self._encode(t) != self._encode(t.lower()) for t in tries)
        probe = [chr(c) for c in range(256) if _WORD.fullmatch(chr(c))]
        probe = [w.lower() for w in [*probe, "".join(probe), "word", "dañoèüß", "thestionlybeing"]]
        self.direct = all([t.id for t in self.model.tokenize(w.translate(self.spelled))] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode_new(self, chunk: str) -> bytes:
        """The ids of a lower-case word, of marks, or of any other chunk."""
        if self.direct and len(chunk) < 100 and _WORD.fullmatch(chunk):
            spelled = chunk if chunk.isascii() else chunk.translate(self.spelled)  # ASCII letters are spelled as they are
            return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return self._encode(chunk)

    def _known(self, chunks: pa.Array) -> pa.Array:
        """The ids of each of ``chunks``; new ones are encoded, and remembered unless they are long."""
        coded = chunks.dictionary_encode()
        names, (young, old) = coded.dictionary.to_pylist(), self.chunks
        found = list(map(young.get, names))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            c = names[i]
            if (ids := old.get(c)) is None:
                ids = self._encode_new(c)
            if len(c) <= CACHE_LONGEST:
                young[c] = ids
            found[i] = ids
        if len(young) > CACHE_WORDS:
            self.chunks = {}, young
        return pa.array(found, pa.large_binary()).take(coded.indices)

    def _looked_up(self, texts: pa.Array) -> Iterator[bytes]:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        marks, stems = pc.utf8_ltrim(chunks, characters=_LETTERS), pc.utf8_rtrim(chunks, characters=_MARKS)
        plain = pc.equal(pc.add(pc.binary_length(marks), pc.binary_length(stems)), pc.binary_length(chunks))  # letters, then marks
        heads, tails = pc.if_else(plain, pc.utf8_lower(stems), chunks), pc.if_else(plain, marks, "")
        ids = pc.binary_join_element_wise(self._known(heads), self._known(tails), pa.scalar(b"", pa.large_binary())).take(coded.indices)
        _, ends, data = ids.buffers()
        cuts = np.frombuffer(ends, "<i8")[ids.offset :][lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        for begin, stop in zip(cuts, cuts[1:]):
            yield data[begin:stop].to_pybytes() if stop > begin else b""

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null has none."""
        texts = texts.fill_null("")
        if self.whole:
            yield from (self._encode(t.as_py()) for t in texts)
            return
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(), dtype="i8"), 0
        while at < len(texts):
            size = AT_ONCE + (ends[at - 1] if at else 0)
            stop = max(at + 1, int(np.searchsorted(ends, size, "right")))
            yield from self._looked_up(texts.slice(at, stop - at))
            at = stop

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        return next(self.encode_all(pa.array([text], pa.string())))


def encoder(path: str) -> WordEncoder:
    hold(_encoders)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "file://" + re.sub(r"^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _put(uri: str, data: bytes) -> None:
    fs, path = _fs(uri)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(draft) as out:
        out.write(data)
    fs.move(draft, path)


def _get(uri: str) -> bytes:
    fs, path = _fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def _spread(ids: bytes, most: int = DICT_IDS, ranges: int = 4) -> bytes:
    """At most ``most`` ids, as ranges spread over all of ``ids``."""
    n, size = len(ids) // 4, most // ranges
    if n <= most:
        return ids
    return b"".join(ids[4 * at : 4 * (at + size)] for at in ((n - size) * i // (ranges - 1) for i in range(ranges)))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample of documents.

    The sample has about ``DICT_DOCS`` documents, chosen by a hash of doc_id;
    at most ``DICT_IDS`` ids of each are used, in four ranges from its beginning to its end. With too little text the dictionary is empty.
    """
    import zstandard

    n = max(1, docs.count())
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(min(1 << 20, -(-(DICT_DOCS << 20) // n))))
    end = np.array([end_id], "<u4").tobytes()
    # of a long text, four pieces of its whole length come to the driver
    size, length = 4 * DICT_IDS, F.length("text")
    pieces = [F.substring("text", F.floor((length - size) * i / 3).cast("int") + 1, F.lit(size)) for i in range(4)]
    some = chosen.orderBy(F.xxhash64("doc_id", F.lit(9)), F.xxhash64("text")).limit(2 * DICT_DOCS)
    rows = some.select(F.when(length > 4 * size, F.array(*pieces)).otherwise(F.array("text"))).collect()
    encode = encoder(tokenizer).encode_all
    samples = [_spread(b"".join(encode(pa.array(r[0], pa.string())))) + end for r in rows]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID, shard_rows: int = SHARD_ROWS) -> list[dict]:
    """Writes ``docs`` (doc_id, text) to the shared folder ``out``; returns the manifest, a row for each shard in order.

    A null text counts as empty and gives the end id alone. Rows with a null
    doc_id come first; rows that share a doc_id are ordered by their text, and
    needn't share a shard unless their texts begin alike. An empty table gives no shards. Other columns are ignored.
    """
    tokenizer = tokenizer or default_tokenizer()
    fs, path = _fs(out)
    fs.create_dir(path, recursive=True)
    docs = docs.select("doc_id", "text")
    zdict = train_dictionary(docs, tokenizer, end_id)
    _put(f"{out}/dictionary.zdict", zdict)
    shards = max(1, -(-docs.count() // shard_rows))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        kinds = {"dict_data": zstandard.ZstdCompressionDict(zdict)} if zdict else {}
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True, write_dict_id=False, **kinds).compress
        encode = encoder(tokenizer).encode_all
        shard = TaskContext.get().partitionId()
        name, at, ids, index, stream, draft = f"{out}/shard-{shard:05d}", 0, 0, [], None, ""
        fs, path = _fs(name)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                if stream is None:
                    draft = f"{path}.bin.{uuid.uuid4().hex}.tmp"
                    stream = fs.open_output_stream(draft)
                raw += end
                frame = squeeze(raw)
                stream.write(frame)
                at += len(frame)
                ids += len(raw) // 4
                index.append((NULL_ID if doc_id is None else doc_id, at, len(raw) // 4))
        if stream is None:
            return
        stream.close()
        fs.move(draft, f"{path}.bin")
        head = struct.pack(HEADER, MAGIC, hashlib.sha256(zdict).digest(), len(index), ids, bytes(8))
        _put(f"{name}.idx", head + np.array(index, dtype="<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(index)], pa.int64()), pa.array([ids], pa.int64()), pa.array([at], pa.int64())], ["shard", "n_docs", "n_tokens", "n_bytes"])

    dealt = docs.repartitionByRange(shards, F.col("doc_id"), F.substring("text", 1, KEY_CHARS)).sortWithinPartitions("doc_id", "text")
    done = map_batches(dealt, write, "shard long, n_docs long, n_tokens long, n_bytes long").collect()
    start, manifest = 0, []
    for r in sorted(done, key=lambda r: r["shard"]):
        manifest.append(r.asDict() | {"start": start})
        start += r["n_tokens"]
    return manifest


def read_document(out: str, shard: int, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th document of a shard, read by the offset index: its doc_id and ids."""
    import zstandard

    zdict, (index, _) = _get(f"{out}/dictionary.zdict"), _index(f"{out}/shard-{shard:05d}.idx", None)
    fs, path = _fs(f"{out}/shard-{shard:05d}.bin")
    begin, stop = (int(index[k - 1][1]) if k else 0), int(index[k][1])
    with fs.open_input_file(path) as f:
        f.seek(begin)
        frame = f.read(stop - begin)
    kinds = {"dict_data": zstandard.ZstdCompressionDict(zdict)} if zdict else {}
    ids = np.frombuffer(zstandard.ZstdDecompressor(**kinds).decompress(frame), "<u4")
    return (None if index[k][0] == NULL_ID else int(index[k][0])), ids


def _index(uri: str, dict_hash: bytes | None) -> tuple[np.ndarray, int]:
    raw = _get(uri)
    magic, sha, n, ids, _ = struct.unpack_from(HEADER, raw)
    if magic != MAGIC or dict_hash is not None and sha != dict_hash:
        raise ValueError(f"{uri}: not an index of this set, or made with another dictionary")
    return np.frombuffer(raw, "<i8", count=3 * n, offset=struct.calcsize(HEADER)).reshape(n, 3), ids


def read_tokens(spark, out: str, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zdict = _get(f"{out}/dictionary.zdict")
        kinds = {"dict_data": zstandard.ZstdCompressionDict(zdict)} if zdict else {}
        unpack, sha = zstandard.ZstdDecompressor(**kinds).decompress, hashlib.sha256(zdict).digest()
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index, _ = _index(f"{out}/shard-{shard:05d}.idx", sha)
                fs, path = _fs(f"{out}/shard-{shard:05d}.bin")
                with fs.open_input_stream(path) as f:
                    at = 0
                    for i in range(0, len(index), 1000):
                        part, crcs, ids = index[i : i + 1000], [], []
                        for _, stop, n in part.tolist():
                            raw = unpack(f.read(stop - at))
                            at = stop
                            if len(raw) != 4 * n:
                                raise ValueError(f"{path}: a frame doesn't hold the ids that the index says")
                            crcs.append(zlib.crc32(raw))
                            if with_ids:
                                ids.append(np.frombuffer(raw, "<u4").astype("i8"))
                        starts = start + np.concatenate([[0], np.cumsum(part[:, 2])[:-1]])
                        start += int(part[:, 2].sum())
                        cols = [pa.array([None if d == NULL_ID else d for d in part[:, 0].tolist()], pa.int64()), pa.array(starts, pa.int64()), pa.array(part[:, 2], pa.int64()), pa.array(crcs, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            cols.append(pa.array(ids, pa.list_(pa.int64())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(cols, names)

    shards = spark.createDataFrame([(m["shard"], m["start"]) for m in manifest], "shard long, start long")
    return map_batches(shards.repartition(len(manifest)), read, schema)


def tokenize_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files of ``docs`` to a new folder of the shared one and reads them back."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(spark, out, write_tokens(docs, out, tokenizer))


def op4_token_output(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files that it writes."""
    return tokenize_and_read(table(spark, sf_dir, "documents"))
