"""SimHash near-duplicates with Burkhard-Keller trees.

1. Each text gets a 64-bit fingerprint, in one pass and without a shuffle.
2. Equal fingerprints collapse to one row.
3. Two fingerprints at most 3 bits apart agree in one of four blocks of 16 bits,
   so each fingerprint goes to four shards, one for each block and its value.
   Shards of more than ``SHARD`` members are dealt again by the four blocks of 12
   bits among their other 48 bits, for the same reason. Shards that are still
   larger are cut into trees of at most ``SHARD`` members; each tree then
   goes, with each later part of its shard, to a task of its own. Nothing is capped.
4. A shard's members form a BK-tree: children are keyed by their integer distance
   to the parent, and a query follows only the edges within the radius. The trees of
   many shards are built and searched together, level by level, with array
   operations. A shard gives a spanning forest of its links: at most one edge for each member.
5. Components of the forests' union come from star rounds, then reach the documents by two joins.

Where rows are dropped, fingerprints are one of two sources of candidates: at a Jaccard
similarity of 0.8 they seldom come within 3 bits. The other is MinHash bands, which miss
such a pair with a chance of 7e-5. Each bucket (a band's key, or a component of
fingerprints) compares all its members' shingle sets exactly, and only pairs that hold link.

Nothing about documents is gathered on the driver; what is broadcast is the list
of large blocks, at most 262,144 rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, fields, hold, map_batches, materialize, sized, table, with_row_id
from .components import connected_components

SEED = 42
RADIUS = 3
WIDTH = 3
#: Words of a shingle, and fingerprints, where rows are dropped.
STAGE_WIDTH, STAGE_FINGERPRINTS = 5, 8
#: Jaccard similarity of shingle sets, as a fraction, from which the stage drops a row.
SIMILAR = (4, 5)
#: MinHash bands and values in each: a pair at 0.8 shares no band with a chance of (1 - 0.8^5)^24 = 7e-5.
BANDS, BAND_ROWS = 24, 5
MIX = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype="u8") << np.uint64(1) | np.uint64(1)
#: Members of a shard beyond which it is dealt again, and of a tree.
SHARD = 2048
#: Members of a bucket, and bytes of their shingle sets, beyond which it is cut into parts that meet two at a time.
BUCKET, BUCKET_BYTES = 1024, 32 << 20
#: Rows that are searched together, and queries that walk the trees together.
BLOCK, QUERIES = 1 << 16, 1 << 12


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The 64-bit hashes of a text's lower-cased (A-Z) word shingles, repeats included."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, "<u8")
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype="<u8")


def _remix(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    return hashes ^ hashes >> np.uint64(27)


def prints_of(hashes: np.ndarray, count: int = 1) -> list[int]:
    """Unsigned fingerprints of shingle hashes; 0 without any.

    The first is made of the hashes; each further one of the hashes mixed anew, so it errs on its own.
    """
    if not len(hashes):
        return [0] * count
    out = []
    for k in range(count):
        if k:
            hashes = _remix(hashes)
        ones = np.zeros(64, "i8")
        for i in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[i : i + (1 << 14)].view("u1").reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype="i4")
        out.append(int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]))
    return out


def fingerprints(text: bytes | None, width: int = WIDTH, count: int = 1) -> list[int]:
    """Unsigned fingerprints of a text's shingles; 0 without words."""
    return prints_of(shingle_hashes(text, width), count)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each of ``BANDS`` bands of ``BAND_ROWS`` MinHash values of a set of shingle hashes. Equal keys make candidates."""
    least = np.full(len(MIX), ~np.uint64(0))
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 256):
            h = shingles[i : i + 256] * MIX[:, None]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9E3779B97F4A7C15)
            np.minimum(least, h.min(axis=1), out=least)
        key = np.arange(BANDS, dtype="u8")
        for row in least.reshape(BANDS, BAND_ROWS).T:
            key = _remix(key * np.uint64(0xD6E8FEB86659FD93) + row)
    return key


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    return fingerprints(text, width)[0]


def with_fingerprints(docs: DataFrame, width: int = WIDTH, count: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., fps): the signed 64-bit fingerprints of each row's text. A null text has no words."""
    rows = docs.select(*keep, F.col("text").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for b in batches:
            fps = np.array([fingerprints(t, width, count) for t in b.column(b.num_columns - 1).to_pylist()], dtype="u8").reshape(-1, count).view("i8")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(fps), pa.list_(pa.int64()))], [*b.schema.names[:-1], "fps"])

    return map_batches(rows, run, fields(rows, "fps array<long>", ("__text",)))


# --- BK-trees ------------------------------------------------------------------------------------


class Forest:
    """The BK-trees of several shards. ``fp``: members; ``shard``: the tree of each, as numbers from 0."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        self.fp = fp
        n = len(fp)
        _, first, tree = np.unique(shard, return_index=True, return_inverse=True)
        self.roots = first  # by tree number
        self.tree = tree.reshape(-1)
        at = np.full(n, -1)  # the node that each waiting member has come down to
        waiting = np.ones(n, bool)
        waiting[first] = False
        rest = np.flatnonzero(waiting)
        at[rest] = first[self.tree[rest]]
        parents, kids, edges = [], [], []
        while len(rest):
            d = np.bitwise_count(fp[rest] ^ fp[at[rest]]).astype("i8")
            key = at[rest] * 65 + d
            keys, chosen, group = np.unique(key, return_index=True, return_inverse=True)
            parents.append(keys // 65)
            edges.append(keys % 65)
            kids.append(rest[chosen])
            stays = np.ones(len(rest), bool)
            stays[chosen] = False
            at[rest] = rest[chosen][group.reshape(-1)]
            rest = rest[stays]
        if parents:
            parents, kids, edges = map(np.concatenate, (parents, kids, edges))
            order = np.lexsort((edges, parents))
            self.key = parents[order] * 65 + edges[order]  # sorted: children of a node by distance
            self.kid = kids[order]
        else:
            self.key = self.kid = np.zeros(0, "i8")

    def search(self, fp: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index of query, member) within ``radius``, level by level."""
        q, node = np.arange(len(fp)), self.roots[tree]
        while len(q):
            d = np.bitwise_count(fp[q] ^ self.fp[node]).astype("i8")
            near = d <= radius
            yield q[near], node[near]
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
            count = hi - lo
            q = np.repeat(q, count)
            node = self.kid[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]


class Union:
    """Disjoint sets of 0 to n - 1; the least member of a set is its root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            apart = lo != hi
            if not apart.any():
                return
            a, b, lo, hi = a[apart], b[apart], lo[apart], hi[apart]
            np.minimum.at(root, hi, lo)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def spanning_edges(shard: np.ndarray, side: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in each shard, as two arrays of nodes.

    ``side`` 0: the member is in the shard's tree and asks it too; 1: it is in the
    tree; 2: it only asks. A shard has members of side 0 only, or of sides 1 and 2.
    """
    member = side < 2
    names, number = np.unique(shard, return_inverse=True)
    has_tree = np.zeros(len(names), bool)
    has_tree[number[member]] = True
    index = np.flatnonzero(member)
    forest = Forest(fp[index], number[index])
    tree_of = np.cumsum(has_tree) - 1
    sets = Union(len(fp))
    asks = np.flatnonzero((side != 1) & has_tree[number])
    for i in range(0, len(asks), QUERIES):
        part = asks[i : i + QUERIES]
        for q, met in forest.search(fp[part], tree_of[number[part]], radius):
            sets.add(part[q], index[met])
    other = np.flatnonzero(sets.root != np.arange(len(fp)))
    return node[sets.root[other]], node[other]


# --- shards --------------------------------------------------------------------------------------


def _block(fp: str, i: str) -> F.Column:
    return F.expr(f"cast(shiftrightunsigned({fp}, cast(16 * {i} as int)) & 65535 as int)")


def shards_of(prints: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, side, fp, node): each fingerprint with the shards it belongs to. ``prints``: k, fp, node, a written table with each (k, fp) once."""
    first = prints.select("k", "fp", "node", F.explode(F.expr("array(0, 1, 2, 3)")).alias("i"))
    first = first.withColumn("v", _block("fp", "i"))
    large = materialize(first.groupBy("k", "i", "v").count().where(F.col("count") > shard).select("k", "i", "v", F.lit(True).alias("large")), "large-blocks")
    first = first.join(F.broadcast(large), ["k", "i", "v"], "left")  # 4 * 65,536 rows at most for each k
    small = first.where("large is null").select(F.xxhash64(F.lit(1), "k", "i", "v").alias("shard"), F.lit(0).alias("side"), "fp", "node")
    # the other 48 bits, as four blocks of 12
    rest = F.expr("(shiftrightunsigned(fp, cast(16 * i + 16 as int)) * if(i = 3, 0L, 1L)) << cast(16 * i as int) | fp & ((1L << cast(16 * i as int)) - 1)")
    again = first.where("large").withColumn("rest", rest).withColumn("j", F.explode(F.expr("array(0, 1, 2, 3)")))
    again = again.select(F.xxhash64(F.lit(2), "k", "i", "v", "j", F.expr("shiftrightunsigned(rest, cast(12 * j as int)) & 4095")).alias("shard"), "fp", "node")
    again = materialize(again, "second-blocks")
    counts = again.groupBy("shard").count().where(F.col("count") > shard).select("shard", F.ceil(F.col("count") / shard).cast("int").alias("parts"))
    counts = materialize(counts, "large-shards")
    again = again.join(sized(counts, counts.count(), 12), "shard", "left")
    second = again.where("parts is null").select("shard", F.lit(0).alias("side"), "fp", "node")
    # cut: part p's tree meets the later parts, one at a time; side 0 where p meets itself
    cut = again.where("parts is not null").withColumn("p", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
    cut = cut.withColumn("o", F.explode(F.expr("sequence(0, parts - 1)")))
    cut = cut.select(
        F.xxhash64(F.lit(3), "shard", F.least("p", "o"), F.greatest("p", "o")).alias("shard"),
        F.when(F.col("p") == F.col("o"), 0).when(F.col("p") < F.col("o"), 1).otherwise(2).alias("side"),
        "fp",
        "node",
    )
    return small.unionByName(second).unionByName(cut)


def link_forest(prints: DataFrame, shard: int = SHARD, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges between nodes, whose components are those of all links within ``radius`` (3 at most).

    ``prints`` has (k, fp, node): the k-th fingerprint, and the node that stands for it.
    """
    if radius > 3:
        raise ValueError("four blocks find links of 3 bits at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            if not held:
                return
            all_ = np.concatenate(held)
            end = len(all_) if last else int(np.searchsorted(all_[:, 0], all_[-1, 0], "left"))
            if end:
                part = all_[:end]
                a, b = spanning_edges(part[:, 0], part[:, 1], part[:, 2].copy().view("u8"), part[:, 3], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held, rows = [all_[end:]], len(all_) - end

        for b in batches:
            held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False).astype("i8") for i in range(4)], axis=1))
            rows += b.num_rows
            if rows >= BLOCK:
                yield from flush(False)
        yield from flush(True)

    dealt = shards_of(prints, shard)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(dealt.repartition(n, "shard").sortWithinPartitions("shard"), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint, component_id.

    Texts whose fingerprints differ in at most 3 bits are linked, and
    component_id is the smallest doc_id in reach. A null or empty text has
    fingerprint zero and is linked as any other. A null doc_id is passed over in the
    choice of the smallest; a component of null ids has a null component_id.
    Repeated rows each give a row; an empty table gives none. Other columns are ignored.
    """
    rows = with_fingerprints(docs.select("doc_id", "text")).select("doc_id", F.col("fps")[0].alias("fp"))
    rows = materialize(rows, "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    labels = connected_components(link_forest(prints.select(F.lit(0).alias("k"), "fp", F.col("fp").alias("node"))))
    classes = prints.join(labels, prints["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"))
    classes = materialize(classes, "classes")
    named = classes.join(prints, "fp")
    least = materialize(named.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    members = materialize(classes.join(least, "label").select("fp", "component_id"), "members")
    hex_ = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(members, "fp").select("doc_id", hex_, "component_id")


# --- exact similarity ----------------------------------------------------------------------------


def with_signatures(docs: DataFrame, width: int, count: int) -> DataFrame:
    """(doc_id, __row, n, digest, fps, bands) of each row: size and 128-bit digest of its shingle set, fingerprints, MinHash keys."""
    rows = docs.select("doc_id", "__row", F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hold()
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                hashes = shingle_hashes(t, width)
                shingles = np.unique(hashes)
                prints = np.array(prints_of(hashes, count), "u8").view("i8")
                out.append((len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), prints, band_keys(shingles).view("i8")))
            n, digest, fps, bands = zip(*out) if out else [()] * 4
            columns = pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(fps, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *columns], ["doc_id", "__row", "n", "digest", "fps", "bands"])

    return map_batches(rows, run, fields(rows, "n long, digest binary, fps array<long>, bands array<long>", ("text",)))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the sorted distinct shingle hashes of each row (__row, text), as little-endian 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 500):
                sets = [np.unique(shingle_hashes(t, width)).tobytes() for t in texts[i : i + 500]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 500), pa.array(sets, pa.binary())], ["node", "shingles"])

    return map_batches(docs.select("__row", F.col("text").cast("binary")), run, "node long, shingles binary")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of several sets share."""
    m = len(sets)
    out = np.zeros((m, m), "f8")
    if m == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    shared = count > 1
    pick = shared[column]
    owner, column = owner[pick], (np.cumsum(shared) - 1)[column[pick]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(shared.sum()), 2048):
        i, j = np.searchsorted(column, [lo, lo + 2048])
        has = np.zeros((m, 2048), "f4")
        has[owner[i:j], column[i:j] - lo] = 1
        out += has @ has.T
    np.fill_diagonal(out, 0)
    return out


def similar_edges(side: np.ndarray, node: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a bucket's pairs that are ``SIMILAR`` (exact counts of shingles). Members of sides 1 and 2 meet only each other."""
    if len(node) < 2:
        return node[:0], node[:0]
    both, size = common(sets), np.array([len(x) for x in sets])
    links = SIMILAR[1] * both >= SIMILAR[0] * (size[:, None] + size - both)
    links &= (side[:, None] != side) | (side == 0)
    united = Union(len(node))
    united.add(*np.nonzero(np.triu(links, 1)))
    other = np.flatnonzero(united.root != np.arange(len(node)))
    return node[united.root[other]], node[other]


def verified_edges(buckets: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(a, b): edges whose components are those of all similar pairs that share a bucket.

    ``buckets``: key, node, n (size of the shingle set); ``rows``: __row, text of the nodes. Every pair of a bucket is
    compared; a large bucket is cut, and each part meets each other part in a task of its own. Buckets with the same members count once.
    """
    size = F.greatest(F.ceil(F.col("count") / BUCKET), F.ceil(F.col("n") * 8 / BUCKET_BYTES)).cast("int")
    # near copies share most of their bands: of buckets with the same members (by count and 128 bits of their hashes) one is enough
    same = F.expr("bit_xor(xxhash64(node, 1))").alias("x"), F.expr("bit_xor(xxhash64(node, 2))").alias("y")
    counts = buckets.groupBy("key").agg(F.count("*").alias("count"), F.sum("n").alias("n"), *same).where("count > 1")
    parts = materialize(counts.groupBy("count", "n", "x", "y").agg(F.min("key").alias("key")).select("key", size.alias("parts")), "buckets")
    members = buckets.join(parts, "key").withColumn("p", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    members = members.withColumn("o", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        F.xxhash64("key", F.least("p", "o"), F.greatest("p", "o")).alias("shard"),
        F.when(F.col("p") == F.col("o"), 0).when(F.col("p") < F.col("o"), 1).otherwise(2).alias("side"),
        "node",
    )
    members = materialize(members, "members")
    need = materialize(members.select(F.col("node").alias("__row")).distinct(), "need")
    sets = shingle_sets(rows.join(sized(need, need.count(), 16), "__row", "left_semi"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            _, side, node, sets = zip(*held)
            a, b = similar_edges(np.array(side), np.array(node, "i8"), [np.frombuffer(x, "<u8") for x in sets])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[-1][0] != row[0]:
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.join(sets, "node").select("shard", "side", "node", "shingles").repartition(n, "shard").sortWithinPartitions("shard")
    return map_batches(dealt, run, "a long, b long").distinct()


def drop_near_duplicates(docs: DataFrame, width: int = STAGE_WIDTH, count: int = STAGE_FINGERPRINTS) -> DataFrame:
    """The rows of ``docs`` without all but one of each component of near-duplicates.

    Texts are linked if the Jaccard similarity of their sets of shingles is 0.8 or more, counted exactly.
    Pairs are compared if they share a MinHash band, or are in reach by fingerprints at most 3 bits apart (any of ``count``).
    The row with the smallest doc_id stays (a null id counts as the largest;
    of repeated ids, any one row). Rows whose text is null or has no words have no
    content to compare and all stay. An empty table gives no rows; all columns stay.
    """
    rows = materialize(with_row_id(docs, "__row"), "rows")
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    prints = materialize(with_signatures(rows.where(has_words), width, count), "signatures")
    # equal sets collapse to one node
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row", "n", "fps", "bands")).alias("first")
    distinct = prints.groupBy("digest").agg(first).select("digest", F.struct("first.no_id", "first.doc_id", "first.__row").alias("first"), F.col("first.__row").alias("node"), "first.n", "first.fps", "first.bands")
    distinct = materialize(distinct, "prints")
    each = distinct.select("node", F.posexplode("fps").alias("k", "fp"))
    # the node that stands for a fingerprint, and an edge to it from each other node that has it
    stands = materialize(each.groupBy("k", "fp").agg(F.min("node").alias("node")), "stands")
    same = each.join(stands.withColumnRenamed("node", "stand"), ["k", "fp"]).where("node != stand").select(F.col("stand").alias("a"), F.col("node").alias("b"))
    near = connected_components(link_forest(stands).unionByName(same))
    buckets = distinct.select(F.explode("bands").alias("key"), "node", "n").unionByName(near.join(distinct, "node").select(F.xxhash64(F.lit(8), "label").alias("key"), "node", "n"))
    labels = connected_components(verified_edges(buckets, rows, width))
    classes = distinct.join(labels, "node", "left").select("digest", "first", F.coalesce("label", "node").alias("label"))
    classes = materialize(classes, "classes")
    best = materialize(classes.groupBy("label").agg(F.min("first").alias("keep")), "keep")
    keep = materialize(classes.join(best, "label").select("digest", F.col("keep.__row").alias("keep")), "keepers")
    gone = materialize(prints.join(keep, "digest").where("__row != keep").select("__row"), "gone")
    return rows.join(sized(gone, gone.count(), 16), "__row", "left_anti").select(*columns(docs))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of each document, see :func:`near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
