"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Largest estimated size of a join side that is sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Rows that go to a Python worker at once, where the session leaves Spark's default of 10,000. Whole texts are in them, in the JVM and in the worker.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. A local folder is set only
    where the session names none, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


#: Folders that :func:`materialize` has written and nobody has removed.
_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and freezes
    generated row ids. The folder stays until :func:`clean` is told to remove it, since results read it as they run.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Folders that were materialized since the last call."""
    out = _written[:]
    _written.clear()
    return out


def clean(spark: SparkSession, folders: list[str]) -> None:
    """Removes folders of :func:`written`, once all results that read them have been written themselves."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if ``rows * row_bytes`` is within ``limit``; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def with_row_id(df: DataFrame, name: str = "__row") -> DataFrame:
    """Adds a unique number to each row. It holds only once ``df`` is materialized."""
    return df.withColumn(name, F.monotonically_increasing_id())


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; null if the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def unit_hash(*parts: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest, the same in any engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


_held: tuple[dict, ...] = ()


def hold(*caches: dict) -> None:
    """Says that a worker now fills ``caches``: what it remembered for another operator is let go, and its memory goes back to the system.

    Workers live on from stage to stage, and so would all that each operator remembers.
    """
    global _held
    if [id(c) for c in _held] != [id(c) for c in caches]:
        for c in _held:
            if not any(c is kept for kept in caches):
                c.clear()
        _held = caches
        give_back()


def give_back() -> None:
    """Returns freed memory to the system; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with bounded memory: batches of ``ARROW_ROWS`` rows, and freed memory given back as a task ends.

    Spark reads the size of batches from the session as a plan runs, so it is set there; a size other than Spark's default is left alone.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(ARROW_ROWS))

    names = df.columns  # Spark looks the columns up by name there, and can't find all names; so they go under numbers

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)
        give_back()

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(bounded, schema)


def columns(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df``, but for those ``without``; names may hold any character."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without]


def fields(df: DataFrame, added: str = "", without: tuple[str, ...] = ()) -> StructType:
    """The fields of ``df``, but for those ``without``, and those of a schema string; names may hold any character."""
    return StructType([f for f in df.schema.fields if f.name not in without] + (StructType.fromDDL(added).fields if added else []))
