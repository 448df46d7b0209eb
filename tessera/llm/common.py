"""Helpers shared by the corpus operators: durable intermediates, Arrow batches, bounded fits."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch on its way to Python, but for a single longer row.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a temporary one if all run on this machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more, and let Spark drop the shuffle files of the steps before: it does when the driver's garbage is collected."""
    spark = None
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path:
            spark = df.sparkSession
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    if spark:
        trim()
        spark._jvm.System.gc()


def trim() -> None:
    """Give this process's freed memory back to the system, that of unreachable cycles too."""
    gc.collect()
    give_back()


def give_back() -> None:
    """Give this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_HELD: dict[str, dict] = {}


def held_by(owner: str) -> dict:
    """What the operator ``owner`` keeps in this Python worker between tasks. The workers of one step serve the next, so what another operator kept is dropped, and freed memory given back."""
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = {}
        gc.collect()
    give_back()
    return _HELD[owner]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a map, after which a worker calls ``forget`` and gives freed memory back. A step that chains maps starts several workers for each core, later steps take all of them in turn, and what idle ones hold stands beside the busy ones' memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            give_back()

    return tidied


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Fewer rows and bytes in an Arrow batch while a step runs: long texts would else stand in memory several times over."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session now sends Python ``BATCH_BYTES`` at a time at most: for maps that run after the operator has returned."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark = df.sparkSession
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)
    return df


def slices(batch: pa.RecordBatch, rows: int = 256):
    """Small pieces of an Arrow batch, so that long texts bound the memory of what is derived from them."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the column's text modulo ``modulus``: the fold a row belongs to."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with underscores where the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def batches_of(batches: Iterator[pa.RecordBatch], columns: list[str], most: int = 4 << 20):
    """(columns as lists, bytes of the texts, starts) in pieces of about ``most`` bytes."""
    held: list[list] = [[] for _ in columns]
    raw: list[bytes] = []
    size = 0

    def out():
        data = np.frombuffer(b"".join(raw), np.uint8)
        return [*held], data, np.cumsum([0] + [len(r) for r in raw])

    for batch in batches:
        for values in zip(*[batch.column(c).to_pylist() for c in columns], texts_of(batch, "text"), strict=True):
            for h, v in zip(held, values, strict=False):
                h.append(v)
            raw.append(values[-1].encode())
            size += len(raw[-1])
            if size >= most:
                yield out()
                held, raw, size = [[] for _ in columns], [], 0
    if raw:
        yield out()


#: Powers of two of the bits of a map that ``id_marks`` makes: 2 MB at least, 32 MB at most.
MARK_BITS, MOST_MARK_BITS = 24, 28


def id_marks(ids: DataFrame) -> np.ndarray:
    """A bit map in which the ids of ``ids`` (column ``id``) are marked by hash: a superset of them, for filters ahead of a join.

    It has 16 bits for an id, between ``MARK_BITS`` and ``MOST_MARK_BITS``. Beyond the most it stays
    right but tells fewer of the other ids apart, so more rows take the way of the join.
    """
    n = ids.agg(F.approx_count_distinct("id")).first()[0]
    bits = min(MOST_MARK_BITS, max(MARK_BITS, (16 * n).bit_length()))
    h = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = ids.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    marks = np.zeros(1 << bits - 6, np.uint64)
    marks[words["w"].to_numpy().astype(np.int64)] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return marks


def marked(df: DataFrame, id_col: str, marks: np.ndarray, wanted: bool) -> DataFrame:
    """The rows whose id is marked, or those whose id is not; null ids are not."""
    sent = df.sparkSession.sparkContext.broadcast(marks)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(len(columns))
            known = np.asarray(h.is_valid())
            at = h.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = ((sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1) & known
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(columns))], names=columns).filter(pa.array(hit == wanted))

    hashed = F.when(F.col(f"`{id_col}`").isNotNull(), F.pmod(F.xxhash64(f"`{id_col}`"), F.lit(64 * len(marks))))
    return df.withColumn(free_name(df, "__mark"), hashed).mapInArrow(run, df.schema)
