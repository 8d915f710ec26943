"""What the corpus operators share: tables, scratch tables, batch bounds and per-process caches."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and bytes of one Arrow batch at most. Documents are long, so Spark's 10,000 rows would be hundreds of MB.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20
#: Bytes of a stash's row groups, which its writers hold in memory.
GROUP_BYTES = 32 << 20

_built: dict = {}
_kept: dict = {}
_stored: list[str] = []
_path_of: WeakKeyDictionary = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a Python worker, whatever the length of the texts.

    Spark reads these settings when a plan runs, so they hold for the session's later queries as well; smaller ones
    that the session has are left alone.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        held = int(re.sub(r"\D", "", spark.conf.get(f"spark.sql.execution.arrow.{key}", str(most + 1))))
        if held not in range(1, most + 1):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary folder only where that is unset and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _built.get("scratch")
        if not shared:
            shared = _built["scratch"] = tempfile.mkdtemp(prefix="gridspark-")
            spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    home = f"{scratch_dir(spark)}/gridspark-{spark.sparkContext.applicationId}"
    if home not in _built:
        _built[home] = True
        atexit.register(_remove, spark, home)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    _stored.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


@contextmanager
def stashes(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Yields keep(df, name): a stash that outlives the block. All other stashes made in the block are deleted at its end.

    So what leaves the block must be a kept table, stored as a whole by then: no later task, and no recovery of a lost
    one, reads what has been deleted.
    """
    begun, kept = len(_stored), set()

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stash(df, name)
        kept.add(_stored[-1])
        return out

    yield keep
    made = _stored[begun:]
    _stored[begun:] = [path for path in made if path in kept]
    for path in made:
        if path not in kept:
            _remove(spark, path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """In the block, a query's shuffle files go once it has ended: what stashes leave behind is their tables alone."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free(df: DataFrame) -> None:
    """Delete a stash that nothing reads any more; other frames are left alone."""
    path = _path_of.pop(df, None)
    if path in _stored:
        _stored.remove(path)
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, home: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        path = jvm.org.apache.hadoop.fs.Path(home)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended first; the folder is scratch
        pass


def per_process(key: object, build: Callable[[], object]) -> object:
    """build() once in each Python worker; workers are used again by later tasks.

    One thing is kept at a time: a worker that serves several stages would otherwise hold the caches of all.
    """
    if key not in _kept:
        if _kept:
            _kept.clear()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # else a worker holds what the last stage's caches took
                libc.malloc_trim(0)
        _kept[key] = build()
    return _kept[key]


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % n


def map_batches(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name for each of `names` that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def drawn_rows(docs: DataFrame, labels: DataFrame, usable, label: str, most: dict[int, int], chars: int) -> list[tuple]:
    """(doc_id, text, label) of whole labelled texts to fit on: in each class about most[class] ids of the smallest hashes.

    Of these, in the order of their hashes, as many as come to `chars` characters in all. An id counts once in a class,
    with its smallest text, so nothing depends on partitions; null texts are left out.
    """
    known = labels.where(usable & F.col(label).isin(*most)).select("doc_id", F.col(label).alias("label")).distinct()
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    share = F.lit(0.0)
    for value, n in most.items():
        share = F.when(F.col("label") == value, n / max(sizes.get(value, 0), 1)).otherwise(share)
    drawn = known.withColumn("draw", draw).where(F.col("draw") < share)  # about sum(most) ids
    read = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    once = read.groupBy("draw", "doc_id", "label").agg(F.min("text").alias("text"))
    bound = 2 * sum(most.values())
    upto = F.sum(F.length("text")).over(Window.orderBy("draw", "doc_id", "label"))  # over the drawn rows
    found = once.withColumn("upto", upto).where(F.col("upto") <= chars).select("doc_id", "text", "label").limit(bound + 1).collect()
    if len(found) > bound:
        raise ValueError(f"more than {bound} rows to fit on")
    return [tuple(r) for r in found]


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of these rows."""
    columns = zip(*rows) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def by_size(batches: Iterable[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of one come to at most `most` bytes (or are one text)."""
    for b in batches:
        texts = b.column(column)
        wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=wide)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < b.num_rows:
            yield b.slice(start)


def gather(index: np.ndarray, values: list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in values[index[0]], values[index[1]], ..., one after another, and where each one ends."""
    flat = np.frombuffer(b"".join(values), dtype=dtype)
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // flat.itemsize
    starts = np.cumsum(sizes) - sizes
    n = sizes[index]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0], ends
    at = np.repeat(starts[index] - (ends - n), n)
    at += np.arange(ends[-1])
    return flat[at], ends


def binary_column(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the numbers between the given ends."""
    offsets = np.concatenate(([0], ends)).astype(np.int64) * flat.itemsize
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of ids beyond 2 GiB")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])
