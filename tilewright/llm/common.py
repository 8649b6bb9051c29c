"""What the operators share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 300_000
#: A sieve has so many bits a key, as long as they are no more than 16 MB in all; words of 64 bits go by chunks.
SIEVE_BITS, SIEVE_MOST, _CHUNK_BITS = 16, 1 << 27, 16
_own_dirs: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session that names none gets a temporary one; on a cluster that would lose rows.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share (master {master})")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="tilewright-"))
        atexit.register(shutil.rmtree, _own_dirs[0], ignore_errors=True)
    return f"file://{_own_dirs[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again.

    This cuts the lineage: an executor that is lost later costs a read, not the work before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilewright/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _tables.append(path)
    out = spark.read.schema(schema).parquet(path)
    out._tilewright_table = path
    return out


def in_files(df: DataFrame, rows: int, each: int = 10_000) -> DataFrame:
    """The frame, of about so many rows, in at most one partition for each `each` of them, so that writing it makes few files."""
    return df.coalesce(max(1, -(-rows // each)))


def tables() -> int:
    """How many tables written() has made and not released: a mark for release()."""
    return len(_tables)


def release(spark: SparkSession, *but: DataFrame, since: int = 0) -> None:
    """Deletes the tables that written() made after a mark, but those given; frames that read them are void."""
    kept = {getattr(df, "_tilewright_table", None) for df in but}
    jvm = spark.sparkContext._jvm
    for path in [p for p in _tables[since:] if p not in kept]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        _tables.remove(path)


def release_unread(df: DataFrame, since: int) -> DataFrame:
    """The frame; deletes the tables that written() made after a mark and that its plan doesn't read."""
    read = df.inputFiles()
    gone = [path for path in _tables[since:] if not any(path.rpartition("/")[2] in file for file in read)]
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        _tables.remove(path)
    return df


def forget_shuffles(spark: SparkSession) -> None:
    """Has Spark delete the files of shuffles that no frame reads any more, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns this process's free memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in no bucket (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n), F.lit(-1))


def text_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def texts(array: pa.Array) -> list[str]:
    return [x or "" for x in array.to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that bound what Python holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices(array: pa.Array, rows: int = 512) -> Iterator[pa.Array]:
    """The array in parts, so that few values at a time are Python objects."""
    for at in range(0, len(array), rows):
        yield array.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; wraps silently."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """Marked for broadcast if counted to be at most BROADCAST_ROWS short rows, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sieve_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, bit), all of a chunk in one task, to (chunk, words)."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        chunk, bit = batch["chunk"].to_numpy(), batch["bit"].to_numpy()
        for c in np.unique(chunk).tolist():
            held.setdefault(c, np.zeros(1 << _CHUNK_BITS, np.uint8))[bit[chunk == c]] = 1
        for c in [c for c in held if len(held) > 256]:
            yield _sieve_words({c: held.pop(c)})
    yield _sieve_words(held)


def _sieve_words(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    words = [np.packbits(x, bitorder="little").view("<i8") for x in held.values()]
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array(words, pa.list_(pa.int64()))], names=["chunk", "words"])


def sieved(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose columns `on` may be in a written table of keys: all that are, and few others (6 % while a sieve has SIEVE_BITS a key).

    What is broadcast is bounded; with more keys more other rows stay, so a join still has to follow.
    """
    n, bits = keys.count(), 1 << 20
    if n <= BROADCAST_ROWS:
        return df.join(F.broadcast(keys), on, "left_semi")
    wanted = min(SIEVE_MOST, SIEVE_BITS * n)
    while bits < wanted:
        bits *= 2
    at = lambda: F.xxhash64(*(F.col(c) for c in on)).bitwiseAND(F.lit(bits - 1))
    low = F.lit((1 << _CHUNK_BITS) - 1).cast("long")
    places = keys.select(F.shiftright(at(), _CHUNK_BITS).cast("int").alias("chunk"), at().bitwiseAND(low).cast("int").alias("bit"))
    # A chunk may come in several rows, each with some of its bits.
    parts = places.repartition("chunk").mapInArrow(_sieve_chunks, "chunk int, words array<long>")
    either = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    chunks = written(parts.groupBy(F.col("chunk").alias("__chunk")).agg(F.aggregate(F.collect_list("words"), F.array().cast("array<long>"), either).alias("__words")), "sieve")
    rows = df.withColumn("__at", at())
    met = rows.join(F.broadcast(chunks), F.shiftright("__at", _CHUNK_BITS).cast("int") == F.col("__chunk"))
    word = F.get("__words", F.shiftright(F.col("__at").bitwiseAND(low), 6).cast("int"))
    hit = F.call_function("shiftright", word, F.col("__at").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.where(hit).select(*df.columns)


def joined(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df joined with a written table of keys: broadcast if small, else only what passes a sieve of them is shuffled."""
    if keys.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(keys), on)
    return sieved(df, keys, on).join(keys, on)
