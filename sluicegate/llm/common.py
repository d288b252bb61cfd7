"""What the operators share: the shared folder, materialised tables, row keys, and vectorised tokens.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere but in decontamination (white space of Unicode). Texts reach Python as Arrow strings and are cut into
slices of a few MB, so a worker's memory doesn't depend on how many rows come in a batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by a Python worker.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a temporary folder only where that is unset and
    the driver is the only executor, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "sluicegate-shared")
        spark.conf.set("spark.checkpoint.dir", top)
    if "://" not in top:
        top = f"file://{os.path.abspath(top)}"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and rereads it: lost executors lose nothing, and lineage ends here."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["written"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the shuffle files of finished jobs removed that nothing refers to any more; Spark does so when the driver's
    garbage is collected, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; any executor can call it."""
    return pafs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have a few MB, however long the texts are, unless it says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "2147483647", "268435456", "67108864"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))


def released(run):
    """run over batches, with the memory that it has used given back to the system now and then and at its end: Python
    workers serve one task after another, and what each leaves behind would add up."""

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for k, out in enumerate(run(batches), 1):
                yield out
                del out
                if k % 16 == 0:
                    give_back()
        finally:
            give_back()

    return wrapped


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all elements of runs given by start and size, run after run."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def row_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes that stand for a row's content, nulls included; equal rows share them."""
    parts = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(1), *parts).alias("_k1"), F.xxhash64(F.lit(2), *parts, F.lit(7)).alias("_k2")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``limit`` bytes (one row at least)."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def words(texts: pa.Array, lower: bool = True, unicode: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's words begin (one entry more than texts); with the case
    and white space of ASCII, or those of Unicode."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts) if unicode else pc.ascii_lower(texts)
    lists = pc.utf8_split_whitespace(texts) if unicode else pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), at[offsets]


def hash_words(flat: pa.Array, strip: str | None = None) -> np.ndarray:
    """A 64-bit hash for each word (without the characters of ``strip`` at its ends); each distinct word of the
    slice is hashed once."""
    from xxhash import xxh64_intdigest

    coded = flat.dictionary_encode()
    own = np.fromiter((xxh64_intdigest(w.strip(strip) if strip else w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words that begin at each place; the last n-1 places are not given."""
    out = np.zeros(max(0, len(word_hashes) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : k + len(out)]
    return mix(out)


def spread(starts: np.ndarray) -> np.ndarray:
    """For offsets of groups, the group of each element."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))
