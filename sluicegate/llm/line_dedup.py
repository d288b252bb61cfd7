"""Line dedup by range-partitioned hashes.

Every line becomes (128-bit hash of its key, document, position). The rows are range-partitioned and sorted by
hash, document and position, so each task streams runs of equal hashes in order of first occurrence and holds at
most the rows of ``min_docs`` documents of one run. A run that crosses a partition's edge is left open there; the
two edge runs of each partition are summed on the driver (two rows a partition) and settle the open rows. What
comes back for each document is a compressed keep bitmap, no text.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Lines with an empty key stay.

Cases: a null or empty text is one empty line; rows that are equal in doc_id and text are one document and share a
bitmap; a null doc_id is a document like others; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.common import documents, materialise, released, row_key, small_batches

SPACE = " \t\n\x0b\f\r"
DROP, OPEN, EDGE = 0, 1, 2
RUNS = "kind int, h1 long, h2 long, k1 long, k2 long, pos int, first boolean, part int, docs long, l1 long, l2 long"


def line_key(line: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(SPACE)), upper, upper.lower())


def encode_bitmap(n: int, dropped: list[int]) -> bytes:
    """A document's keep bits, packed from the lowest bit of the first byte, deflated."""
    bits = np.ones(n, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def decode_bitmap(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n, bitorder="little").astype(bool)


def _stream_runs(min_docs: int, keep_first: bool):
    """Streams sorted rows; emits lines to drop, open rows of edge runs, and a summary of each edge run."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "k1", "k2", "pos"]
        part = TaskContext.get().partitionId()
        schema = pa.schema([("kind", pa.int32()), *[(n, pa.int64()) for n in names[:4]], ("pos", pa.int32()), ("first", pa.bool_()), ("part", pa.int32()), ("docs", pa.int64()), ("l1", pa.int64()), ("l2", pa.int64())])

        def rows(kind: int, a: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.array(a[:, k]) for k in range(4)], pa.array(a[:, 4].astype(np.int32)), pa.array(first), pa.array(np.full(n, part, np.int32)), *[pa.nulls(n, pa.int64())] * 3], schema=schema)

        def edge(run: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"kind": EDGE, "h1": run["h"][0], "h2": run["h"][1], "k1": run["k"][0], "k2": run["k"][1], "part": part, "docs": run["docs"], "l1": run["last"][0], "l2": run["last"][1]}], schema=schema)

        def finish(run: dict, at_edge: bool) -> Iterator[pa.RecordBatch]:
            if at_edge:
                if len(run["held"]):
                    yield rows(OPEN, run["held"], run["held_first"])
                yield edge(run)

        def hot(run: dict, a: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rows of a run that has enough documents; only its very first row may be open or stay."""
            if keep_first:
                if run["initial"] and first.any():
                    yield rows(OPEN, a[first], first[first])
                a, first = a[~first], first[~first]
            if len(a):
                yield rows(DROP, a, first)

        run = None
        for batch in batches:
            a = np.stack([np.asarray(batch.column(n)).astype(np.int64) for n in names], 1)
            if not len(a):
                continue
            cut = np.flatnonzero((a[1:, :2] != a[:-1, :2]).any(1)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]])
            new_doc = np.concatenate([[True], (a[1:, :4] != a[:-1, :4]).any(1)])
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            plain = docs < min_docs  # a whole run of few documents away from the edges says nothing
            plain[[0, -1]] = False
            for s, e, n in zip(starts[~plain], ends[~plain], docs[~plain], strict=True):
                block, h = a[s:e], (a[s, 0], a[s, 1])
                if run is None or run["h"] != h:
                    if run is not None:
                        yield from finish(run, run["initial"])
                    run = {"h": h, "k": (a[s, 2], a[s, 3]), "last": None, "docs": 0, "held": a[:0], "held_first": np.zeros(0, bool), "initial": run is None}
                run["docs"] += int(n) - (run["last"] == (block[0, 2], block[0, 3]))
                first = np.zeros(len(block), bool)
                first[0] = run["last"] is None
                run["last"] = (block[-1, 2], block[-1, 3])
                if run["docs"] < min_docs:
                    run["held"], run["held_first"] = np.concatenate([run["held"], block]), np.concatenate([run["held_first"], first])
                else:
                    yield from hot(run, np.concatenate([run["held"], block]), np.concatenate([run["held_first"], first]))
                    run["held"], run["held_first"] = a[:0], np.zeros(0, bool)
        if run is not None:
            yield from finish(run, True)

    return stream


def dropped_lines(docs: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """(k1, k2, pos) of each line to drop."""
    spark = docs.sparkSession
    lines = docs.select("doc_id", *row_key("doc_id", "text"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line"))).where("key <> ''")
    hashed = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "pos")
    order = ["h1", "h2", "doc_id", "k1", "k2", "pos"]
    found = materialise(hashed.repartitionByRange(*order).sortWithinPartitions(*order).drop("doc_id").mapInArrow(_stream_runs(min_docs, keep_first), RUNS), "line-runs")
    totals: dict = {}
    for e in sorted((tuple(x) for x in found.where(F.col("kind") == EDGE).select("h1", "h2", "part", "docs", "k1", "k2", "l1", "l2").collect()), key=lambda x: x[2]):  # two rows a partition
        docs_, first_part, last = totals.get(e[:2], (0, e[2], None))
        if last != (e[2], *e[4:8]):
            totals[e[:2]] = (docs_ + e[3] - (last is not None and last[3:] == e[4:6]), first_part, (e[2], *e[4:8]))
    settled = spark.createDataFrame([(*h, v[1]) for h, v in totals.items() if v[0] >= min_docs], "h1 long, h2 long, first_part int")
    opened = found.where(F.col("kind") == OPEN).join(F.broadcast(settled), ["h1", "h2"])
    if keep_first:
        opened = opened.where(~(F.col("first") & (F.col("part") == F.col("first_part"))))
    return found.where(F.col("kind") == DROP).select("k1", "k2", "pos").unionByName(opened.select("k1", "k2", "pos"))


def line_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """For each distinct document (_k1, _k2 stand for doc_id and text): doc_id, n_lines, n_dropped, keep_bitmap.

    Lines whose key is in at least ``min_docs`` documents go, all of them or (``keep_first``) all but the first
    occurrence by document and position."""
    sizes = docs.select("doc_id", *row_key("doc_id", "text"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines")).groupBy("doc_id", "_k1", "_k2").agg(F.first("n_lines").alias("n_lines"))
    gone = dropped_lines(docs, min_docs, keep_first).groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.collect_set("pos").alias("gone"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = [g or [] for g in b.column("gone").to_pylist()]
            n = b.column("n_lines").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_k1"), b.column("_k2"), pa.array(n, pa.int64()), pa.array(map(len, gone), pa.int64()), pa.array(map(encode_bitmap, n, gone), pa.binary())], ["doc_id", "_k1", "_k2", "n_lines", "n_dropped", "keep_bitmap"])

    return sizes.join(gone, ["_k1", "_k2"], "left").select("doc_id", "_k1", "_k2", "n_lines", "gone").mapInArrow(encode, "doc_id long, _k1 long, _k2 long, n_lines long, n_dropped long, keep_bitmap binary")


def keep_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text (what the bitmaps keep, joined by \\n), n_lines, n_dropped: the other columns pass through
    where their names are not these."""
    own = [c for c in docs.columns if c not in ("_k1", "_k2", "_bitmap", "n_lines", "n_dropped")]
    joined = docs.select(*own, *row_key("doc_id", "text")).join(bitmaps.where("n_dropped > 0").select("_k1", "_k2", F.col("keep_bitmap").alias("_bitmap")), ["_k1", "_k2"], "left").drop("_k1", "_k2")
    schema = joined.drop("_bitmap").withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_dropped", F.lit(0).cast("long")).schema

    small_batches(docs.sparkSession)

    @released
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines_n, dropped = [], [], []
            for text, bitmap in zip(b.column("text").to_pylist(), b.column("_bitmap").to_pylist(), strict=True):
                if bitmap is None:
                    texts.append(text)
                    lines_n.append((text or "").count("\n") + 1)
                    dropped.append(0)
                else:
                    lines = text.split("\n")
                    keep = decode_bitmap(bitmap, len(lines))
                    texts.append("\n".join(x for x, k in zip(lines, keep, strict=True) if k))
                    lines_n.append(len(lines))
                    dropped.append(len(lines) - int(keep.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in own] + [pa.array(lines_n, pa.int64()), pa.array(dropped, pa.int64())], [*own, "n_lines", "n_dropped"])

    return joined.mapInArrow(apply, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = keep_lines(docs, line_bitmaps(docs, min_docs=10))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
     k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     h AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
     j AS (SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
