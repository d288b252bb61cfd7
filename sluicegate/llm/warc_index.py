"""WARC archives with a two-level capture index.

Archives are gzip members, one per record. The index sorts captures by reversed-host URL key and page id
into compressed blocks; each index shard ends with a sparse directory of its blocks, and a root file lists the
shards. A lookup searches the root, then the shard's directory, then one block, and so reads a few KB ranges.

Cases: a null html is an empty payload; a null url has the empty key; a null page_id is kept as null and never
referred to; repeated rows give a record each (with equal page ids, all rows that hold the group's largest
page_id are responses); an empty table gives an empty index. Only page_id, url and html are read, so other
columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.common import materialise, open_fs, shared_dir

#: Captures in a block of the index, and bytes at most before compression.
BLOCK_ROWS, BLOCK_BYTES = 2000, 1 << 20
#: Bytes of an archive file before the next begins.
ARCHIVE_BYTES = 1 << 30
#: Payloads under this size are stored again, as a revisit record would save little.
MIN_REVISIT = 1000
#: Adjacent records are read in one range of about this size.
READ_BYTES = 4 << 20
NO_ID = -(1 << 63)
CAPTURE = "urlkey string, page_id long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``: host labels reversed and lower-cased, scheme, user, port and fragment gone."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*|[\\x00-\\x20]", "")
    host = F.lower(F.regexp_extract(plain, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]*)", 1))
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)


def record_types(pages: DataFrame) -> DataFrame:
    """Adds payload, digest and refers_to. Groups are reduced before the shuffle; the join back is left outer on
    the digest, which adaptive execution splits where one group is large."""
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    heads = rows.where(F.length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "head")
    return rows.join(heads, "digest", "left").select("page_id", "url", url_key(F.col("url")).alias("urlkey"), "payload", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("head")), F.col("head")).alias("refers_to"))


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member that holds a response or a revisit record."""
    revisit = refers_to is not None
    digest32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {''.join(c if c > ' ' else f'%{ord(c):02X}' for c in url or '')}", f"WARC-Payload-Digest: sha1:{digest32}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    record = "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def decode_record(member: bytes) -> dict:
    """Parses a gzip member; a response's digest is computed anew from its payload and must equal the header's."""
    record = zlib.decompress(member, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: None if x in (None, "<urn:x-page:none>") else int(x[12:-1])
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To"))}


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """Writes the records and returns their places as a table. A file's name is new in each attempt, so the table
    names complete files only, whatever attempts failed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                data = encode_record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                out.write(data)
                rows.append((r["urlkey"], r["page_id"], name, at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["urlkey", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialise(typed.mapInArrow(write, CAPTURE), "warc-captures")


def build_index(captures: DataFrame, folder: str) -> None:
    """Sorts captures into shards of compressed blocks, each with its directory at the end, and writes the root."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.idx"
        out, at, directory, block, held, last = None, 0, [], [], 0, None

        def flush() -> None:
            nonlocal at, block, held
            data = zlib.compress("\n".join(block).encode(), 6)
            out.write(data)
            directory.append([json.loads(block[0])[:2], last, at, len(data)])
            at, block, held = at + len(data), [], 0

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                key = [r["urlkey"], NO_ID if r["page_id"] is None else r["page_id"]]
                block.append(json.dumps([*key, r["file"], r["offset"], r["length"]]))
                held, last = held + len(block[-1]), key
                if len(block) >= BLOCK_ROWS or held >= BLOCK_BYTES:
                    flush()
        if out is not None:
            if block:
                flush()
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(tail)
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "at": [at], "size": [len(tail)], "first": [json.dumps(directory[0][0])], "last": [json.dumps(last)]})

    ordered = captures.withColumn("_id", F.coalesce("page_id", F.lit(NO_ID))).repartitionByRange("urlkey", "_id", "file", "offset").sortWithinPartitions("urlkey", "_id").drop("_id")
    shards = ordered.mapInArrow(write, "name string, at long, size long, first string, last string").collect()  # a row for each partition
    fs, top = open_fs(folder)
    fs.create_dir(top, recursive=True)
    root = sorted([json.loads(s["first"]), json.loads(s["last"]), s["name"], s["at"], s["size"]] for s in shards)
    with fs.open_output_stream(f"{top}/root.json") as out:
        out.write(json.dumps(root).encode())


class IndexReader:
    """Finds captures by key. It holds the root (a line per shard), one directory and one block."""

    def __init__(self, folder: str) -> None:
        self.fs, self.top = open_fs(folder)
        with self.fs.open_input_stream(f"{self.top}/root.json") as f:
            self.root = json.loads(f.read())
        self.lasts = [x[1] for x in self.root]
        self.shard: tuple = ("", [], [])
        self.block: tuple = (("", -1), [])

    def _range(self, name: str, at: int, size: int) -> bytes:
        with self.fs.open_input_file(f"{self.top}/{name}") as f:
            return zlib.decompress(f.read_at(size, at))

    def find(self, urlkey: str, page_id: int | None) -> list[tuple[str, int, int]]:
        key, found = [urlkey, NO_ID if page_id is None else page_id], []
        for first, _, name, at, size in self.root[bisect_left(self.lasts, key) :]:
            if first > key:
                break
            if self.shard[0] != name:
                directory = json.loads(self._range(name, at, size))
                self.shard = (name, directory, [x[1] for x in directory])
            for b_first, _, b_at, b_size in self.shard[1][bisect_left(self.shard[2], key) :]:
                if b_first > key:
                    break
                if self.block[0] != (name, b_at):
                    self.block = ((name, b_at), [json.loads(x) for x in self._range(name, b_at, b_size).decode().split("\n")])
                lines = self.block[1]
                k = bisect_left(lines, key, key=lambda x: x[:2])
                while k < len(lines) and lines[k][:2] == key:
                    found.append(tuple(lines[k][2:]))
                    k += 1
        return found


def lookup(queries: DataFrame, folder: str) -> DataFrame:
    """The places of the captures with each (urlkey, page_id); queries come sorted, so that a block is read once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            reader = reader or IndexReader(folder)
            rows = [(r["urlkey"], r["page_id"], *x) for r in batch.to_pylist() for x in reader.find(r["urlkey"], r["page_id"])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["urlkey", "page_id", "file", "offset", "length"])

    return queries.select("urlkey", "page_id").distinct().repartitionByRange("urlkey", "page_id").sortWithinPartitions("urlkey", "page_id").mapInArrow(find, CAPTURE)


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Reads the records at the given places, in the order of the archives, adjacent ones in one range."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        f, name = None, ""
        for batch in batches:
            rows, k, found = batch.to_pylist(), 0, []
            while k < len(rows):
                end = k + 1
                while end < len(rows) and rows[end]["file"] == rows[k]["file"] and rows[end]["offset"] == rows[end - 1]["offset"] + rows[end - 1]["length"] and rows[end]["offset"] - rows[k]["offset"] < READ_BYTES:
                    end += 1
                if name != rows[k]["file"]:
                    if f:
                        f.close()
                    name = rows[k]["file"]
                    f = fs.open_input_file(f"{top}/{name}")
                start = rows[k]["offset"]
                data = f.read_at(rows[end - 1]["offset"] + rows[end - 1]["length"] - start, start)
                found += [decode_record(data[r["offset"] - start : r["offset"] - start + r["length"]]) for r in rows[k:end]]
                k = end
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))
        if f:
            f.close()

    return places.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> str:
    """Writes archives and index below one folder (in the shared folder unless given) and returns it."""
    folder = folder or shared_dir(spark, "warc")
    build_index(write_archives(record_types(pages), f"{folder}/archive"), f"{folder}/index")
    return folder


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = archive(spark, pages)
    places = lookup(pages.select(url_key(F.col("url")).alias("urlkey"), "page_id"), f"{folder}/index")
    return read_records(places, f"{folder}/archive").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     g AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN g.head IS NULL OR g.head = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.head <> p.page_id THEN g.head END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
