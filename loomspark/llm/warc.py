"""WARC records in seekable Zstandard bundles.

A bundle is a run of Zstandard frames, each a group of whole WARC records, then a footer: a skippable frame with
the seek table of the public seekable format (compressed and decompressed size and checksum of every
frame). A reader finds any record from three numbers: the frame's place and size, and the record's offset
inside the decompressed frame; the index table maps record ids to them. Frames are independent, so one
record costs one ranged read and one frame's decompression, and a damaged frame loses only its own records.

Equal payloads of at least ``least_bytes`` are stored once: the record with the largest id is a response, the others
are revisit records that name it. Repeated digests are found from keys alone. A Bloom filter of them, of fixed size, goes to
the scan: rows that it rules out are written where they are read, and only the others, with few false ones, are shuffled
and joined. Every bundle begins with a warcinfo record in a frame of its own. Bundles are named by their content, so a task
that runs again after an executor is lost writes the same files again, and no reader sees a half-written one.

Defined cases: a null payload is empty; a null or empty url has the record's own URN as its target and is read back as null; a
null id is written as an empty id and read back as null; repeated rows, and rows with equal ids, are records of their own, with
ids told apart by a row number; of rows with one payload and the largest id all are responses, and revisits name the first; a
very long payload is a frame by itself; an empty table gives no bundles and an empty result; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import filesystem, fresh_path, put_file, written

#: Decompressed bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
LEAST_BYTES = 1000
#: Bits of the filter of repeated digests: 1 MB. More digests mean more rows that are shuffled, not other results.
FILTER_BITS = 1 << 23
#: Fixed values of the public seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = "record_id string, id long, bundle string, frame int, frame_at long, frame_bytes long, record_at long, record_bytes long"
_RECORD = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_id(kind: str, key: int | None, row: int) -> str:
    return f"<urn:{kind}:{'' if key is None else key}:{row}>"


def _key_of(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:[\w-]+:(-?\d+):\d+>", urn)
    return int(found[1]) if found else None


def _record(head: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(rid: str, date: str) -> bytes:
    fields = b"software: loomspark\r\nformat: WARC File Format 1.1\r\n"
    return _record({"WARC-Type": "warcinfo", "WARC-Record-ID": rid, "WARC-Date": date, "Content-Type": "application/warc-fields"}, fields)


def encode_record(rid: str, date: str, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit if it *refers_to* another, with its HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else rid[1:-1]
    head = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": rid, "WARC-Date": date, "WARC-Target-URI": target}
    if refers_to:
        head |= {"WARC-Refers-To": refers_to, "WARC-Refers-To-Date": date, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    return _record(head, http if refers_to else http + payload)


def decode_records(data: bytes) -> Iterator[dict]:
    """The records of a decompressed frame (or of one record's bytes)."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        begin, size = end + 4, int(head["Content-Length"])
        block, at = data[begin : begin + size], begin + size + 4
        if head["WARC-Type"] == "warcinfo":
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't match its digest")
        yield {
            "id": _key_of(head["WARC-Record-ID"]),
            "payload_bytes": length,
            "payload_digest": digest,
            "record_type": head["WARC-Type"],
            "refers_to": _key_of(head["WARC-Refers-To"]) if revisit else None,
            "url": None if f"<{head['WARC-Target-URI']}>" == head["WARC-Record-ID"] else head["WARC-Target-URI"],
            "payload": None if revisit else payload,
        }


class BundleWriter:
    """Collects records into frames and closes the bundle with its seek table."""

    def __init__(self, date: str, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self._compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self._date, self._frame_bytes, self._open, self._size = date, frame_bytes, [], 0
        self.out, self.frames, self.index = bytearray(), [], []

    def add(self, key: int | None, rid: str, record: bytes) -> None:
        if not self.index:  # the first frame says what the bundle is
            self._open = [info_record(rid.replace("<urn:", "<urn:info-of-", 1), self._date)]
            self._close()
        if self._open and self._size + len(record) > self._frame_bytes:
            self._close()
        self.index.append([rid, key, len(self.frames), self._size, len(record)])
        self._open.append(record)
        self._size += len(record)

    def _close(self) -> None:
        raw = b"".join(self._open)
        packed = self._compressor.compress(raw)
        self.frames.append((len(self.out), len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.out += packed
        self._open, self._size = [], 0

    def finish(self) -> bytes:
        if self._open:
            self._close()
        table = b"".join(struct.pack("<III", packed, raw, check) for _, packed, raw, check in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0x80, _SEEKABLE)
        return bytes(self.out) + struct.pack("<II", _SKIPPABLE, len(table) + len(footer)) + table + footer


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of every frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    width, at, out = 12 if flags & 0x80 else 8, 0, []
    for i in range(n):
        packed, raw = struct.unpack_from("<II", bundle, len(bundle) - 9 - width * (n - i))
        out.append((at, packed, raw))
        at += packed
    return out


def read_frame(packed: bytes, raw_size: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=raw_size)


def _bits(digest: Column) -> list[Column]:
    """Three places of a digest in a filter of ``FILTER_BITS`` bits."""
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(FILTER_BITS)) for i in range(3)]


def _filter_of(digests: DataFrame) -> np.ndarray:
    """A Bloom filter of the column digest, as 64-bit words. The driver gets a row for each word at most."""
    bits = digests.select(F.explode(F.array(*_bits(F.col("digest")))).alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in words.collect():
        out[r["w"]] = r["v"]
    return out


def planned(df: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """row, id, url, body, digest, size, keeper and keeper_row (null for responses). Only payloads that may repeat are shuffled."""
    body = F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha1("body"), "size": F.octet_length("body").cast("long")})
    # a count and a maximum of each digest are combined before they are shuffled; the first of the largest ids is the keeper
    keys = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size")
    copies = written(keys.agg(F.max(F.struct("id", (-F.col("row")).alias("r"))).alias("m"), F.count("*").alias("n")).where("n > 1 and m.id is not null").select("digest", "size", F.col("m.id").alias("keeper"), (-F.col("m.r")).alias("keeper_row")), "warc-copies")
    words = _filter_of(copies)

    @F.arrow_udf("boolean")
    def may_repeat(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        hits = [(words[x >> 6] >> (x & 63)) & 1 for x in (y.to_numpy() for y in (a, b, c))]
        return pa.array((hits[0] & hits[1] & hits[2]).astype(bool))

    marked = rows.withColumn("may", (F.col("size") >= least_bytes) & may_repeat(*_bits(F.col("digest"))))
    none = F.lit(None).cast("long")
    alone = marked.where("not may").drop("may").withColumns({"keeper": none, "keeper_row": none})
    met = marked.where("may").drop("may").join(copies, ["digest", "size"], "left")
    is_revisit = F.col("id").isNull() | (F.col("id") < F.col("keeper"))
    met = met.withColumns({"keeper": F.when(is_revisit, F.col("keeper")), "keeper_row": F.when(is_revisit, F.col("keeper_row"))})
    # a revisit needs no body
    return alone.unionByName(met.withColumn("body", F.when(F.col("keeper").isNull(), F.col("body")).otherwise(F.lit(b""))))


def write_bundles(plan: DataFrame, folder: str, date: str, kind: str = "page", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes bundles into *folder* and returns the index: where each record lies."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(date, frame_bytes)

        def close() -> pa.RecordBatch:
            data = writer.finish()
            name = hashlib.sha256(data).hexdigest() + ".warc.zst"
            put_file(folder, name, data)
            rows = [[r, k, name, f, writer.frames[f][0], writer.frames[f][1], at, n] for r, k, f, at, n in writer.index]
            names = [x.strip().split(" ")[0] for x in _INDEX.split(",")]
            types = [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                rid = record_id(kind, r["id"], r["row"])
                keeper = record_id(kind, r["keeper"], r["keeper_row"]) if r["keeper"] is not None else None
                writer.add(r["id"], rid, encode_record(rid, date, r["url"], r["body"], r["digest"], r["size"], keeper))
                if len(writer.out) >= bundle_bytes:
                    yield close()
                    writer = BundleWriter(date, frame_bytes)
        if writer.index:
            yield close()

    return plan.mapInArrow(write, _INDEX)


def read_bundles(spark: SparkSession, folder: str, index: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the indexed bundles, read frame by frame from the files."""
    frames = index.select("bundle", "frame_at", "frame_bytes").distinct()
    schema = _RECORD if with_payload else _RECORD.removesuffix(", payload binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = filesystem(folder)
        opener, names = zstandard.ZstdDecompressor(), [x.strip().split(" ")[0] for x in schema.split(",")]
        types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.strip().split(" ")[1]] for x in schema.split(",")]
        name, bundle = None, None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["bundle"] != name:  # frames of a bundle follow each other
                        if bundle is not None:
                            bundle.close()
                        name, bundle = r["bundle"], fs.open_input_file(f"{root}/{r['bundle']}")
                    bundle.seek(r["frame_at"])
                    rows = list(decode_records(opener.decompress(bundle.read(r["frame_bytes"]))))
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in zip(names, types, strict=True)], names=names)
        finally:
            if bundle is not None:
                bundle.close()

    # bundles are of bounded size, so a bundle is a fair share of a task
    return frames.repartition(max(2, 4 * spark.sparkContext.defaultParallelism), "bundle").sortWithinPartitions("bundle", "frame_at").mapInArrow(read, schema)


def lookup(spark: SparkSession, folder: str, index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose id is in *ids* (a column id): one ranged read and one frame for each."""
    wanted = index.join(ids.select("id").distinct(), "id", "left_semi").select("bundle", "frame_at", "frame_bytes", "record_at", "record_bytes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = filesystem(folder)
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{root}/{r['bundle']}") as f:
                    f.seek(r["frame_at"])
                    raw = opener.decompress(f.read(r["frame_bytes"]))
                found = next(decode_records(raw[r["record_at"] : r["record_at"] + r["record_bytes"]]))
                names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([found[n]], t) for n, t in zip(names, types, strict=True)], names=names)

    return wanted.mapInArrow(read, _RECORD)


def archive(df: DataFrame, folder: str | None = None, date: str | None = None, **options) -> tuple[str, DataFrame]:
    """Writes *df* as bundles; returns the folder and the written index. *date* (ISO 8601, UTC) is the records' WARC-Date: now, if none."""
    folder = folder or fresh_path(df.sparkSession, "warc")
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())  # once, on the driver: tasks that run again agree
    return folder, written(write_bundles(planned(df, **options), folder, date), "warc-index")
