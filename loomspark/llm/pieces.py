"""SentencePiece encoding and decoding with a table of distinct chunks.

When no piece of a model crosses from other characters into a white-space marker, text can be cut before every
run of markers without changing the result: merges stay inside a chunk (markers and the word after them). So each
distinct chunk of the whole corpus is segmented once, and its ids are joined back to texts by position:

1. A scan cuts the texts into blocks of about ``BLOCK_BYTES`` and lists the distinct chunks of each, numbered in
   order of their first place. Inside a block a text is a row of such numbers.
2. Equal chunks of all blocks are brought together, packed in rows by a hash in ``BUCKETS`` buckets. The library segments each
   distinct one once, and decodes its ids. A block's part of the table (ids and decoded texts) goes into one file in the
   shared folder.
3. A second scan cuts the same blocks and joins ids, and decoded chunks, by their numbers.

What is shuffled is a packed row for each bucket of a block, not a row for each word; a task holds the distinct chunks of
one bucket. Blocks are named by their content; if
the second scan meets one that has no file (an input that isn't the same twice), its chunks are segmented there.
Files stay in the shared folder, as the result reads them.

:func:`chunkable` proves the condition from the model's own pieces and settings. Models that don't meet it
are run on whole texts.

Defined cases: a null text is empty; an empty text has the begin and end ids only; a very long text is a block by itself, and a
long run without white space one chunk; repeated rows are encoded one by one; extra columns, whatever their names, are ignored
(:func:`encode`) or kept (:func:`with_ids`); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import fresh_path, get_file, put_file, slices, string_buffer, tidy, word_hashes, written

MARK = "▁"
#: Text bytes of a block.
BLOCK_BYTES = 16 << 20
#: Buckets that chunks are dealt into: tasks of the segmentation, at most.
BUCKETS = 1024
_loaded: dict[str, object] = {}


def load_model(path: str):
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def chunkable(path: str) -> bool:
    """No normalisation but the marker for a space, markers lead, and no piece has one after another character."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    n, t = spec.normalizer_spec, spec.trainer_spec
    plain = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
    usual = t.model_type == 2 and t.byte_fallback and not t.treat_whitespace_as_suffix
    kinds = {p.type for p in spec.pieces} <= {1, 2, 3, 6}  # no user-defined piece, which would cut texts itself
    return bool(plain and usual and kinds and not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces))


def chunks_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct chunks in order of first place, the number of every chunk, the n + 1 offsets of texts among chunks, and texts.

    Each text that isn't empty gets the marker that the model puts before it. Markers are written as spaces, which mean the
    same, so chunks lie end to end in the bytes; the last array has those of all texts, and a text is all its chunks.
    """
    texts = pc.replace_substring(pc.fill_null(column, ""), MARK, " ")
    data, offsets = string_buffer(texts)
    some = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][some], 0x20)
    offsets = offsets + np.concatenate([[0], np.cumsum(some)])
    space = data == 0x20
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[offsets[:-1][some]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts, len(data)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(starts, offsets), data


def block_name(column: pa.Array) -> int:
    data, offsets = string_buffer(column)
    return int.from_bytes(hashlib.sha256(offsets.tobytes() + data.tobytes()).digest()[:8], "little", signed=True)


def segment(chunks: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """All ids of chunks and how many each has, and the decoded texts of those that don't decode to themselves."""
    model = load_model(path)
    texts = [c[1:].decode() for c in chunks]  # the model puts the first marker itself
    found = model.encode(texts, out_type=int, num_threads=1) if texts else []
    mark = [model.piece_to_id(MARK)]  # a marker alone
    found = [ids if t else mark for ids, t in zip(found, texts, strict=True)]
    back = model.decode(found, num_threads=1) if found else []
    n = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((x for ids in found for x in ids), np.uint32, int(n.sum())), n, {i: b for i, (b, t) in enumerate(zip(back, texts, strict=True)) if b != t}


def pack(ids: np.ndarray, n: np.ndarray, odd: dict[int, str]) -> bytes:
    rest = json.dumps({str(k): v for k, v in odd.items()}).encode() if odd else b""
    return struct.pack("<II", len(n), len(ids)) + zlib.compress(n.astype("<u4").tobytes() + ids.astype("<u4").tobytes() + rest, 1)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    k, total = struct.unpack_from("<II", raw)
    data = zlib.decompress(raw[8:])
    rest = data[4 * (k + total) :]
    return np.frombuffer(data, "<u4", total, 4 * k), np.frombuffer(data, "<u4", k).astype(np.int64), {int(i): v for i, v in json.loads(rest).items()} if rest else {}


def buckets(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The order of chunks by their buckets (ties: as they come), and the BUCKETS + 1 offsets of buckets in it."""
    data, offsets = string_buffer(chunks)
    own = (word_hashes(data, offsets[:-1], offsets[1:], seed=5) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return order, np.searchsorted(own[order], np.arange(BUCKETS + 1))


def _distinct(df: DataFrame, text: str) -> DataFrame:
    """bucket, block, chunks: the distinct chunks of each block, those of a bucket joined by a byte that UTF-8 never has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                chunks = chunks_of(part.column("text"))[0]
                order, at = buckets(chunks)
                listed = chunks.take(pa.array(order)).to_numpy(zero_copy_only=False).tolist()
                some = np.flatnonzero(np.diff(at))
                packed = [zlib.compress(b"\xff".join(listed[at[k] : at[k + 1]]), 1) for k in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), block_name(part.column("text")))), pa.array(packed, pa.binary())], names=["bucket", "block", "chunks"])

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), "bucket int, block long, chunks binary")


def _segmented(asked: DataFrame, path: str) -> DataFrame:
    """block, bucket, table: ids and decoded texts of the chunks of each row of *asked*, in their order.

    The rows of a bucket follow each other, and a chunk that a row had before is looked up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known = None, {}
        for batch in batches:
            out = []
            for b, raw in zip(batch.column("bucket").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                chunks = zlib.decompress(raw).split(b"\xff")
                new = [c for c in chunks if c not in known]
                ids, n, odd = segment(new, path)
                ends = np.cumsum(n).tolist()
                known.update((c, (ids[e - k : e], odd.get(i))) for i, (c, e, k) in enumerate(zip(new, ends, n.tolist(), strict=True)))
                found = [known[c] for c in chunks]
                out.append(pack(np.concatenate([x for x, _ in found]), np.fromiter((len(x) for x, _ in found), np.int64, len(found)), {i: x for i, (_, x) in enumerate(found) if x is not None}))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "table"])

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), "block long, bucket int, table binary")


def _filed(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a file for each block, its buckets' tables in order; returns block and n (tables)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, parts = None, {}

        def close() -> pa.RecordBatch:
            tables = [parts[k] for k in sorted(parts)]
            put_file(folder, f"{open_ & (1 << 64) - 1:016x}", struct.pack(f"<I{len(tables)}I", len(tables), *map(len, tables)) + b"".join(tables))
            return pa.RecordBatch.from_arrays([pa.array([open_], pa.int64()), pa.array([len(tables)], pa.int64())], names=["block", "n"])

        for batch in batches:
            for block, bucket, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "table")), strict=True):
                if open_ is not None and block != open_:
                    yield close()
                    parts = {}
                open_ = block
                parts[bucket] = raw  # equal blocks of several tasks have equal tables
        if open_ is not None:
            yield close()

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(run), "block long, n long")


def _looked_up(column: pa.Array, chunks: pa.Array, path: str, folder: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, str]]:
    """All ids, where those of each chunk begin, how many it has, and decoded texts of chunks that don't decode to themselves."""
    raw = get_file(folder, f"{block_name(column) & (1 << 64) - 1:016x}") if folder else None
    if raw is None:
        ids, n, odd = segment(chunks.to_pylist(), path)
        return ids, np.cumsum(n) - n, n, odd
    count, tables, at = struct.unpack_from("<I", raw)[0], [], 0
    at = 4 * (count + 1)
    for size in struct.unpack_from(f"<{count}I", raw, 4):
        tables.append(unpack(raw[at : at + size]))
        at += size
    order, first = buckets(chunks)[0].tolist(), 0
    ids, own = np.concatenate([t[0] for t in tables]), np.concatenate([t[1] for t in tables])
    if len(own) != len(chunks):
        raise ValueError("a block's table doesn't have its chunks")
    start, n, odd = np.empty(len(own), np.int64), np.empty(len(own), np.int64), {}
    start[order], n[order] = np.cumsum(own) - own, own
    for t in tables:
        odd.update({order[first + i]: v for i, v in t[2].items()})
        first += len(t[1])
    return ids, start, n, odd


def chunk_table(df: DataFrame, path: str, text: str = "text") -> str:
    """Segments each distinct chunk of *df* once; returns the folder of the blocks' files."""
    folder = fresh_path(df.sparkSession, "piece-blocks")
    written(_filed(_segmented(_distinct(df, text), path), folder), "piece-manifest")
    return folder


def encode_block(column: pa.Array, path: str, folder: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All ids of whole texts with begin and end, the n + 1 offsets of texts, and the decoded texts in UTF-8."""
    model = load_model(path)
    chunks, codes, at, data = chunks_of(column)
    ids, start, n, odd = _looked_up(column, chunks, path, folder)
    begins, own = start[codes], n[codes]
    places = np.repeat(begins - (np.cumsum(own) - own), own)
    places += np.arange(len(places))
    ends = np.concatenate([[0], np.cumsum(own)])[at]
    out = np.insert(ids[places], np.stack([ends[:-1], ends[1:]], axis=1).ravel(), np.tile(np.array([model.bos_id(), model.eos_id()], np.uint32), len(column)))
    sizes = np.concatenate([[0], np.cumsum(np.diff(string_buffer(chunks)[1])[codes])])[at]
    is_odd = np.zeros(len(chunks), dtype=bool)
    is_odd[list(odd)] = True
    hits = np.concatenate([[0], np.cumsum(is_odd[codes])])[at]
    buffer, back, listed = data.tobytes(), [], chunks.to_pylist() if odd else []
    for i, (b, e) in enumerate(zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)):
        if hits[i + 1] > hits[i]:  # each chunk after the first gets the space that its first marker stands for
            back.append(b" ".join([odd[c].encode() if c in odd else listed[c][1:] for c in codes[at[i] : at[i + 1]].tolist()]))
        else:
            back.append(buffer[b + 1 : e])
    return out, ends + 2 * np.arange(len(ends)), back


def encode_column(column: pa.Array, path: str, chunked: bool, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """:func:`encode_block`, or the library on whole texts for models that can't be cut."""
    if chunked:
        return encode_block(column, path, folder)
    model = load_model(path)
    found = model.encode(["" if t is None else t for t in column.to_pylist()], out_type=int, add_bos=True, add_eos=True, num_threads=1)
    back = [b.encode() for b in (model.decode(found, num_threads=1) if found else [])]
    return np.array([x for ids in found for x in ids], dtype=np.uint32), np.cumsum([0, *map(len, found)]), back


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every whole text of *df*."""
    chunked = chunkable(path)
    folder = chunk_table(df, path, text) if chunked else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                ids, at, back = encode_column(part.column("text"), path, chunked, folder)
                raw = ids.astype("<u4").tobytes()
                hashes = [hashlib.sha256(raw[4 * b : 4 * e]).hexdigest() for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [part.column("key"), pa.array(np.diff(at).astype(np.int64)), pa.array(hashes, pa.string()), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def with_ids(df: DataFrame, path: str, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """*df* with one more column: the ids of each text, begin and end included, as an array of integers."""
    chunked = chunkable(path)
    folder = chunk_table(df, path, text) if chunked else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, BLOCK_BYTES):
                found, at, _ = encode_column(part.column(text), path, chunked, folder)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, ids])

    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """*df* with one more column: the library's text for each array of ids (null for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in batches:
            back = [None if i is None else model.decode(i) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))
