"""Token ids in binary files, coded by a static range asymmetric numeral system (rANS).

A data set is a folder of ``.rans`` files in ascending order of documents, and one frequency table that all of them
share. A file holds the ids of a run of documents in blocks of ``BLOCK`` ids. Each block is coded by itself
in ``LANES`` interleaved streams with 64-bit states and 32-bit words, so blocks decode in parallel, and all lanes of
many blocks decode at once in numpy. The footer holds for each block its place, its first id, its CRC-32 and
the lanes' states at checkpoints every ``CHECKPOINT`` steps, from which decoding can start in the middle, and
for each document its id and its number of tokens.

Steps: rank documents into ranges by id and tokenise each range in order (distinct chunks once, by the library);
count all ids; build the table; code each range into files. Ids are tokenised once and kept, compressed, in
the shared folder. Files are named by their content, so a task that runs again leaves the same files.

Defined cases: a null or empty text has the end id only; a null id comes first; rows with equal ids follow each
other in the order of a hash of their texts, and repeated rows are interchangeable; a very long text is encoded by itself and may
span blocks of one file; an empty table gives no files and an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import fresh_path, get_file, put_file, slices, string_buffer, text_or_empty, tidy, written
from loomspark.llm.token_counts import load_tokenizer

LANES, BLOCK, CHECKPOINT, BITS = 32, 1 << 14, 256, 20
#: Ids after which a file is closed, and blocks coded at once.
FILE_IDS = 16 << 20
AT_ONCE = 512
_LOW = np.uint64(1 << 31)
_MAGIC = b"LOOMRANS"


class Table:
    """Frequencies that add up to 2^BITS; every id that occurs has one of at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Scales counts to 2^BITS; what rounding leaves goes to the most frequent ids."""
        counts = counts.astype(np.float64)
        seen = counts > 0
        if not seen.any():
            counts, seen = np.ones_like(counts), np.ones(len(counts), dtype=bool)
        whole = 1 << BITS
        if seen.sum() > whole // 2:
            raise ValueError("too many distinct ids for the table")
        freq = np.where(seen, np.maximum(1, np.floor(counts / counts.sum() * whole)), 0).astype(np.int64)
        rest, order = whole - int(freq.sum()), np.argsort(-freq, kind="stable")
        while rest:
            step = np.zeros(len(freq), dtype=np.int64)
            top = order[: max(1, min(abs(rest), int((freq > 1).sum())))]
            step[top] = 1 if rest > 0 else -1
            freq += step
            rest -= int(step.sum())
        return cls(freq)

    def to_bytes(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        return cls(np.frombuffer(zlib.decompress(data), dtype="<u4"))


def _encode_group(ids: np.ndarray, table: Table) -> list[tuple[bytes, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """Codes blocks of equal length (blocks x ids): for each its words, first states, and later checkpoints."""
    blocks, n = ids.shape
    steps = -(-n // LANES)
    padded = np.zeros((blocks, steps * LANES), dtype=np.int64)
    padded[:, :n] = ids
    symbols = padded.reshape(blocks, steps, LANES)
    lanes_used = np.full(steps, LANES)
    lanes_used[-1] = n - (steps - 1) * LANES
    x = np.full((blocks, LANES), _LOW, dtype=np.uint64)
    out, full = np.zeros((blocks, steps, LANES), dtype=np.uint32), np.zeros((blocks, steps, LANES), dtype=bool)
    shift, bits, states = np.uint64(63 - BITS), np.uint64(BITS), {}
    for step in range(steps - 1, -1, -1):
        k = lanes_used[step]
        s, own = symbols[:, step, :k], x[:, :k]
        f = table.freq[s]
        over = own >= f << shift
        full[:, step, :k] = over
        out[:, step, :k] = own.astype(np.uint32)
        own = np.where(over, own >> np.uint64(32), own)
        q = own // f
        x[:, :k] = (q << bits) + (own - q * f) + table.cum[s]
        if step % CHECKPOINT == 0:
            states[step] = x.copy()
    result = []
    for b in range(blocks):
        used = np.concatenate([[0], np.cumsum(full[b].sum(axis=1))])
        later = [(int(used[s]), states[s][b]) for s in sorted(states) if s]
        result.append((out[b][full[b]].astype("<u4").tobytes(), states[0][b], later))
    return result


def decode_blocks(words: list[np.ndarray], states: np.ndarray, n: int, table: Table, first_step: int = 0) -> np.ndarray:
    """Ids (blocks x n) of blocks of equal length, from their words and the lanes' states at *first_step*."""
    blocks, steps = len(words), -(-n // LANES)
    out = np.zeros((blocks, steps, LANES), dtype=np.uint32)
    stream = np.concatenate([*words, np.zeros(LANES, dtype=np.uint32)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]]).astype(np.int64)
    x, mask, bits = states.astype(np.uint64).copy(), np.uint64((1 << BITS) - 1), np.uint64(BITS)
    for step in range(first_step, steps):
        k = LANES if step < steps - 1 else n - (steps - 1) * LANES
        own = x[:, :k]
        slot = own & mask
        s = table.slots[slot.astype(np.int64)]
        out[:, step, :k] = s
        own = table.freq[s] * (own >> bits) + slot - table.cum[s]
        need = own < _LOW
        order = np.cumsum(need, axis=1)
        word = stream[np.minimum(at[:, None] + order - 1, len(stream) - 1)]
        x[:, :k] = np.where(need, (own << np.uint64(32)) | word, own)
        at += order[:, -1]
    return out.reshape(blocks, -1)[:, first_step * LANES : n]


def encode_file(ids: np.ndarray, docs: list[tuple[int | None, int]], table: Table, table_name: str) -> bytes:
    """A whole file. docs: (document id, number of ids), in order."""
    body, entries = [_MAGIC], []
    at = len(_MAGIC)
    full = len(ids) // BLOCK
    groups = [ids[i * BLOCK : min(i + AT_ONCE, full) * BLOCK].reshape(-1, BLOCK) for i in range(0, full, AT_ONCE)]
    if len(ids) > full * BLOCK:
        groups.append(ids[full * BLOCK :].reshape(1, -1))
    first = 0
    for group in groups:
        for own, (words, start, later) in zip(group, _encode_group(group, table), strict=True):
            points = b"".join(struct.pack("<I", w) + s.astype("<u8").tobytes() for w, s in later)
            entries.append(struct.pack("<QIQIII", at, len(words), first, len(own), zlib.crc32(own.astype("<u4").tobytes()), len(later)) + start.astype("<u8").tobytes() + points)
            body.append(words)
            at += len(words)
            first += len(own)
    known = np.array([d for d, _ in docs if d is not None], dtype="<i8")
    footer = b"".join(
        [
            struct.pack("<III", len(entries), len(docs), len(docs) - len(known)),
            table_name.encode().ljust(80, b"\0"),
            *entries,
            known.tobytes(),
            np.array([n for _, n in docs], dtype="<u4").tobytes(),
        ]
    )
    packed = zlib.compress(footer)
    return b"".join([*body, packed, struct.pack("<QI", len(packed), zlib.crc32(packed)), _MAGIC])


class Reader:
    """Random access to a file's bytes."""

    def __init__(self, data: bytes, table: Table | None = None):
        if data[:8] != _MAGIC or data[-8:] != _MAGIC:
            raise ValueError("not a file of token ids")
        size, check = struct.unpack("<QI", data[-20:-8])
        packed = data[len(data) - 20 - size : len(data) - 20]
        if zlib.crc32(packed) != check:
            raise ValueError("the footer is damaged")
        footer = zlib.decompress(packed)
        n_blocks, n_docs, n_null = struct.unpack_from("<III", footer)
        self.table_name, at, self.blocks = footer[12:92].rstrip(b"\0").decode(), 92, []
        for _ in range(n_blocks):
            place, length, first, n, crc, points = struct.unpack_from("<QIQIII", footer, at)
            at += struct.calcsize("<QIQIII")
            states = [(0, np.frombuffer(footer, "<u8", LANES, at))]
            at += 8 * LANES
            for _ in range(points):
                states.append((struct.unpack_from("<I", footer, at)[0], np.frombuffer(footer, "<u8", LANES, at + 4)))
                at += 4 + 8 * LANES
            self.blocks.append((place, length, first, n, crc, states))
        known = np.frombuffer(footer, "<i8", n_docs - n_null, at).tolist()
        self.counts = np.frombuffer(footer, "<u4", n_docs, at + 8 * (n_docs - n_null)).astype(np.int64)
        self.docs: list[int | None] = [None] * n_null + known  # null ids come first
        self.data, self.table = data, table

    def _words(self, block: tuple, skip: int = 0) -> np.ndarray:
        return np.frombuffer(self.data, "<u4", block[1] // 4 - skip, block[0] + 4 * skip)

    def ids(self) -> np.ndarray:
        """All ids; every block's checksum is checked."""
        out, i = [np.zeros(0, np.uint32)], 0
        while i < len(self.blocks):
            j = i + 1
            while j < len(self.blocks) and j - i < AT_ONCE and self.blocks[j][3] == self.blocks[i][3]:
                j += 1
            group = self.blocks[i:j]
            rows = decode_blocks([self._words(b) for b in group], np.array([b[5][0][1] for b in group]), group[0][3], self.table)
            for b, row in zip(group, rows, strict=True):
                if zlib.crc32(row.astype("<u4").tobytes()) != b[4]:
                    raise ValueError(f"the block at byte {b[0]} is damaged")
            out.append(rows.ravel())
            i = j
        return np.concatenate(out)

    def ids_from(self, block: int, step: int) -> np.ndarray:
        """The ids of a block from the checkpoint at or before *step* on."""
        b, point = self.blocks[block], min(step // CHECKPOINT, len(self.blocks[block][5]) - 1)
        skip, state = b[5][point]
        return decode_blocks([self._words(b, skip)], state[None, :], b[3], self.table, point * CHECKPOINT)[0]


#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_CHARS = np.arange(256)
_CHARS[[b for b in range(256) if b not in _SHOWN and b != 32]] = 256 + np.array([i for i, b in enumerate(b for b in range(256) if b not in _SHOWN) if b != 32])
#: Text bytes whose words are looked up at once, and bytes that a worker's table of units may hold.
UNIT_SLICE = 4 << 20
TABLE_BYTES = 160 << 20
#: Classes of bytes: white space that ends a word, letters, digits, marks, and those that leave a word to the library.
_GAP, _LETTER, _DIGIT, _MARK, _ODD = range(5)
#: Plain units that the model merges in one call.
_TOGETHER = 200


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.full(256, _ODD, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    for b in range(33, 127):
        c = chr(b)
        kind[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _ODD if c in "'<" else _MARK
        lower[b] = ord(c.lower())
    kind[[0x20, 0x0A]] = _GAP
    return kind, lower


_KIND, _LOWER = _byte_classes()


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What the tokenizer splits UTF-8 texts into, in order, which the library must see, and the n + 1 offsets of texts.

    A unit is a lower-cased run of letters, a digit, a run of marks, or a whole word that the library must see: one with
    an apostrophe, ``<``, a control character, or any character but ASCII and the letters of Latin-1.
    """
    n = len(data)
    kind, lower = _KIND[data], _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    second = data[lead + 1]
    lead = lead[(second != 0x97) & (second != 0xB7)]  # the signs of multiplication and division
    kind[lead], kind[lead + 1] = _LETTER, _LETTER
    capital = lead[data[lead + 1] < 0x9F] + 1
    lower[capital] = data[capital] + 0x20
    inside, edge = kind != _GAP, np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=np.uint8)
    before[:1], before[1:] = _GAP, kind[:-1]
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        starts = np.flatnonzero(inside & ((before == _GAP) | edge[:-1]))
        ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1
        words = np.unique(np.searchsorted(starts, odd, side="right") - 1)
        mask = np.zeros(n + 1, dtype=np.int8)
        mask[starts[words]] += 1
        mask[ends[words]] -= 1
        mask = np.cumsum(mask[:-1], dtype=np.int8) > 0
        kind[mask], lower[mask] = _ODD, data[mask]
        before[1:] = kind[:-1]
    begin = inside & ((kind != before) | (kind == _DIGIT) | edge[:-1])
    first = np.flatnonzero(begin)
    at = np.append(np.flatnonzero(begin[inside]), int(inside.sum())).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(lower[inside])])
    return found, kind[first] == _ODD, np.searchsorted(first, offsets)


class UnitTable:
    """Ids of distinct units: a slot for each, and all ids in one array. Bounded in bytes by two generations.

    When the young generation is full it becomes the old one; a unit found in the old one moves to the young.
    """

    def __init__(self, path: str, most_bytes: int = TABLE_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self._path, self._most, whole = path, most_bytes // 2, load_tokenizer(path)
        self._model = Tokenizer(whole.model)
        self._model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._is_end = np.zeros(whole.get_vocab_size(True), dtype=bool)
        self._is_end[[i for t, i in whole.get_vocab(False).items() if t.endswith(whole.model.end_of_word_suffix)]] = True
        self._old: tuple[dict, ...] = ({}, None, None, None)
        self._fresh()

    def _fresh(self) -> None:
        self._slot: dict[bytes, int] = {}
        self._start, self._n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._ids, self._used, self._held = np.zeros(1 << 14, np.uint32), 0, 0

    def _add(self, words: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        first, k = len(self._slot), len(words)
        while first + k > len(self._start):
            self._start, self._n = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._n))
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + len(ids)] = ids
        self._n[first : first + k] = n
        self._start[first : first + k] = self._used + np.cumsum(n) - n
        self._used += len(ids)
        self._slot.update(zip(words, range(first, first + k), strict=True))
        self._held += sum(map(len, words)) + 120 * k + 4 * len(ids)

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain units by the model's own merges: many at once, told apart by the ids that end a word."""
        groups = b"\n".join([b" ".join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)])
        data = np.frombuffer(groups, dtype=np.uint8)
        shown = np.where(data == 10, 10, _CHARS[data]).astype("<u4").tobytes().decode("utf-32-le")
        ids = _flat(self._model.encode_batch_fast(shown.split("\n"), add_special_tokens=False))
        ends = np.flatnonzero(self._is_end[ids])
        if len(ends) != len(words):
            raise ValueError("the vocabulary doesn't mark the end of each word")
        return ids, np.diff(ends, prepend=-1)

    def _encode(self, words: list[bytes], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, those marked *whole* by the whole library, and how many each has."""
        if not whole.any():
            return self._merged(words)
        own, n = self._merged([words[i] for i in np.flatnonzero(~whole).tolist()]) if not whole.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        found = load_tokenizer(self._path).encode_batch_fast([words[i].decode() for i in np.flatnonzero(whole).tolist()], add_special_tokens=False)
        counts = np.zeros(len(words), dtype=np.int64)
        counts[~whole], counts[whole] = n, [len(e) for e in found]
        out, by_library = np.empty(counts.sum(), dtype=np.uint32), np.repeat(whole, counts)
        out[~by_library], out[by_library] = own, _flat(found)
        return out, counts

    def slots(self, words: list[bytes], whole: np.ndarray) -> np.ndarray:
        """The slot of each of *words*, which are distinct."""
        if self._held > self._most:
            self._old = self._slot, self._start, self._n, self._ids
            self._fresh()
        get = lambda table, own: np.fromiter(map(table.get, own, repeat(-1)), np.int64, len(own))
        found = get(self._slot, words)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            first = len(self._slot)
            kept = get(self._old[0], [words[i] for i in missing.tolist()]) if self._old[0] else np.full(len(missing), -1)
            again, new = missing[kept >= 0], missing[kept < 0]
            if len(again):
                _, start, n, ids = self._old
                kept = kept[kept >= 0]
                self._add([words[i] for i in again.tolist()], *_gather(start[kept], n[kept], ids))
            if len(new):
                own = [words[i] for i in new.tolist()]
                self._add(own, *self._encode(own, whole[new]))
            found[np.concatenate([again, new])] = np.arange(first, len(self._slot))
        return found

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units at *slots*, in order, and how many each has."""
        return _gather(self._start[slots], self._n[slots], self._ids)


def _flat(found: list) -> np.ndarray:
    return np.concatenate([np.array(e.ids, dtype=np.uint32) for e in found]) if found else np.zeros(0, np.uint32)


def _gather(start: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.repeat(start - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return ids[at], n


_unit_tables: dict[str, UnitTable] = {}


def safe_to_cut(path: str) -> bool:
    """Lower-casing and splitting at white space, which is dropped: chunks between spaces stand alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    split = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and pre[0]["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
    plain = all(not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
    model = spec["model"]
    ends = model.get("end_of_word_suffix") if model.get("type") == "BPE" and not model.get("continuing_subword_prefix") else None
    letters = ends and all(chr(c) + x in model["vocab"] for c in _CHARS.tolist() if c != 32 for x in ("", ends))
    return bool(letters) and norm == ["NFC", "Replace", "Lowercase"] and bool(split) and plain and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")


def _typecode(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def encode_column(column: pa.Array, path: str, cut: bool, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of whole texts as the library gives them, each text's followed by *end_id*, and the n + 1 offsets of texts."""
    tail = [] if end_id is None else [end_id]
    if not cut:
        texts = ["" if t is None else t for t in column.to_pylist()]
        own = [[*e.ids, *tail] for e in load_tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([x for ids in own for x in ids], dtype=np.uint32), np.cumsum([0, *map(len, own)])
    if path not in _unit_tables:
        _unit_tables[path] = UnitTable(path)
    found, odd, at = units(*string_buffer(column))
    coded = found.dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    whole = np.zeros(len(words), dtype=bool)
    whole[codes[odd]] = True
    ids, n = _unit_tables[path].gather(_unit_tables[path].slots(words, whole)[codes])
    ends = np.concatenate([[0], np.cumsum(n)])[at]
    if tail:
        ids = np.insert(ids, ends[1:], end_id)
        ends += np.arange(len(ends))
    return ids, ends


def tokenised(df: DataFrame, path: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """part, doc_id, n, ids: documents in ascending order of id in each part, and parts in order of their ids.

    Rows of one id are ordered by a hash of their text and spread over ranges by it, and equal rows by their place.
    """
    code, cut = _typecode(max(load_tokenizer(path).get_vocab_size(True), end_id + 1)), safe_to_cut(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", UNIT_SLICE):
                ids, ends = encode_column(part.column("text"), path, cut, end_id)
                raw = ids.astype(code)
                lists = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((ends * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([part.column("part"), part.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), lists], names=["part", "doc_id", "n", "ids"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.col("tie")
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(*order, F.col("place")).sortWithinPartitions(*order)
    return ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(tidy(run), "part int, doc_id long, n long, ids binary")


def counted(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, over all documents; the driver gets one row for each id of the vocabulary."""
    code = _typecode(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                total += np.bincount(string_buffer(part.column("ids"))[0].view(code), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


_MANIFEST = "file string, first_doc long, part int, seq int, n_docs long, n_ids long"


def _put(folder: str, data: bytes, suffix: str) -> str:
    """Writes a file named by its content."""
    name = hashlib.sha256(data).hexdigest() + suffix
    put_file(folder, name, data)
    return name


def _get(folder: str, name: str) -> bytes:
    found = get_file(folder, name)
    if found is None:
        raise FileNotFoundError(f"{folder}/{name}")
    return found


def write_files(tokens: DataFrame, folder: str, table_name: str, size: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Codes *tokens* (see :func:`tokenised`) into files; returns a row for each: its first document and its size."""
    code = _typecode(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        docs, held, total, part, seq = [], [], 0, None, 0

        def close() -> pa.RecordBatch:
            nonlocal table
            table = table or Table.from_bytes(_get(folder, table_name))
            ids = np.frombuffer(b"".join(held), dtype=code)
            name = _put(folder, encode_file(ids, docs, table, table_name), ".rans")
            row = {"file": name, "first_doc": docs[0][0], "part": part, "seq": seq, "n_docs": len(docs), "n_ids": total}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        rank = lambda d: (d is not None, d or 0)  # noqa: E731  null ids come first
        for batch in batches:
            for p, d, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "ids")), strict=True):
                # a task may get parts of several files of the table: a file of ids holds one run of one part
                if docs and (p != part or rank(d) < rank(docs[-1][0]) or total >= file_ids):
                    yield close()
                    docs, held, total, seq = [], [], 0, seq + 1
                part = p
                docs.append((d, n))
                held.append(ids)
                total += n
        if docs:
            yield close()

    return tokens.mapInArrow(run, _MANIFEST)


def read_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, decoded from the files. A row for each part (a range task) passes the driver."""
    parts, at = [], 0
    for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        parts.append((r["part"], at))
        at += r["n"]
    own = Window.partitionBy("part").orderBy(F.col("first_doc").asc_nulls_first(), "seq")
    before = F.sum("n_ids").over(own) - F.col("n_ids")
    placed = manifest.withColumn("before", before).join(spark.createDataFrame(parts, "part int, base long"), "part")
    listed = placed.select("file", (F.col("base") + F.col("before")).alias("start")).repartition(max(2, 4 * spark.sparkContext.defaultParallelism), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, name = None, None
        for batch in batches:
            for r in batch.to_pylist():
                reader = Reader(_get(folder, r["file"]))
                if name != reader.table_name:
                    name, table = reader.table_name, Table.from_bytes(_get(folder, reader.table_name))
                reader.table = table
                raw = reader.ids().astype("<u4").tobytes()
                ends = np.cumsum(reader.counts)
                begins = ends - reader.counts
                crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(reader.docs, pa.int64()), pa.array(begins + r["start"]), pa.array(reader.counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(df: DataFrame, path: str, end_id: int, folder: str | None = None, text: str = "text", key: str = "doc_id") -> tuple[str, DataFrame]:
    """Writes the ids of all texts of *df* as files in *folder*; returns the folder and the manifest."""
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    size = max(load_tokenizer(path).get_vocab_size(True), end_id + 1)
    tokens = written(tokenised(df, path, end_id, text, key), "token-ids")
    name = _put(folder, Table.of_counts(counted(tokens, size)).to_bytes(), ".table")
    return folder, written(write_files(tokens, folder, name, size), "token-manifest")
