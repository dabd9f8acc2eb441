"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are cut at safe boundaries and the pieces encoded in batches balanced by bytes, so neither a long text nor a
batch of many sets the memory or the time of a call. A cut is safe where the tokenizer's own splitting
always ends a word: at one space between two characters that are no white space. No special token of the
vocabulary holds a space, so none is cut. Each distinct piece is encoded once and its count kept in a bounded
table of the Python worker; counts are summed by position.

Cuts are used only for vocabularies that :func:`safe_to_cut` approves; others get whole texts.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a very long text is cut into pieces, and a long run without safe
boundaries is one piece; repeated rows are counted one by one; extra columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm.common import slices, string_buffer

#: Characters of new pieces in one call of the library, and bytes that one of a worker's two tables may hold.
BATCH_CHARS = 1 << 18
TABLE_BYTES = 192 << 20
#: White space by any of the definitions in use (Python's, the expression engines', older Unicode).
_SPACES = r"\s\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff"
_CUT = re.compile(rf"(?<=[^{_SPACES}]) (?=[^{_SPACES}])")
#: White space but for spaces and line ends, and those two next to each other or at an edge.
_ODD = re.compile(rf"(?![ \n])[{_SPACES}]")
_TOUCHING = ("  ", " \n", "\n ", "\n\n")
_loaded: dict[str, object] = {}


def load_tokenizer(path: str):
    """The library's tokenizer, loaded once in a process, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def safe_to_cut(path: str) -> bool:
    """Byte-level splitting with no normaliser and no added token that holds or takes white space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return bool(plain and all(not re.search(rf"[{_SPACES}]", t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"]))


class PieceTable:
    """piece -> value, filled in batches. Bounded in bytes by two generations.

    When the young generation is full it becomes the old one; a piece found in the old one moves to the young.
    """

    def __init__(self, encode, most_bytes: int = TABLE_BYTES, batch_chars: int = BATCH_CHARS):
        self._encode, self._most, self._batch = encode, most_bytes // 2, batch_chars
        self.young, self._old, self._held = {}, {}, 0

    def prepare(self, pieces: set[str]) -> dict[str, int]:
        """The young generation with all of *pieces*; new ones are encoded, shorter ones first so that a batch has like lengths."""
        if self._held > self._most:
            self.young, self._old, self._held = {}, self.young, 0
        missing = [p for p in pieces if p not in self.young]
        again = [p for p in missing if p in self._old] if self._old else []
        self.young.update((p, self._old[p]) for p in again)
        new = sorted((p for p in missing if p not in self._old), key=len)
        begin, size = 0, 0
        for i, piece in enumerate(new):
            if i > begin and size + len(piece) > self._batch:
                self.young.update(zip(new[begin:i], self._encode(new[begin:i]), strict=True))
                begin, size = i, 0
            size += len(piece)
        if begin < len(new):
            self.young.update(zip(new[begin:], self._encode(new[begin:]), strict=True))
        self._held += sum(map(sys.getsizeof, missing)) + 100 * len(missing)
        return self.young


_tables: dict[str, tuple[PieceTable, PieceTable]] = {}


def _table(path: str) -> tuple[PieceTable, PieceTable]:
    """For first pieces, and for later ones: those follow a space unless they start with a line end."""
    if path not in _tables:
        t = load_tokenizer(path)

        def encode(pieces: list[str]) -> list[int]:
            return [len(e) for e in t.encode_batch_fast(pieces, add_special_tokens=False)]

        _tables[path] = PieceTable(encode), PieceTable(lambda pieces: encode([p if p[:1] == "\n" else " " + p for p in pieces]))
    return _tables[path]


def cut_text(text: str) -> list[str]:
    """Pieces that stand for themselves if first or after a line end, and with one space before them if not."""
    plain = text and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in _TOUCHING)
    if plain and not _ODD.search(text):
        return text.replace("\n", " \n").split(" ")  # a line end between two words is a safe cut, too
    return _CUT.split(text)


def count_texts(texts: list[str], path: str, cut: bool) -> list[int]:
    """Token counts of whole texts."""
    if not cut:
        t = load_tokenizer(path)
        return [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    first, later = _table(path)
    parts = [cut_text(text) for text in texts]
    begins = first.prepare({p[0] for p in parts})
    get = later.prepare(set().union(*(p[1:] for p in parts))).__getitem__
    return [begins[p[0]] + sum(map(get, p[1:])) for p in parts]


def count_tokens(df: DataFrame, path: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row of *df*, in one scan."""
    cut = safe_to_cut(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = ["" if t is None else t for t in part.column(text).to_pylist()]
                n = np.array(count_texts(texts, path, cut), dtype=np.int64)
                sizes = np.diff(string_buffer(part.column(text))[1])
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
