"""Substring dedup by recompression: Spark rounds name runs and pairs of the whole corpus, exact windows verify long repeats.

A document's words are its first symbols. A round of the parse gives every symbol a coin (left or right) drawn from its
name, joins each left symbol with a right symbol after it (pairs), and joins equal neighbours that are in no
pair (runs). A joined symbol's name is a hash of what it joins, so equal parts have one name in any
document. Whether a symbol is formed depends on few neighbours; its
*extent* is the span of words that decides it. Equal substrings form the same symbols wherever these extents
lie inside them: their interior symbols agree.

1. A Spark round (:func:`first_round`, then :func:`next_round`) parses every document on, from the symbols that the round before
   left, and writes symbols and new names. The names of all documents meet in one aggregation, the round's table of names.
2. A name that the corpus has once isn't part of a repeat: every window of ``width`` words with its extent inside is ruled
   out, and symbols that are in no other window go, which cuts the text there. So a round works on what may still repeat: long repeats
   are what keeps shared symbols up to the last round. Copies of whole documents are found by a hash of
   all their words, and only the first of each takes part.
3. Windows that all rounds left are verified: each is hashed to 96 bits, the first place of each hash is taken, and a
   window that isn't in the first document that has it (or isn't its first one there) is a repeat. Minima are combined before the shuffle; the join back to
   places is one that Spark can split at hot keys.
4. Words covered by repeats are taken out of each text.

A clash of two names would only keep windows that step 3 then tells apart. The first Spark round holds three rounds of the parse, as
symbols of two or four words are nearly all shared and rule out little; the second holds two, after which extents outgrow windows.

Nothing is capped. Documents and their windows are joined on id and text hash, which are unique; intermediate
tables are written to the shared folder.

Defined cases: a null text is empty; fewer than ``width`` words have no window and lose nothing; a null id counts
as the largest id there is; of rows with equal ids none is earlier, each is judged by itself, and repeated rows (equal texts, too)
lose and keep the same words; a very long text is one text like any other, hashed in segments; an empty table gives an empty
result; extra columns, whatever their names, are ignored (:func:`digest`) or kept (:func:`remove`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import dropped, mix64, slices, string_buffer, text_or_empty, tidy, window_hashes, word_hashes, word_spans, written

WIDTH = 20
#: Rounds of the parse, by Spark round.
ROUNDS = (range(1, 4), range(4, 6))
PASSES = 2
_FAR = np.int64(1) << np.int64(40)
_LAST = (1 << 63) - 1
_PAIR, _RUN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B185EBCA87)


class Symbols:
    """Symbols of texts laid end to end: name, extent (left, right), whether one starts a stretch, and the round that formed it."""

    def __init__(self, name: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray, born: np.ndarray):
        self.name, self.left, self.right, self.first, self.born = name, left, right, first, born

    @classmethod
    def of_words(cls, words: np.ndarray, at: np.ndarray) -> Symbols:
        n = len(words)
        first = np.zeros(n, dtype=bool)
        first[at[:-1][at[:-1] < n]] = True
        return cls(words, np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64), first, np.zeros(n, dtype=np.int8))

    def only(self, keep: np.ndarray) -> Symbols:
        """The symbols to keep; a stretch ends where one is left out."""
        cut = self.first | np.insert(~keep, 0, True)[: len(keep)]
        return Symbols(self.name[keep], self.left[keep], self.right[keep], cut[keep], self.born[keep])

    def raised(self, level: int, width: int) -> Symbols:
        """The symbols after round *level*, without those whose extent is wider than a window."""
        name, left, right, first, n = self.name, self.left, self.right, self.first, len(self.name)
        if n < 2:
            return self.only(np.zeros(n, dtype=bool))
        is_left = (mix64(name + np.uint64(level * 0x2545F4914F6CDD1D & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        together = ~first[1:]
        pair = is_left[:-1] & ~is_left[1:] & together
        pair_left, pair_right = np.append(pair, False), np.insert(pair, 0, False)
        free = ~(pair_left | pair_right)
        equal = (name[:-1] == name[1:]) & together
        joined = np.insert(equal & free[:-1] & free[1:], 0, False)  # to the symbol before
        # groups of equal neighbours; a symbol outside pairs depends on its group and one symbol to either side
        begin = np.flatnonzero(np.insert(~equal, 0, True))
        end = np.append(begin[1:], n)
        group_left, group_right = np.minimum.reduceat(left, begin), np.maximum.reduceat(right, begin)
        inside = ~first[begin] & np.append(~first[end[:-1]], False)
        before, after = np.maximum(begin - 1, 0), np.minimum(end, n - 1)
        free_left = np.where(inside, np.minimum(np.minimum(left[before], group_left), left[after]), -_FAR)
        free_right = np.where(inside, np.maximum(np.maximum(right[before], group_right), right[after]), _FAR)
        group = np.cumsum(np.insert(~equal, 0, True)) - 1
        heads = np.flatnonzero(~(pair_right | joined))
        is_pair = pair_left[heads]
        alone = np.flatnonzero(~joined)
        run = np.zeros(n, dtype=np.int64)  # how many symbols a run has
        run[alone] = np.diff(np.append(alone, n))
        run = run[heads]
        p = heads[is_pair]
        new_name, new_left, new_right = name[heads].copy(), free_left[group[heads]], free_right[group[heads]]
        new_name[is_pair] = mix64(name[p] * _PAIR + name[p + 1])
        new_left[is_pair], new_right[is_pair] = np.minimum(left[p], left[p + 1]), np.maximum(right[p], right[p + 1])
        is_run = ~is_pair & (run > 1)
        new_name[is_run] = mix64(name[heads[is_run]] * _RUN + run[is_run].astype(np.uint64))
        born = np.where(is_pair | is_run, np.int8(level), self.born[heads])
        return Symbols(new_name, new_left, new_right, first[heads], born).only(new_right - new_left <= width)


def _cut(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    data, offsets = string_buffer(part.column("text"))
    starts, ends, at = word_spans(data, offsets)
    return data, offsets, starts, ends, at


def _valid(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows inside one text, and their texts."""
    n = np.maximum(np.diff(at) - width + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[text], text


def _lists(owner: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


_RECORD = np.dtype([("name", "<u8"), ("left", "<i4"), ("span", "u1")])  # the highest bit of a span: starts a stretch
_STATE = "symbols binary, alive binary, once array<long>, twice array<long>"


def _bytes(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _named(symbols: Symbols, alive: np.ndarray, at: np.ndarray, since: int) -> list[pa.Array]:
    """The columns of ``_STATE``: symbols, which windows may repeat, and names formed since a round, once or more often in a text."""
    rows = len(at) - 1
    owner = np.searchsorted(at, symbols.left, side="right") - 1
    data = np.empty(len(owner), dtype=_RECORD)
    data["name"], data["left"] = symbols.name, symbols.left - at[owner]
    data["span"] = (symbols.right - symbols.left) | (symbols.first.astype(np.int64) << 7)
    new = symbols.born >= since
    key, text = symbols.name[new].view(np.int64), owner[new]
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    head = np.flatnonzero(np.insert((key[1:] != key[:-1]) | (text[1:] != text[:-1]), 0, True)[: len(key)])
    often = np.diff(np.append(head, len(key))) > 1
    lists = [_lists(text[head[x]], key[head[x]], rows) for x in (~often, often)]
    return [_bytes(data, np.searchsorted(owner, np.arange(rows + 1)) * _RECORD.itemsize), _bytes(alive, at), *lists]


def _in_windows(symbols: Symbols, alive: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Which symbols have their extent inside a window that may repeat."""
    total = np.concatenate([[0], np.cumsum(alive, dtype=np.int64)])
    begin = np.maximum(at[np.searchsorted(at, symbols.left, side="right") - 1], symbols.right - width)
    return total[symbols.left + 1] > total[begin]


def first_round(rows: DataFrame, width: int, levels: range) -> DataFrame:
    """ord, hash, n_words, two halves of a hash of all words, and the state after the first *levels*, of which the last gives names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets, starts, ends, at = _cut(part)
                words = word_hashes(data, starts, ends, seed=3)
                symbols = Symbols.of_words(words, at)
                for level in levels:
                    symbols = symbols.raised(level, width)
                alive = np.zeros(len(words), dtype=np.uint8)
                alive[_valid(at, width)[0]] = 1
                symbols = symbols.only(_in_windows(symbols, alive, at, width))
                total = [np.zeros(len(words) + 1, dtype=np.uint64) for _ in range(2)]
                place = np.arange(len(words), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
                for out, salt in zip(total, (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3), strict=True):
                    np.cumsum(mix64(words ^ mix64(place + np.uint64(salt))), out=out[1:])
                whole = [pa.array((t[at[1:]] - t[at[:-1]]).view(np.int64)) for t in total]
                names = ["ord", "hash", "n_words", "high", "low", "symbols", "alive", "once", "twice"]
                state = _named(symbols, alive, at, levels[-1])
                yield pa.RecordBatch.from_arrays([part.column("ord"), part.column("hash"), pa.array(np.diff(at).astype(np.int64)), *whole, *state], names=names)

    return rows.mapInArrow(tidy(run), "ord long, hash long, n_words long, high long, low long, " + _STATE)


def next_round(state: DataFrame, width: int, levels: range) -> DataFrame:
    """The state after *levels* more rounds. state: ord, hash, symbols, alive, and single: names that the corpus has once.

    A window with the extent of such a symbol is ruled out; symbols in none of the others go, and so do texts without any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "symbols"):
                data, offsets = string_buffer(part.column("symbols"))
                marks, at = string_buffer(part.column("alive"))
                found, alive = np.frombuffer(data.tobytes(), dtype=_RECORD), marks.copy()
                owner = np.repeat(np.arange(part.num_rows), np.diff(offsets) // _RECORD.itemsize)
                left = found["left"] + at[owner]
                span = found["span"].astype(np.int64)
                symbols = Symbols(found["name"].copy(), left, left + (span & 127), span > 127, np.zeros(len(left), dtype=np.int8))
                own = part.column("single")
                holder = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(own.offsets)))
                single = mix64(own.flatten().to_numpy().view(np.uint64)) + holder.astype(np.uint64)
                dead = np.isin(mix64(symbols.name) + owner.astype(np.uint64), single)
                change = np.zeros(len(alive) + 1, dtype=np.int64)
                np.add.at(change, np.maximum(at[owner], symbols.right - width)[dead], 1)
                np.add.at(change, left[dead] + 1, -1)
                alive[np.cumsum(change[:-1]) > 0] = 0
                symbols = symbols.only(~dead & _in_windows(symbols, alive, at, width))
                for level in levels:
                    symbols = symbols.raised(level, width)
                symbols = symbols.only(_in_windows(symbols, alive, at, width))
                total = np.concatenate([[0], np.cumsum(alive, dtype=np.int64)])
                out = [part.column("ord"), part.column("hash"), *_named(symbols, alive, at, levels[0] if levels else 1)]
                yield pa.RecordBatch.from_arrays(out, names=["ord", "hash", "symbols", "alive", "once", "twice"]).filter(pa.array(total[at[1:]] > total[at[:-1]]))

    return state.mapInArrow(tidy(run), "ord long, hash long, " + _STATE)


def _singles(names: DataFrame) -> DataFrame:
    """ord, hash, single: of every text of *names*, the names of ``once`` that no other text has.

    The aggregation is the round's table of names.
    """
    text = ["ord", "hash"]
    once = names.select(*text, F.explode("once").alias("a"), F.lit(1).alias("n"))
    twice = names.select(*text, F.explode("twice").alias("a"), F.lit(2).alias("n"))
    table = once.unionByName(twice).groupBy("a").agg(F.sum("n").alias("n"), F.min("ord").alias("ord"), F.min("hash").alias("hash")).where("n = 1")
    found = names.select(*text).join(table.groupBy(*text).agg(F.collect_list("a").alias("single")), text, "left")
    return found.withColumn("single", F.coalesce("single", F.array().cast("array<long>")))


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """h and c (a hash of 96 bits), ord, hash, start: the windows of *rows* (ord, hash, text, alive) that are alive.

    Hash and check are null where the window starts earlier in its own text: nothing is left to find out then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets, starts, ends, at = _cut(part)
                words = word_hashes(data, starts, ends, seed=3)
                spot = np.flatnonzero(string_buffer(part.column("alive"))[0])
                if not len(spot):
                    continue
                text = np.searchsorted(at, spot, side="right") - 1
                high = window_hashes(words, width, 0xD1342543DE82EF95)[spot].view(np.int64)
                check = (window_hashes(words, width, 0xAF251AF3B0F025B5)[spot] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                order = np.lexsort((spot, check, high, text))
                again = np.zeros(len(spot), dtype=bool)  # the same window starts earlier in the same text
                h, c, t = high[order], check[order], text[order]
                again[order[1:]] = (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (t[1:] == t[:-1])
                ids, own = (part.column(c).to_numpy()[text] for c in ("ord", "hash"))
                yield pa.RecordBatch.from_arrays([pa.array(high, mask=again), pa.array(check, mask=again), pa.array(ids), pa.array(own), pa.array((spot - at[text]).astype(np.int32))], names=["h", "c", "ord", "hash", "start"])

    return rows.mapInArrow(tidy(run), "h long, c int, ord long, hash long, start int")


def repeats(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """ord, hash, starts: first words of the windows that also start earlier; [-1] if all words of the text do.

    rows: ord (the order of documents), hash (of the text) and text.
    """
    text = ["ord", "hash"]
    scan = written(first_round(rows, width, ROUNDS[0]), "sd-round")
    same = ["high", "low", "n_words"]
    long = scan.where(F.col("n_words") >= width)
    firsts = long.groupBy(*same).agg(F.min("ord").alias("first"))
    ranked = long.select(*text, *same, "once", "twice").join(firsts, same)
    copies = written(ranked.where("ord > first").select(*text).distinct(), "sd-copies")
    # rows that repeat in id and text are one document, whose names and windows are made once
    names = written(ranked.where("ord = first").dropDuplicates(text).select(*text, "once", "twice"), "sd-names")
    state = scan
    for passes, levels in ((PASSES, ROUNDS[1]), (1, range(0))):  # the first state is as large as the texts: a share at a time
        # an id with several texts is one document, whose windows may recur in another of its texts: names are counted by text
        single, grown = _singles(names), []
        if passes > 1:
            single = written(single, "sd-single")
            dropped(names)
        for k in range(passes):
            own = state.select(*text, "symbols", "alive").where(F.pmod("hash", F.lit(passes)) == k).join(single, text)
            grown.append(written(next_round(own.dropDuplicates(text), width, levels), "sd-round"))
        if passes > 1:
            dropped(single)
        dropped(state)
        state = names = reduce(DataFrame.union, grown)
    texts = rows.join(state.select(*text, "alive"), text).dropDuplicates(text)
    found = written(_windows(texts.select(*text, "text", "alive"), width), "sd-windows")
    dropped(state)
    later = [found.where("h is null").select(*text, "start")]
    for k in range(PASSES):  # a share of the hashes at a time: the shuffles of one pass are gone before the next
        own = found.where((F.pmod("h", F.lit(PASSES)) == k) & F.col("h").isNotNull())
        least = own.groupBy("h", "c").agg(F.min("ord").alias("m"), F.count("*").alias("n")).where("n > 1").select("h", "c", "m")
        least = written(least, "sd-least")
        later.append(written(own.join(least, ["h", "c"]).where("ord > m").select(*text, "start"), "sd-later"))
        dropped(least)
    starts = reduce(DataFrame.union, later).groupBy(*text).agg(F.sort_array(F.collect_set("start")).alias("starts"))
    starts = written(starts, "sd-starts")
    for part in later[1:]:
        dropped(part)
    dropped(found)
    return starts.unionByName(copies.withColumn("starts", F.array(F.lit(-1))))


def _keyed(df: DataFrame, text: str, key: str) -> DataFrame:
    t = text_or_empty(f"`{text}`")
    own = F.col(f"`{key}`").cast("long")
    return df.select(own.alias("doc_id"), F.coalesce(own, F.lit(_LAST)).alias("ord"), F.xxhash64(t).alias("hash"), t.alias("text"))


def covered(n_words: int, starts: list[int] | None, width: int) -> np.ndarray:
    """Which words a removed window covers."""
    gone = np.zeros(n_words + 1, dtype=np.int64)
    if starts is not None and len(starts):
        if starts[0] < 0:
            return np.ones(n_words, dtype=bool)
        s = np.asarray(starts, dtype=np.int64)
        s = s[s + width <= n_words]
        np.add.at(gone, s, 1)
        np.add.at(gone, s + width, -1)
    return np.cumsum(gone[:-1]) > 0


def digest(df: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, and the hash of the kept words joined by one space, of every row of *df*."""
    rows = _keyed(df, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets, starts, ends, at = _cut(part)
                raw, lists = data.tobytes(), part.column("starts").to_pylist()
                n_words, n_removed, kept = np.diff(at), [], []
                for i, (b, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    stay = np.flatnonzero(~covered(e - b, lists[i], width)) + b
                    n_removed.append(e - b - len(stay))
                    spans = zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)
                    kept.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in spans])).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = rows.join(repeats(rows, width), ["ord", "hash"], "left")
    return joined.select("doc_id", "text", "starts").mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(df: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """*df* without the words of repeats. Kept words keep the white space between them; rows left without words go."""
    rows = _keyed(df, text, key)
    found = repeats(rows, width)

    @F.pandas_udf("string")
    def without(texts, lists):
        import pandas as pd

        out = []
        for t, starts in zip(texts, lists, strict=True):
            if starts is None or t is None:
                out.append(t)
                continue
            raw = t.encode()
            data = np.frombuffer(raw, dtype=np.uint8)
            b, e, at = word_spans(data, np.array([0, len(data)]))
            stay = ~covered(len(b), starts, width)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], stay.astype(np.int8), [0]])))
            out.append(b" ".join(raw[b[x] : e[y - 1]] for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)).decode())
        return pd.Series(out, dtype=object)

    t = text_or_empty(f"`{text}`")
    with_keys = df.withColumns({"__ord": F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)), "__hash": F.xxhash64(t)})
    joined = with_keys.join(found.toDF("__ord", "__hash", "__starts"), ["__ord", "__hash"], "left")
    out = joined.withColumn(text, F.when(F.col("__starts").isNotNull(), without(F.col(text), F.col("__starts"))).otherwise(F.col(text)))
    return out.where(F.col("__starts").isNull() | (F.col(text) != "")).select(*df.columns)
